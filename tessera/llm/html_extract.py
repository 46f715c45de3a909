"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a vector of its tag path (tags, class
and id words of all open elements, hashed), its words (hashed) and a few figures. A bidirectional LSTM in numpy reads the
vectors of all blocks of a page and gives each a chance of being main text, so every decision sees the whole page.
Blocks above one half are joined.

The labeller is trained here: on at most `max_pages` pages (the smallest hashes of page_id), labelled by the meaning of
their own elements (article or main against nav, footer, aside and the like), and on about max_pages new layouts that
dress the same blocks in other elements, with sidebars, notices, forms and reader comments. Training is seeded; the result goes to
the tasks as a few small arrays.

Defined cases: a null or empty html has an empty text. Broken markup is read as far as it goes: unclosed elements end
with their parent, an unclosed head before what cannot stand in it, an unclosed script or style runs to the end. A page without blocks over one half has an empty text.
Repeated rows are extracted alike. An empty table gives an empty result, from a labeller trained on new layouts alone.
"""

from __future__ import annotations

import html as html_text
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import smallest_hashes
from tessera.llm._text import RangeHash, U, texts

PATH, WORD, FIGURES = 48, 24, 5
INPUT = PATH + WORD + FIGURES
HIDDEN = 24

#: fixed values: element classes of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_ELEMENTS = frozenset("head script style noscript template iframe object svg canvas math audio video title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: elements that may stand in a head; any other one, or text, ends an open head
IN_HEAD = frozenset("title base basefont bgsound link meta script style noscript noframes template".split())
#: words in tags, classes and ids that tell main text from the rest, for labelling the training pages
MAIN = frozenset("article main content post entry story".split())
REST = frozenset("nav menu footer aside sidebar ad ads advert banner cookie notice form comment comments share related breadcrumb".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[A-Za-z/!?][^>]*>", re.S | re.I)
_TITLE_END = re.compile(r"</title\s*>|(?=</?head\b|<body\b)", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text with white space made plain, the path of open elements and the share of text in links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: float


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    hidden = linked = links = size = at = 0

    def flush() -> None:
        nonlocal links, size
        if parts:
            whole = "".join(parts)
            whole = " ".join((html_text.unescape(whole) if "&" in whole else whole).split())
            if whole:
                out.append(Block(whole, tuple(x[1] for x in stack), links / max(size, 1)))
            parts.clear()
        links = size = 0

    def text(piece: str) -> None:
        nonlocal links, size
        if piece and stack and stack[-1][0] == "head" and not piece.isspace():
            close(len(stack) - 1)
        if piece and not hidden:
            parts.append(piece)
            size += len(piece)
            links += len(piece) * (linked > 0)

    def close(k: int) -> None:
        nonlocal hidden, linked
        for name, _ in stack[k:]:
            hidden -= name in HIDDEN_ELEMENTS
            linked -= name == "a"
        del stack[k:]

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if name not in IN_HEAD and stack:
            # what cannot stand in a head ends an open one, and a block an open title
            k = len(stack) - 1
            if stack[k][0] == "title" and not inline and not (k and stack[k - 1][0] == "svg"):
                close(k)
                k -= 1
            if k >= 0 and stack[k][0] == "head":
                close(k)
        if name == "title" and not m[4].endswith("/") and (end := _TITLE_END.search(page, at)):
            # text up to the end tag, whatever it looks like
            at = end.end()
            continue
        if not inline:
            # a block ends open inline elements and what it closes by rule
            while stack and (stack[-1][0] in INLINE or stack[-1][0] in CLOSES.get(name, ()) or stack[-1][0] == "p"):
                close(len(stack) - 1)
        if name in VOID or m[4].endswith("/"):
            continue
        words = [name]
        for found in _NAMES.findall(m[4]) if m[4] else ():
            words += _WORD.findall("".join(found).lower())
        stack.append((name, tuple(words)))
        hidden += name in HIDDEN_ELEMENTS
        linked += name == "a"
    text(page[at:])
    flush()
    return out


def weak_label(path: tuple[tuple[str, ...], ...]) -> int:
    """1 if the innermost telling element holds main text, by its tag, class and id words."""
    for words in reversed(path):
        found = set(words)
        if found & REST:
            return 0
        if found & MAIN:
            return 1
    return 0


_paths: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed path: every tag and name, and the innermost one again."""
    have = _paths.get(path)
    if have is None:
        have = np.zeros(PATH, np.float32)
        for depth, words in enumerate(path):
            for word in words:
                for salt in ("", "last ") if depth == len(path) - 1 else ("",):
                    h = zlib.crc32((salt + word).encode())
                    have[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = have
    return have


def vectors(found: list[Block]) -> np.ndarray:
    """Input vectors of blocks."""
    out = np.zeros((len(found), INPUT), np.float32)
    at = 0
    for t in texts(pa.array([b.text for b in found], pa.large_string())):
        words = t.words()
        h = RangeHash(t.buf).of(words.start, words.end)
        n = words.count(len(t))
        sign = np.where((h >> U(40)) & U(1), 1.0, -1.0)
        bag = np.bincount(words.text * WORD + (h % U(WORD)).astype(np.int64), sign, minlength=len(t) * WORD).reshape(len(t), WORD)
        own = slice(at, at + len(t))
        out[own, PATH : PATH + WORD] = bag / np.maximum(np.sqrt((bag**2).sum(1)), 1)[:, None]
        out[own, PATH + WORD] = np.log1p(n) / 4
        out[own, PATH + WORD + 1] = np.log1p(t.sizes) / 8
        out[own, PATH + WORD + 2] = t.per_text(np.isin(t.buf, [0x2E, 0x21, 0x3F])) / np.maximum(n, 1)
        at += len(t)
    for i, b in enumerate(found):
        out[i, :PATH] = _path_vector(b.path)
        out[i, INPUT - 2 :] = b.linked, len(b.path) / 8
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Bidirectional LSTM with one output a block. Two sets of gate weights, one a direction."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 8) -> "Labeller":
        rng = np.random.Generator(np.random.PCG64(seed))
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.standard_normal((INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)
            w[f"h{d}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            w[f"g{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, forget, out, new; remember at first
        w["o"], w["c"] = rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _direction(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (pages, steps, HIDDEN) of one direction over x (pages, steps, INPUT)."""
        w, n = self.weights, HIDDEN
        pre = x @ w[f"x{d}"] + w[f"g{d}"]
        h = c = np.zeros((len(x), n), np.float32)
        out = np.empty((*x.shape[:2], n), np.float32)
        for t in range(x.shape[1]):
            z = pre[:, t] + h @ w[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            c_before, h_before = c, h
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            th = np.tanh(c)
            h = gates[:, 2 * n :] * th
            out[:, t] = h
            if keep is not None:
                keep.append((gates, new, c_before, h_before, th))
        return out

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """For each page the steps in reverse, padding staying behind."""
        s = np.arange(steps)
        return np.where(s < lengths[:, None], lengths[:, None] - 1 - s, s)

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of main text for each block of each page; pages of like length go together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < 256 and (stop - at + 1) * len(pages[order[stop]]) <= 16_384:
                stop += 1
            part = order[at:stop]
            x, lengths = _padded([pages[i] for i in part])
            chance = self._forward(x, lengths)[0]
            for k, i in enumerate(part):
                out[i] = chance[k, : lengths[k]]
            at = stop
        return out

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        turn = self._turned(lengths, x.shape[1])[:, :, None]
        ahead = self._direction("f", x, keep[0] if keep else None)
        back = np.take_along_axis(self._direction("b", np.take_along_axis(x, turn, 1), keep[1] if keep else None), turn, 1)
        h = np.concatenate([ahead, back], 2)
        return _sigmoid(h @ self.weights["o"] + self.weights["c"])[:, :, 0], h

    def _gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        p, h = self._forward(x, lengths, keep)
        inside = np.arange(x.shape[1]) < lengths[:, None]
        error = ((p - y) * inside / max(inside.sum(), 1)).astype(np.float32)[:, :, None]
        w, n = self.weights, HIDDEN
        g = {"o": np.einsum("pth,pto->ho", h, error), "c": error.sum((0, 1))}
        into = error * w["o"][:, 0]
        turn = self._turned(lengths, x.shape[1])[:, :, None]
        for d, seen, xs, dh_all in (("f", keep[0], x, into[:, :, :n]), ("b", keep[1], np.take_along_axis(x, turn, 1), np.take_along_axis(into[:, :, n:], turn, 1))):
            dz_all = np.empty((*x.shape[:2], 4 * n), np.float32)
            dh = dc = np.zeros((len(x), n), np.float32)
            gh = np.zeros_like(w[f"h{d}"])
            for t in range(x.shape[1] - 1, -1, -1):
                gates, new, c_before, h_before, th = seen[t]
                i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - th**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new**2)], 1)
                dz_all[:, t] = dz
                gh += h_before.T @ dz
                dh, dc = dz @ w[f"h{d}"].T, dc * f
            g[f"h{d}"] = gh
            g[f"x{d}"] = np.einsum("pti,ptg->ig", xs, dz_all, optimize=True)
            g[f"g{d}"] = dz_all.sum((0, 1))
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], *, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 9) -> "Labeller":
        """Adam on the mean cross-entropy of all blocks; pages of like length form a batch."""
        rng = np.random.Generator(np.random.PCG64(seed))
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: (len(pages[i]), i))
        parts = [order[a : a + batch] for a in range(0, len(order), batch)]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                x, lengths = _padded([pages[i] for i in parts[k]])
                y = _padded([labels[i][:, None] for i in parts[k]])[0][:, :, 0]
                # the words of some blocks are hidden, so that odd texts do not outweigh their place
                x[:, :, PATH : PATH + WORD] *= rng.random((*x.shape[:2], 1)) > 0.4
                g = self._gradients(x, lengths, y)
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                for name, v in g.items():
                    v = v * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * v
                    s[name] = 0.999 * s[name] + 0.001 * v**2
                    self.weights[name] = (self.weights[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), rows[0].shape[1]), np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def redressed(main: list[str], rest: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A new layout around the given blocks, and the texts of its main blocks.

    Most layouts name their parts in tags, classes or ids; the others have names that mean nothing, or no frame at all.
    """
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda texts, k: [texts[int(i)] for i in rng.integers(len(texts), size=k)] if texts else []
    esc = html_text.escape
    links = lambda k: "".join(f'<li><a href="/">{esc(x[:20])}</a></li>' for x in some(rest, k))
    kind = pick(["named", "named", "named", "named", "nameless", "nameless", "bare"])
    nonsense = lambda: f' {pick(["id", "class"])}="{"".join(chr(97 + int(i)) for i in rng.integers(26, size=int(rng.integers(1, 7))))}{pick(["", "1", "-2"])}"' if rng.random() < 0.9 else ""
    frame = lambda names: f' class="{pick(names)}"' if kind == "named" else nonsense()
    comments = lambda: "".join(f"<div class=comment><p>{esc(x)}x</p></div>" for x in some([m[: 20 + len(m) // 2] for m in main], 3))
    extra = [
        lambda: f'<div{frame(["sidebar", "widget", "related-posts"])}><h3>{esc(pick(rest or ["more"])[:30])}</h3><ul>{links(4)}</ul></div>',
        lambda: f"<aside>{''.join(f'<p>{esc(x)}</p>' for x in some(rest, 2))}</aside>",
        lambda: f'<div{frame(["cookie-notice", "notice", "banner"])}><p>{esc(pick(rest or ["we use cookies"]))}</p></div>',
        lambda: f'<form action="/s"><label>{esc(pick(rest or ["search"])[:20])}</label><input name="q"><button>ok</button></form>',
        lambda: f'<div{frame(["ad", "ads", "advert", "promo"])}>{esc(pick(rest or ["buy"]))}</div>',
        lambda: f'<{(t := pick(["section", "div"]))} {pick(["id", "class"])}="{pick(["comments", "comment-list", "responses"])}">{comments()}</{t}>',
    ]
    body = [_element(esc(x), pick, first=not i) for i, x in enumerate(main)]
    if len(main) > 2 and rng.random() < 0.4:
        # something that is not text inside the article
        body.insert(int(rng.integers(1, len(main))), extra[int(rng.integers(1, 4))]())
    body = "".join(body)
    if kind == "bare":
        inner = pick(["{}", "{}", "<center>{}</center>", "<div>{}</div>"]).format(body)
        around = pick(["", "", f"<p><a href=/>{esc(pick(rest or ['home'])[:25])}</a></p>", f"<ul>{links(3)}</ul>"])
        return f"<html><head><title>{esc(main[0])}</title></head><body>{around}{inner}</body></html>", {" ".join(x.split()) for x in main}
    if kind == "named":
        tag, name = pick([("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body"'), ("section", ' class="entry-content"'), ("article", ' class="story"')])
    else:
        tag, name = pick(["div", "div", "section", "td", "article"]), nonsense()
    head = pick(["", f"<header><a href=/>{esc(pick(rest or ['home'])[:25])}</a></header>", f'<div{frame(["header", "top", "masthead"])}>{esc(pick(rest or ["home"])[:25])}</div>', f'<div id="{pick(["header", "top"])}">{esc(pick(rest or ["home"])[:25])}</div>'])
    menu = pick(["<nav><ul>{}</ul></nav>", f'<div{frame(["menu", "navigation", "links"])}><ul>{{}}</ul></div>', "<nav>{}</nav>"])
    head += menu.format(links(int(rng.integers(1, 6))) if "ul" in menu else "".join(f'<a href="/">{esc(x[:20])}</a> ' for x in some(rest, int(rng.integers(1, 5)))))
    before, after = (pick(extra)() for _ in range(int(rng.integers(3)))), [pick(extra)() for _ in range(int(rng.integers(3)))]
    foot = pick(["<footer>{}</footer>", f'<div{frame(["footer", "imprint", "bottom"])}><p>{{}}</p></div>', f'<div{frame(["footer", "legal"])}>{{}}</div>', ""]).format(esc(pick(rest or ["imprint"])))
    whole = f"<{tag}{name}>{body}</{tag}>"
    if tag == "td":
        whole = f"<table><tr><td{nonsense()}><ul>{links(3)}</ul></td>{whole}</tr></table>"
    return f"<html><body>{head}{''.join(before)}{whole}{''.join(after)}{foot}</body></html>", {" ".join(x.split()) for x in main}


def _element(text: str, pick, first: bool) -> str:
    """An article's block around a text."""
    shapes = ["<h1>{}</h1>", "<h2>{}</h2>", "<h1>{}</h1>"] if first else ["<p>{}</p>"] * 6 + ["<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]
    return pick(shapes).format(text)


#: words for layouts where no page is given
_PLAIN = ("Some plain words stand here.", "A second sentence follows the first one, and it is longer.", "Home", "About us", "All rights reserved.")


def training_pages(pages: DataFrame, html: str, page_id: str, max_pages: int, max_bytes: int) -> list[str]:
    """Html of at most max_pages pages of at most max_bytes together: those with the smallest hashes of page_id."""
    rows = pages.where(F.col(html).isNotNull() & F.col(page_id).isNotNull()).select(F.col(page_id).alias("id"), F.col(html).alias("html"))
    ids = smallest_hashes(rows.select("id"), "id", max_pages).distinct()
    # of rows that repeat an id, the one with the smallest hash
    sized = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("html").alias("h"), F.octet_length("html").alias("n"))).alias("m"))
    chosen, total = [], 0
    for r in sized.orderBy(F.xxhash64("id"), "id").select("id", "m.*").collect():
        total += r["n"]
        if total > max_bytes:
            break
        chosen.append((r["id"], r["h"]))
    if not chosen:
        return []
    wanted = pages.sparkSession.createDataFrame(chosen, rows.select("id", F.lit(0).cast("long").alias("h")).schema)
    found = rows.withColumn("h", F.xxhash64("html")).join(F.broadcast(wanted), ["id", "h"]).groupBy("id").agg(F.min("html").alias("html"))
    return [r["html"] for r in found.orderBy(F.xxhash64("id"), "id").collect()]


def fit(pages: DataFrame, *, html: str = "html", page_id: str = "page_id", max_pages: int = 300, max_bytes: int = 32 << 20, layouts: int = 2, seed: int = 10) -> Labeller:
    """Train on at most max_pages pages, of max_bytes together, and about `layouts` times max_pages new layouts."""
    chosen = training_pages(pages, html, page_id, max_pages, max_bytes)
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = [], []
    for page in [*chosen, None]:
        found = blocks(page) if page is not None else []
        labels = np.array([weak_label(b.path) for b in found], np.float32)
        main, rest = ([b.text for b, k in zip(found, labels) if k == v] for v in (1, 0))
        if found and main:
            x.append(vectors(found))
            y.append(labels)
        for _ in range(layouts * -(-max_pages // max(len(chosen), 1)) if page is not None else 20):
            made, true = redressed(main[:30] or list(_PLAIN[:2]), rest[:30] or list(_PLAIN[2:]), rng)
            found = blocks(made)
            x.append(vectors(found))
            y.append(np.array([float(b.text in true and not ({w for p in b.path for w in p} & {"comment", "aside", "form"})) for b in found], np.float32))
    return Labeller.fresh().train(x, y)


def main_text(html: Column | str, labeller: Labeller) -> Column:
    """Main text of an html column."""
    weights = labeller.weights

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        model, out = Labeller(weights), []
        for at in range(0, len(column), 256):
            found = [blocks(x.as_py() or "") for x in column[at : at + 256]]
            flat = vectors([b for f in found for b in f]) if any(found) else np.empty((0, INPUT), np.float32)
            ends = np.cumsum([len(f) for f in found])
            chances = model.chances([flat[e - len(f) : e] for f, e in zip(found, ends)])
            out += ["\n".join(b.text for b, c in zip(f, p) if c > 0.5) for f, p in zip(found, chances)]
        return pa.array(out, pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, labeller: Labeller, *, html: str = "html") -> DataFrame:
    """pages with a column main_text; a column of that name is replaced."""
    return pages.withColumn("main_text", main_text(F.col(html), labeller))
