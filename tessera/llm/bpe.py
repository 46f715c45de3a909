"""Byte-level BPE by a tokenization automaton.

The automaton reads token labels and accepts exactly the sequences that BPE makes of some text. It starts as one state
with a loop for every byte. The merges are then applied one after another, each by a gadget: for the rule u v -> w, every
arc labelled u is led to a new copy of its target state that lacks the arc v, and every state with an arc u gets an arc w
to the state that v leads to. All arcs of one label lead to one state, so a state is kept as (state it was copied from,
arc it lacks, time), an arc w as (arc whose presence it follows, time), and the 50,000 gadgets take linear time and room.

Every prefix of a word is spelled by exactly one path, so reading the word byte by byte the automaton is in exactly one
state after each byte: the label that ends there. It is the longest label ending there whose arc leaves the state that was
reached where that label begins; the labels ending at a byte come from a table of byte transitions over the label trie,
longest first. So a word is encoded in one pass, without search. The transition table is filled as it is asked: whether a
state has an arc follows from the state tables. Words and arcs are remembered, both up to a bound. The words of a chunk of
texts that were not met before are encoded together, one byte position of all of them after another. Decoding emits the
byte labels of the arcs.

Defined cases: a null or empty text has no tokens. Strings of added tokens in a text become those tokens, longest first
at the leftmost place, as the tokenizers library does by default. Repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the pre-splitting pattern of byte-level BPE vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHE_ARCS, MEMO_BITS = 250_000, 400_000, 20
LONG_WORD, CHUNK_CHARS = 64, 1_000_000
BYTE_TIME, NEVER = -1, -2


@lru_cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Arcs(dict):
    """Transition table, filled as arcs are asked for: from << 32 | label -> presence; emptied when full."""

    def __init__(self, automaton: "Automaton"):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, key: int) -> bool:
        if len(self) >= CACHE_ARCS:
            self.clear()
        found = self[key] = self.automaton.arc(key >> 32, key & 0xFFFFFFFF)
        return found


class _Steps(dict):
    """Byte transitions over the label trie: node << 8 | byte -> node of the longest suffix in it; emptied when full."""

    def __init__(self, children: dict[int, int], back: array):
        super().__init__()
        self.children, self.back = children, back

    def __missing__(self, key: int) -> int:
        node, byte = key >> 8, key & 0xFF
        while (found := self.children.get(node << 8 | byte)) is None and node:
            node = self.back[node]
        if len(self) >= CACHE_ARCS:
            self.clear()
        self[key] = found or 0
        return found or 0


class _Suffixes:
    """Labels that end at a byte: `ending` is the longest one of a trie node, `shorter` the next one of a label, -1 if none."""

    def __init__(self, token: dict[bytes, int]):
        children: dict[int, int] = {}
        self.ending = array("i", [-1])
        self.size = dict(zip(token.values(), map(len, token)))
        for label, t in token.items():
            node = 0
            for byte in label:
                node = children.setdefault(node << 8 | byte, len(self.ending))
                if node == len(self.ending):
                    self.ending.append(-1)
            self.ending[node] = t
        back = array("i", bytes(4 * len(self.ending)))
        self.step = _Steps(children, back)
        self.shorter: dict[int, int] = {}
        level = [(0, key & 0xFF, node) for key, node in children.items() if key < 256]
        below: dict[int, list[tuple[int, int, int]]] = {}
        for key, node in children.items():
            below.setdefault(key >> 8, []).append((key >> 8, key & 0xFF, node))
        while level:  # shortest first, so the suffixes of a node are done before it
            for parent, byte, node in level:
                back[node] = self.step.__missing__(back[parent] << 8 | byte) if parent else 0
                rest = self.ending[back[node]]
                if (t := self.ending[node]) >= 0:
                    self.shorter[t] = rest
                else:
                    self.ending[node] = rest
            level = [x for _, _, node in level for x in below.get(node, ())]


class _Memo:
    """A table by key as arrays: a key has one place, which the last key asked for there holds."""

    def __init__(self, table: dict[int, int]):
        self.table = table
        self.keys, self.values = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, np.int32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)
        found = self.values[place]
        missed = np.flatnonzero(self.keys[place] != keys)
        if len(missed):
            asked, which = np.unique(keys[missed], return_inverse=True)
            found[missed] = np.fromiter((self.table[k] for k in asked.tolist()), np.int32, len(asked))[which]
            # of keys with one place, all write key and value in the same order
            self.keys[place[missed]], self.values[place[missed]] = keys[missed], found[missed]
        return found


@dataclass
class Automaton:
    """State tables after all gadgets. Tokens are ids; `made` is the time a token's arc appeared, BYTE_TIME for bytes."""

    labels: list[bytes]
    token: dict[bytes, int]
    follows: list[int]
    continues: list[int]
    made: list[int]
    lacks: dict[int, int]
    added: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.arcs = _Arcs(self)

    @cached_property
    def suffixes(self) -> "_Suffixes":
        return _Suffixes(self.token)

    def arc(self, u: int, t: int, before: int | None = None) -> bool:
        """Does the state that label u leads to have an arc t, after all rules or those before a time?

        A copy that lacks t was made at time lacks[u, t]. Before that, the younger of u and t decides: t was given to
        states that had the arc it follows once that time's copy was made (in a rule u u -> w, the copy lacks u and so
        gets no w), u was led to the state of the label it continues as it was before that copy.
        """
        lacks, made, follows, continues = self.lacks, self.made, self.follows, self.continues
        limit = len(lacks) + 1 if before is None else before
        while True:
            if lacks.get(u << 32 | t, limit) < limit:
                return False
            a, b = made[u], made[t]
            if a == b == BYTE_TIME:
                return True
            if b > a:
                limit, t = min(limit, b + 1), follows[t]
            else:
                limit, u = a, continues[u]

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the labels of the one path of the automaton that spells it."""
        if (whole := self.token.get(word)) is not None:
            return [whole]
        step, ending, shorter, size, arcs = self.suffixes.step, self.suffixes.ending, self.suffixes.shorter, self.suffixes.size, self.arcs
        node, reached = 0, [-1]
        for at, byte in enumerate(word, 1):
            node = step[node << 8 | byte]
            t = ending[node]
            while t >= 0 and (u := reached[at - size[t]]) >= 0 and not arcs[u << 32 | t]:
                t = shorter[t]
            if t < 0:
                raise ValueError(f"no path for {word!r}")
            reached.append(t)
        path, at = [], len(word)
        while at:
            path.append(t := reached[at])
            at -= size[t]
        path.reverse()
        return path

    @cached_property
    def tables(self) -> tuple[_Memo, _Memo, np.ndarray, np.ndarray, np.ndarray]:
        """The tables that `encode` walks, as arrays: steps, arcs, ending, shorter, size."""
        shorter, size = np.full(len(self.labels), -1, np.int32), np.zeros(len(self.labels), np.int64)
        for table, filled in ((self.suffixes.shorter, shorter), (self.suffixes.size, size)):
            filled[list(table)] = list(table.values())
        return _Memo(self.suffixes.step), _Memo(self.arcs), np.array(self.suffixes.ending), shorter, size

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """`encode` for many short words, none empty, as little-endian 32-bit integers."""
        step, arcs, ending, shorter, size = self.tables
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-n, kind="stable")
        start, length = (np.cumsum(n) - n)[order], n[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        reached = np.full((length[0] + 1, len(words)), -1, np.int32)
        node = np.zeros(len(words), np.int64)
        for at in range(1, length[0] + 1):
            rows = np.arange(np.searchsorted(-length, -at, "right"))  # the words with so many bytes
            node = step[node[: len(rows)] << 8 | data[start[: len(rows)] + at - 1]].astype(np.int64)
            t = ending[node]
            while len(rows):
                if (t < 0).any():
                    raise ValueError(f"no path for {words[order[rows[t < 0][0]]]!r}")
                u = reached[at - size[t], rows].astype(np.int64)
                fits = u < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = arcs[u[inner] << 32 | t[inner]] != 0
                reached[at, rows[fits]] = t[fits]
                rows, t = rows[~fits], shorter[t[~fits]]
        paths, at, rows = [], length.copy(), np.arange(len(words))
        while len(rows):
            t = reached[at[rows], rows]
            paths.append((rows, t))
            at[rows] -= size[t]
            rows = rows[at[rows] > 0]
        count = np.zeros(len(words), np.int64)
        for rows, _ in paths:
            count[rows] += 1
        end = np.cumsum(count)
        ids = np.empty(count.sum(), "<u4")
        for back, (rows, t) in enumerate(paths, 1):
            ids[end[rows] - back] = t
        raw, out = ids.tobytes(), [b""] * len(words)
        for word, a, b in zip(order.tolist(), (4 * (end - count)).tolist(), (4 * end).tolist()):
            out[word] = raw[a:b]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Byte labels of the arcs, one after another."""
        labels = self.labels
        return b"".join([labels[i] for i in ids.tolist()])


def compile_automaton(path: str) -> Automaton:
    """Build the automaton from a tokenizers JSON file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level BPE tokenizer without a prefix space is needed")
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    n = max([*vocab.values(), *added.values()]) + 1
    labels = [b""] * n
    for text, i in vocab.items():
        if text not in added:
            labels[i] = bytes(letters[c] for c in text)
    for text, i in added.items():
        labels[i] = text.encode()
    follows, continues, made = [0] * n, [0] * n, [NEVER] * n
    for letter in letters:
        if letter in vocab:
            made[vocab[letter]] = BYTE_TIME
    lacks: dict[int, int] = {}
    for time, rule in enumerate(spec["model"]["merges"]):
        left, right = rule.split(" ") if isinstance(rule, str) else rule
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        # the gadget: label u now leads to a copy without the arc v; w follows u's arcs and leads where v leads
        lacks[u << 32 | v] = time
        if made[w] == NEVER:
            follows[w], continues[w], made[w] = u, v, time
    token = {labels[i]: i for t, i in vocab.items() if t not in added and made[i] != NEVER}
    out = Automaton(labels, token, follows, continues, made, lacks, added)
    # a token whose own bytes are tokenized otherwise is on no path
    for label, w in [(label, w) for label, w in token.items() if made[w] >= 0]:
        if not out.arc(follows[w], continues[w], made[w]):
            del token[label]
    return out


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.recent: dict[str, bytes] = {}  # short words and their ids; when full, those not met since it was last full go
        self.older: dict[str, bytes] = {}
        self.words = regex.compile(PATTERN).findall
        added = sorted(automaton.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def split(self, text: str) -> list[str]:
        """Pre-split words and the strings of added tokens."""
        if self.added is None or not any(a in text for a in self.automaton.added):
            return self.words(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:])

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, little-endian 32-bit; the words not remembered are encoded together."""
        automaton, recent, older = self.automaton, self.recent, self.older
        out, new = {}, []
        for w in words:
            if (found := recent.get(w) or older.get(w)) is not None:
                out[w] = found
            elif w in automaton.added:  # a word that is an added token's string can be nothing else
                out[w] = np.array([automaton.added[w]], "<u4").tobytes()
            elif len(w) < LONG_WORD:
                new.append(w)
            else:
                out[w] = np.array(automaton.encode(w.encode()), "<u4").tobytes()
        if new:
            out.update(zip(new, automaton.encode_many([w.encode() for w in new])))
        if len(recent) + len(out) > CACHE_WORDS // 2:
            self.older, self.recent = recent, {}
        self.recent.update((w, ids) for w, ids in out.items() if len(w) < LONG_WORD)
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, little-endian 32-bit, chunk by chunk of texts."""
        chunk, chars = [], 0
        for text in chain(texts, [None]):
            if text is None or chars >= CHUNK_CHARS:
                ids = self.ids_of(set().union(*chunk)).__getitem__
                yield from (b"".join(map(ids, words)) for words in chunk)
                chunk, chars = [], 0
            if text is not None:
                chunk.append(self.split(text))
                chars += len(text)

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(compile_automaton(path))
    return _encoders[path]


def encode(text: Column | str, path: str) -> Column:
    """Token ids of a text column as array<int>."""

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        e = encoder(path)
        ids = list(e.encode_all(x.as_py() or "" for x in column))
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return encoded(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of a column of token ids (array<int>); null stays null."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([e.decode(np.array(x.as_py(), "<u4").tobytes()) if x.is_valid else None for x in column], pa.string())

    return decoded(ids)


def digests(text: Column | str, path: str) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256: encodes each whole text and decodes its ids again."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digested(column: pa.Array) -> pa.Array:
        e, rows = encoder(path), ([], [], [])
        for ids in e.encode_all(x.as_py() or "" for x in column):
            rows[0].append(len(ids) // 4)
            rows[1].append(hashlib.sha256(ids).hexdigest())
            rows[2].append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(v, k.type) for v, k in zip(rows, kind)], fields=list(kind))

    return digested(text)
