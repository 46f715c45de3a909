"""Chat formatting, periodic runs and conversation repair on odd rows, against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, conversation_repair, periodic_runs
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
ODD_TURNS = [
    (1, 0, "user", "a \\ b"), (1, 1, "assistant", "####\n</turn>\n### user:\nx"), (1, 2, "assistant", None), (1, 3, "user", ""),
    (2, 0, "assistant", "### assistant:\n"), (2, 0, "assistant", "### assistant:\n"), (2, None, "system", "\\</turn>\\"), (2, 5, None, "tail\n"),
    (None, 1, "user", "x" * 200_000), (None, 0, "a:b\n### c", "\n</turn>\n"), (3, 9, "", " "), (4, 0, "assistant", "\\### Assistant: </turn> ok"), (4, 1, "assistant", "é漢\U0001f600"),
    *[(5, i, "user" if i % 3 else "assistant", f"turn {i} \\#") for i in range(700)],
]


def clashing(df):
    """df with further columns whose names clash with working columns."""
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(("_t", "rows", "mask", "_n", "_gone", "dropped", "made", "runs", "letter", "turns"))])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_conversation(rows):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    return {k: list(g) for k, g in groupby(sorted(rows, key=order), key=lambda r: r[0])}


@pytest.mark.parametrize("parts", [1, 7])
def test_chat_reads_back(spark, parts):
    df = clashing(spark.createDataFrame(ODD_TURNS, TURNS)).repartition(parts)
    made = {r.conv_id: r for r in chat_format.format_digest(df).collect()}
    held = by_conversation([(c, t, r or "", x or "") for c, t, r, x in ODD_TURNS])
    assert made.keys() == held.keys()
    for k, turns in held.items():
        trained = "".join(x for *_, r, x in turns if r == "assistant")
        assert made[k].n_turns == len(turns)
        assert made[k].turns_sha256 == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert (made[k].loss_chars, made[k].loss_sha256) == (len(trained), sha(trained))


def test_chat_text_is_as_stated(spark):
    df = spark.createDataFrame([(1, 1, "user", "b###"), (1, 0, "user", "a"), (1, 2, "assistant", "</turn>"), (2, 0, "assistant", "x")], TURNS)
    made = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert made[1].formatted == "### user:\na\n</turn>\nb\\###\n</turn>\n### assistant:\n\\</turn>\n</turn>\n"
    at, taken = 0, []
    for m in made[1]["mask"]:
        taken.append(made[1].formatted[at + m.skip : at + m.skip + m["take"]])
        at += m.skip + m["take"] + len(chat_format.END)
    assert at == len(made[1].formatted) and taken == ["", "", "\\</turn>"]
    assert chat_format.format_digest(df.limit(0)).collect() == []


def test_chat_needs_no_python_on_executors(spark):
    plan = QUERIES["op11_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def plain_runs(words, least=24, power=3):
    """Every lag tried over the whole text; stretches that a smaller lag gives too are left out."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    kind, words = rng.randrange(5), []
    for _ in range(rng.randrange(1, 7)):
        if rng.random() < 0.5:
            words += [str(rng.randrange(2 if kind == 1 else 50)) for _ in range(rng.randrange(40))]
        else:
            block = [str(rng.randrange(3)) for _ in range(rng.randrange(1, 30))]
            if kind == 2:
                block = ["x"] * rng.randrange(1, 45) + ["y"] * rng.randrange(1, 3)
            words += (block * rng.randrange(2, 9))[: rng.randrange(10, 260)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(500):
        words = random_words(rng)
        held = plain_runs(words)
        assert periodic_runs.find_runs([w.encode() for w in words]) == held
        seen += len(held)
    assert seen > 500
    assert periodic_runs.find_runs([b"x"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.shortest_match(24, 3) == 16


def test_other_bounds_of_runs():
    rng = random.Random(6)
    for _ in range(200):
        words = random_words(rng)
        for least, power in ((6, 2), (10, 4), (1, 2)):
            assert periodic_runs.find_runs([w.encode() for w in words], least, power) == plain_runs(words, least, power)


def held_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, gone, best = plain_runs(words), set(), None
    for s, m, q in runs:
        gone |= set(range(s + q, s + m))
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    made = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, SF).collect()))
    held = sorted((held_runs(r.doc_id, r.text) for r in docs), key=lambda r: r[0])
    assert made == held
    assert sum(r[1] > 0 for r in held) > 5


def test_run_digest_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 40), (3, " \t\n "), (4, "word " * 20_000), (4, "word " * 20_000), (5, "é \x0b" * 30), (6, "one"), *[(i, " ".join(map(str, range(i)))) for i in range(10, 200)]]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    small = [r for r in rows if len(r[1] or "") < 10_000]
    made = sorted(map(tuple, periodic_runs.run_digest(df.where("coalesce(length(text), 0) < 10000")).collect()), key=key)
    assert made == sorted((held_runs(*r) for r in small), key=key)
    long = periodic_runs.run_digest(df.where("doc_id = 4")).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed_sha256) for r in long] == [(1, 0, 20_000, 1, 20_000_000, sha("word"))] * 2
    assert periodic_runs.run_digest(df.limit(0)).collect() == []


def plain_repair(turns):
    """Cheapest edits by a search over (turn, state of the grammar): 0 start, 1 a user is due after a system turn, 2 a user is
    due or the end, 3 an assistant is due."""

    @lru_cache(None)
    def best(i, state, room):
        """(cost, audit) of turns i.. with at most `room` insertions in a row from here."""
        options = [(0, "")] if i == len(turns) and state in (0, 2) else []
        due, after = ("a", 2) if state == 3 else ("u", 3)
        if room:
            options.append(plus(3, "I", best(i, after, room - 1)))
        if i < len(turns):
            role, fault = turns[i]
            options.append(plus(4, "D", best(i + 1, state, 3)))
            if fault not in ("blank", "duplicate"):
                own = 3 * (fault == "truncated")
                options.append(plus(own + 3 * (role != due), "K" if role == due else "R", best(i + 1, after, 3)))
                if state == 0 and role == "s":
                    options.append(plus(own, "K", best(i + 1, 1, 3)))
        return min(options, default=(10**9, ""))

    def plus(cost, letter, rest):
        return cost + rest[0], letter + rest[1]

    for i in range(len(turns), 0, -1):  # from the end, so that no call goes deep
        for state in range(4):
            best(i, state, 3)
    cost, audit = best(0, 0, 3)
    best.cache_clear()
    return cost, audit


def test_alignment_equals_brute_force():
    rng = random.Random(7)
    kinds = {"x": "blank"}
    for n in [*range(9)] * 120 + [40] * 20:
        text = "".join(rng.choice("suaSUAxo" if n < 20 else "uuaaUAxso") for _ in range(n))
        held = plain_repair([(c.lower(), kinds.get(c, "truncated" if c.isupper() else "")) for c in text])
        assert conversation_repair.align(text) == held, text


def held_repair(rows):
    """One conversation's (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role[:1], fault))
    cost, audit = plain_repair(turns)
    out, i, left = [], 0, sum(c != "D" for c in audit)
    for c in audit:
        if c != "D":
            new = "user" if left % 2 == 0 else "assistant"
            out.append(f"{rows[i][1] if c == 'K' else new}:{rows[i][2] if c != 'I' else ''}")
            left -= 1
        i += c != "I"
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:])]
    return (gaps, *(sum(f == k for _, f in turns) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(out)))


def held_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repair_equals_brute_force(spark, parts):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice(["a.", "b!", "c", " \n", "", None, "d? \t", "é.\u00a0"])) for _ in range(400)]
    rows += rows[:30] + [(1000, i, ("user", "assistant")[i % 2], "Said.") for i in range(40)] + [(1001, i, ("user", "assistant")[i % 2], f"Said {i}.") for i in range(1, 300)]
    rows += [(i, 0, "user", "x.") for i in range(2000, 2040)]
    made = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_digest(clashing(spark.createDataFrame(rows, TURNS)).repartition(parts)).collect()}
    held = {k: held_repair(v) for k, v in held_damage(rows).items()}
    assert made == held
    assert (0, 0, 0, 0, 0, 0, "", sha("")) in held.values()


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    made = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert made == {k: held_repair(v) for k, v in held_damage(rows).items()}
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair_digest(empty).collect() == []
