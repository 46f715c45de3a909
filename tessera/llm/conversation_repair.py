"""Structure repair of conversations: alignment of turns with an alternating grammar.

A conversation should read `(s?(ua)+)?` in role initials: an optional system turn, then user and assistant in turn. Its turns are
aligned with the grammar's string of each feasible length by the Wagner-Fischer program: keep costs 0, a new role (user or
assistant) 3, deletion 4 (the only choice for blank and duplicate turns), insertion of an empty turn 3, and a turn that stays
truncated 3 more. Grammar strings of all lengths share their ends, so one table over (turn, symbols left) holds the alignments
with all of them; a string with a system turn is one of those after a kept system turn. The table is filled in Ukkonen's band: a
narrow one gives an incumbent cost, which bounds how many insertions and deletions any alignment as cheap can have, and so the
band of the final table. Of the cheapest alignments of every length the audits (the edits' initials D, I, K, R) are traced back
and compared, and the least in ASCII order is taken; it fixes the repaired turns.

Faults, sorting, counts and the repaired texts are Spark expressions; the program itself is an Arrow UDF that sees one letter a
turn. One shuffle by conversation. Memory: a conversation fits a row; the table has its turns times the band.

Defined cases: turns are ordered by turn (nulls first), then role and text. A null text or role counts as one space (so the
turn is blank, or has no known role). A null conversation id is a conversation of its own. Repeated rows are duplicates. Roles
count by their first letter. Further columns are left out. An empty table gives an empty result; a conversation of dropped
turns alone has zeros, an empty audit and no turns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ALIGNED = "cost bigint, audit string, steps array<struct<row: int, role: string>>"
FAR = 1 << 40
NARROW = 3


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by a checksum of `conv_id:turn`; dropped ones stay, marked in a column `dropped`."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(code == 4, "user").otherwise(plain("role"))
    row = F.struct("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("dropped"))
    return turns.select(F.explode(F.array_repeat(row, F.when(code == 3, 2).otherwise(1))).alias("row")).select("row.*")


def _user(left: np.ndarray | int):
    """Is the grammar's symbol with so many left (itself included) a user's?"""
    return left % 2 == 0


def _table(turns: str, low: int, high: int) -> tuple[np.ndarray, list[int]]:
    """Least cost of turns i.. against the last r symbols, at [i, r - base[i]], for r within `low` under to `high` over the
    turns left that may stay."""
    width, n = low + high + 1, len(turns)
    base = [0] * (n + 1)
    base[n] = -low
    for i in range(n - 1, -1, -1):
        base[i] = base[i + 1] + (turns[i] != "x")
    offset = np.arange(width)
    table = np.full((n + 1, width), FAR, np.int64)
    table[n] = np.where(offset >= low, INSERT * (offset - low), FAR)
    for i in range(n - 1, -1, -1):
        after, r = table[i + 1], base[i] + offset
        if turns[i] == "x":
            row = after + DELETE
        else:
            kind = turns[i].lower()
            fits = _user(r) if kind == "u" else ~_user(r) if kind == "a" else np.zeros(width, bool)
            row = after + np.where(fits, 0, REROLE) + (TRUNCATED if turns[i].isupper() else 0)
            row[:-1] = np.minimum(row[:-1], after[1:] + DELETE)
        row[r < 0] = FAR
        table[i] = np.minimum(np.minimum.accumulate(row - INSERT * offset) + INSERT * offset, FAR)
    return table, base


def _best(turns: str, table: np.ndarray, base: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost over all lengths, and its alignments as (index of the kept system turn or -1, symbols after it)."""
    width = table.shape[1]
    cost, found = FAR, []

    def offer(start: int, least: int, spent: int) -> None:
        nonlocal cost, found
        row = start + 1
        r = base[row] + np.arange(width)
        own = np.where((r >= least) & (r % 2 == 0), table[row] + spent, FAR)
        low = int(own.min())
        if low < cost:
            cost, found = low, []
        if low == cost < FAR:
            found += [(start, int(x)) for x in r[own == low]]

    offer(-1, 0, 0)
    spent = 0
    for i, t in enumerate(turns):
        if t in "sS":
            offer(i, 2, spent + (TRUNCATED if t == "S" else 0))
        spent += DELETE
        if spent > cost:
            break
    return cost, found


def _trace(turns: str, table: np.ndarray, base: list[int], i: int, r: int) -> str:
    """The ASCII-least cheapest edits of turns i.. against the last r symbols."""
    width, out = table.shape[1], []

    def at(i: int, r: int) -> int:
        o = r - base[i]
        return int(table[i, o]) if r >= 0 and 0 <= o < width else FAR

    n = len(turns)
    while i < n or r:
        here = at(i, r)
        if i < n and at(i + 1, r) + DELETE == here:
            out.append("D")
            i += 1
        elif r and at(i, r - 1) + INSERT == here:
            out.append("I")
            r -= 1
        else:
            out.append("K" if turns[i].lower() == ("u" if _user(r) else "a") else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def _band(turns: str, cost: int) -> tuple[int, int]:
    """Most deletions and insertions, beside what must be, that an alignment of this cost can have."""
    cut = sum(t.isupper() for t in turns)
    spare = cost - DELETE * turns.count("x") - TRUNCATED * cut
    cheap = min(cut, spare // (DELETE - TRUNCATED))
    return cheap + (spare - cheap * (DELETE - TRUNCATED)) // DELETE, spare // INSERT


def align(turns: str) -> tuple[int, str]:
    """Cost and audit for turns given by letters: s, u, a, o (other role), upper case where truncated, x where it has to go."""
    low, high = NARROW, NARROW
    while True:
        table, base = _table(turns, low, high)
        cost, found = _best(turns, table, base)
        need = _band(turns, cost)
        if need[0] <= low and need[1] <= high:
            break
        low, high = max(low, need[0]), max(high, need[1])
    return cost, min("D" * s + "K" * (s >= 0) + _trace(turns, table, base, s + 1, r) for s, r in found)


@lru_cache(maxsize=50_000)
def _short(turns: str) -> tuple[int, str]:
    return align(turns)


def repaired_turns(audit: str) -> list[tuple[int | None, str | None]]:
    """(index of the turn or null for an inserted one, new role or null where it stays) of each turn after the edits."""
    left, row, out = sum(c != "D" for c in audit), 0, []
    for c in audit:
        if c != "D":
            role = None if c == "K" else "user" if _user(left) else "assistant"
            out.append((None if c == "I" else row, role))
            left -= 1
        row += c != "I"
    return out


def alignment(letters: Column) -> Column:
    """Struct of cost, audit and steps (index of the turn, new role) for a column of turns given by letters."""

    @F.arrow_udf(ALIGNED)
    def run(column: pa.Array) -> pa.Array:
        made = [_short(x) if len(x) <= 40 else align(x) for x in column.to_pylist()]
        steps = [[{"row": r, "role": x} for r, x in repaired_turns(audit)] for _, audit in made]
        kind = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
        return pa.StructArray.from_arrays([pa.array([c for c, _ in made], pa.int64()), pa.array([a for _, a in made], pa.string()), pa.array(steps, kind)], ["cost", "audit", "steps"])

    return run(letters)


def repair_conversations(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, counts of faults, cost and audit of the repair, and the repaired turns (role and text).

    Rows for which `dropped` holds are no turns, but keep their conversation in the result.
    """
    filled = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select("conv_id", "turn", filled(F.col("role")).alias("role"), filled(F.col("text")).alias("text"), F.coalesce(F.lit(False) if dropped is None else dropped, F.lit(False)).alias("_gone")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "_gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    body = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("_again", F.row_number().over(same) > 1).withColumn("_end", F.substring(body, -1, 1))
    blank, again, cut = F.col("_end") == "", F.col("_again"), ~F.col("_end").isin(".", "!", "?")
    initial = lambda c: F.substring(c, 1, 1)
    kind = F.when(initial("role").isin("s", "u", "a"), initial("role")).otherwise("o")
    letter = F.when(blank | again, "x").when(cut, F.upper(kind)).otherwise(kind)
    here = ~F.col("_gone")
    times = lambda c: F.coalesce(F.sum(F.when(here & c, 1)), F.lit(0)).cast("long")
    item = F.when(here, F.struct("turn", "role", "text", "_again", letter.alias("letter")))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_t"), times(blank).alias("blank"), times(~blank & again).alias("duplicate"), times(~blank & ~again & cut).alias("truncated"))

    number = F.filter("_t.turn", lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.concat(initial(a["role"]), initial(b["role"])))
    marked = found.withColumn("_n", number).withColumn("_a", alignment(F.array_join("_t.letter", "")))
    gaps = F.coalesce(F.array_max("_n") - F.array_min("_n") + 1 - F.size(F.array_distinct("_n")), F.lit(0)).cast("long")
    kept = lambda s: F.get("_t", s["row"])
    made = F.transform("_a.steps", lambda s: F.struct(F.coalesce(s["role"], kept(s)["role"]).alias("role"), F.coalesce(kept(s)["text"], F.lit("")).alias("text")))
    return marked.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"), "_a.cost", "_a.audit", made.alias("repaired"))


def repair_digest(turns: DataFrame) -> DataFrame:
    """The contract's columns: conversations are damaged, then repaired."""
    made = repair_conversations(damaged(turns), F.col("dropped"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return made.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
