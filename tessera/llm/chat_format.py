r"""Conversations as training text, with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into blocks by array
aggregation, and blocks are concatenated:

    ### user:
    text of a turn
    </turn>
    text of the user's next turn
    </turn>
    ### assistant:
    ...

A turn ends with a line `</turn>`; a block opens with a line that names the role (percent-encoded). Inside texts a backslash goes
before every backslash, every `#` that two more follow and every `<` that `/turn>` follows, so no control string occurs in a
text and formatted text can be read back exactly.

`mask` has an entry for each turn: `skip` characters that are not trained, then `take` that are; the turn's end follows,
which is not trained. Characters are code points of the formatted text.

Everything is one shuffle of the turns; sizes, masks and merging are linear in a conversation's length. A conversation has
to fit a row, as its formatted text does.

Defined cases: rows are ordered by turn (nulls first), then role and text, so ties and repeated rows are all kept in a fixed
order. A null text or role counts as empty. A null conversation id is a conversation of its own. Further columns of the
input are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
OPEN = "### "
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """A text without control strings."""
    return F.regexp_replace(text, r"\\|#(?=##)|<(?=/turn>)", r"\\$0")


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def _heading(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(":\n"))


def _stretches(df: DataFrame, items: str, opens: Callable[[Column], Column], made: Callable[[Column], Column], name: str) -> DataFrame:
    """df with an array of made(stretch), an array column being cut before each index for which opens(index) holds."""
    item = F.col(items)
    cut = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size(item) - 1), opens))
    until = lambda k: F.coalesce(F.get("_starts", k + 1), F.size(item))
    return cut.withColumn(name, F.transform("_starts", lambda s, k: made(F.slice(item, s + 1, until(k) - s)))).drop("_starts")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and mask for rows of conv_id, turn, role and text."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    role = lambda i: F.get("_t", i)["role"]
    block = lambda rows: F.struct(F.get(rows, F.lit(0))["role"].alias("role"), F.transform(rows, lambda x: escaped(x["text"])).alias("texts"))
    merged = _stretches(sorted_turns, "_t", lambda i: (i == 0) | (role(i) != role(i - 1)), block, "_blocks")

    def entry(b: Column, x: Column, i: Column) -> Column:
        head, size = F.when(i == 0, F.char_length(_heading(b["role"]))).otherwise(0), F.char_length(x)
        own = b["role"] == TRAINED
        return F.struct(F.when(own, head).otherwise(head + size).alias("skip"), F.when(own, size).otherwise(0).alias("take"))

    text = F.transform("_blocks", lambda b: F.concat(_heading(b["role"]), F.array_join(F.transform(b["texts"], lambda x: F.concat(x, F.lit(END))), "")))
    mask = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda x, i: entry(b, x, i))))
    return merged.select("conv_id", F.array_join(text, "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text) and trained (the text under the mask), from formatted text and mask."""
    pieces = F.split("formatted", END)
    cut = formatted.select("conv_id", "formatted", "mask", F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("_p"))
    title = r"^### ([^:]*):\n"
    block = lambda rows: F.struct(F.url_decode(F.regexp_extract(F.get(rows, F.lit(0)), title, 1)).alias("role"), F.transform(rows, lambda x, i: F.when(i == 0, F.regexp_replace(x, title, "")).otherwise(x)).alias("texts"))
    blocks = _stretches(cut, "_p", lambda i: F.startswith(F.get("_p", i), F.lit(OPEN)), block, "_blocks")
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescaped(x).alias("text")))))
    trained = F.array_join(F.zip_with("_p", "mask", lambda p, m: unescaped(F.substring(p, m["skip"] + 1, m["take"]))), "")
    return blocks.select("conv_id", "formatted", turns.alias("turns"), trained.alias("trained"))


def format_digest(turns: DataFrame) -> DataFrame:
    """Per conversation digests of its turns and of its trained text, both read back from the formatted text."""
    read = read_back(format_conversations(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    size = lambda c: F.char_length(c).cast("long")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        size("trained").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        size("formatted").alias("formatted_chars"),
    )
