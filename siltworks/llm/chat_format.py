"""Chat formatting: turns of a conversation to one training string, with Spark expressions only.

Turns are sorted by (turn, role, text), collected as structs in two steps
(slices of ``slice_turns`` turn numbers first, then the slices of a
conversation), adjacent turns of one role are merged into one block, and the
blocks are concatenated::

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

``<|im_sep|>`` stands between merged turns, so merging is reversible.  Control
strings inside roles and texts are escaped: each ``<``, backslashes, ``|`` gets
one backslash more, hence no escaped text contains ``<|``.

Defined cases: null role or text is empty; a null turn sorts first; repeated
rows stay as repeated turns; ties on turn are broken by role, then text; rows
with null conv_id form one conversation; an empty table gives no rows; further
columns are ignored.  A conversation is one output row, so its string must fit
one; that is the only thing gathered by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
SLICE_TURNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role must also hold no line break, which ends it."""
    return F.replace(F.replace(escape(role), F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~")))


def merge_runs(items: Column) -> Column:
    """Merge neighbours of one role in an array of struct<role, texts: array>."""
    same = lambda i: F.get(items, i)["role"] == F.get(items, i - 1)["role"]
    every = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(every, lambda i: (i == 0) | ~same(i))

    def block(first: Column, k: Column, starts: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(items))
        run = F.slice(items, first + 1, end - first)
        return F.struct(F.get(items, first)["role"].alias("role"), F.flatten(F.transform(run, lambda x: x["texts"])).alias("texts"))

    # `starts` is bound once by a one-element transform, so it isn't worked out for each block.
    return F.flatten(F.transform(F.array(firsts), lambda starts: F.transform(starts, lambda first, k: block(first, k, starts))))


def segments_of(blocks: Column, loss_roles: tuple[str, ...]) -> Column:
    """array<struct<text, loss>> whose texts concatenate to the formatted string."""
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of(b: Column) -> Column:
        trained = b["role"].isin(*loss_roles)
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.when(i == 0, F.array(seg(escape(t), trained))).otherwise(F.array(seg(F.lit(SEP), no), seg(escape(t), trained)))))
        return F.concat(F.array(seg(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")), no)), texts, F.array(seg(F.lit(f"{END}\n"), no)))

    return F.flatten(F.transform(blocks, of))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """conv_id, formatted, segments (the loss mask: pieces of ``formatted``, trained on or not)."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sliced = rows.groupBy("conv_id", F.floor(F.col("turn") / slice_turns).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    items = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    runs = sliced.withColumn("items", items).select("conv_id", "slice", merge_runs(F.col("items")).alias("runs"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "runs"))).alias("slices"))
    blocks = whole.select("conv_id", F.flatten(F.transform("slices", lambda s: s["runs"])).alias("items")).select("conv_id", merge_runs(F.col("items")).alias("blocks"))
    out = blocks.select("conv_id", segments_of(F.col("blocks"), loss_roles).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b.startswith(START))

    def of(b: Column) -> Column:
        body = F.substring(b, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(role) + 2), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Read the formatted output back and sum it up by conversation."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
