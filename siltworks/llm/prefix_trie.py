"""Prefix tree of conversations by partition refinement.

All conversations start in one class, the root.  A round takes the next turns of the
conversations whose class still has other members and splits their classes turn by
turn: a class is told by the chained digest of its turns, counted with partial sums, and
named after its least member.  A class of one conversation is retired: the rest
of that conversation is a chain that nobody shares, so it is emitted from the number of
its turns alone, without touching them.  Rounds take 4, 8, 16, ... and at most 256 turns, so
their number grows with the logarithm of the depth that is shared, up to 252 turns.

Shared nodes are then folded back: what a node adds to the sums of its subtree is passed to its
ancestors 1, 2, 4, ... levels up, again a logarithm of rounds; the retired chains
are one child and one leaf of the node that they hang on.

Only digests, counts and ids are shuffled, no texts.  A conversation is gathered in slices
of at most 256 digests; ids that end at a node are gathered in slices of
``ID_SLICE`` and their digest is taken from the slices as a stream.

Defined cases: null roles and texts are empty; a null turn sorts first, and
turns of one number by their digest; repeated rows are repeated turns; rows without conv_id belong to
no conversation; further columns are ignored; without conversations there are no nodes, not
even a root.  Turns are equal if their SHA-256 digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import cut, words

#: Turns of the first slice, and of the largest.
FIRST, MOST = 4, 256
#: Numbers of conversations whose ids are gathered in one row.
ID_SLICE = 4096
DOUBLING = (MOST // FIRST).bit_length() - 1  # slices before those of MOST turns
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key (digest of role and text), words (of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.size(words(text)).cast("long").alias("words"))


def numbered(keyed: DataFrame) -> DataFrame:
    """The turns with their ``depth``, from 1 on."""
    return keyed.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")))


def _slice_of(depth: Column) -> Column:
    """0 for the first FIRST turns, 1 for twice as many after them, and so on; from DOUBLING on, MOST turns each."""
    doubling = F.length(F.bin(depth + FIRST - 1)) - FIRST.bit_length()
    return F.when(depth <= _last(DOUBLING - 1), doubling).otherwise(DOUBLING + F.floor((depth - 1 - _last(DOUBLING - 1)) / MOST)).cast("int")


def _last(s: int) -> int:
    """The last depth of slice s."""
    return FIRST * (2 ** (s + 1) - 1) if s < DOUBLING else _last(DOUBLING - 1) + MOST * (s - DOUBLING + 1)


def _chain(start: Column, turns: Column) -> Column:
    """For each of the turns: its class, the class before it, its depth and words."""
    empty = F.array().cast("array<struct<class: binary, parent: binary, depth: int, words: bigint>>")

    def grow(state: Column, t: Column) -> Column:
        made = F.unhex(F.sha2(F.concat(state["class"], t["key"]), 256))
        one = F.struct(made.alias("class"), state["class"].alias("parent"), t["depth"].alias("depth"), t["words"].alias("words"))
        return F.struct(made.alias("class"), F.array_append(state["out"], one).alias("out"))

    return F.aggregate(turns, F.struct(start.alias("class"), empty.alias("out")), grow, lambda s: s["out"])


def _refine(sliced: DataFrame, convs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes of at least two members; and for each conversation and round, the deepest such node that it reached."""
    active, nodes, reached, s = convs.select("conv_id", F.lit(b"").alias("class")), [], [], 0
    while True:
        stretch = active.join(sliced.filter(F.col("slice") == s).select("conv_id", "turns"), "conv_id")
        step = cut(stretch.select("conv_id", F.explode(_chain(F.col("class"), F.col("turns"))).alias("t")).select("conv_id", "t.*"))
        counted = step.groupBy("class").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.min("conv_id").alias("least"), F.count("*").alias("n_convs"))
        shared = cut(counted.filter("n_convs > 1"))
        deepest = F.max(F.struct("depth", "class", "least"))
        got = cut(step.select("conv_id", "class").join(shared.select("class", "depth", "least"), "class").groupBy("conv_id").agg(deepest.alias("at")).select("conv_id", "at.*"))
        nodes.append(shared)
        reached.append(got)
        active = got.filter(F.col("depth") == _last(s)).select("conv_id", "class")
        if active.isEmpty():
            return reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, reached)
        s += 1


def _fold(nodes: DataFrame) -> DataFrame:
    """class, leaves, saved: summed over subtrees, by ancestors at doubling distances."""
    held = cut(nodes.select("class", F.col("parent").alias("up"), "leaves", "saved"))
    while not held.filter("up is not null").isEmpty():
        more = held.filter("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "class")
        above = held.select(F.col("class").alias("up"), F.col("up").alias("next"))
        summed = held.join(more, "class", "left").join(above, "up", "left")
        held = cut(summed.select("class", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    return held.select("class", "leaves", "saved")


def _hash_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the sorted slices of each class; a class may go on from batch to batch."""
    open_, state = None, None
    for batch in batches:
        done = []
        for c, ids in zip(batch.column("class"), batch.column("ids"), strict=True):
            c, ids = c.as_py(), ids.as_py().encode()
            if c == open_:
                state.update(b"," + ids)
            else:
                if state is not None:
                    done.append((open_, state.hexdigest()))
                open_, state = c, hashlib.sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["class", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["class", "ends"])


def _ends(ending: DataFrame) -> DataFrame:
    """class, ends: the digest of the ascending ids of the conversations that end at a node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    slices = cut(ending.groupBy("class", F.floor(F.col("conv_id") / ID_SLICE).alias("part")).agg(ids.alias("ids")))
    parts = slices.groupBy("class").agg(F.count("*").alias("parts"), F.min(F.struct("part", "ids"))["ids"].alias("ids"))
    one = parts.filter("parts = 1").select("class", F.sha2("ids", 256).alias("ends"))
    many = slices.join(parts.filter("parts > 1").select("class"), "class").repartition("class").sortWithinPartitions("class", "part")
    return one.unionAll(many.select("class", "ids").mapInArrow(_hash_slices, "class binary, ends string"))


def prefix_trie(keyed: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One row a node, from the rows of ``turn_keys``; ``also``: conv_ids that count even without turns.

    conv_id (least member), depth, parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens
    (over the subtree), ends_sha256 (of the members that end here).
    """
    turns = numbered(keyed).withColumn("slice", _slice_of(F.col("depth")))
    sliced = cut(turns.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "words"))).alias("turns")))
    sizes = sliced.select("conv_id", F.size("turns").cast("long").alias("n"))
    if also is not None:
        sizes = sizes.unionAll(also.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n")))
    convs = cut(sizes.groupBy("conv_id").agg(F.sum("n").alias("n_turns")))
    top = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs")).withColumn("class", F.lit(b""))
    nodes, reached = _refine(sliced, convs)
    root = top.filter("n_convs > 0").select("class", F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("words"), "least", "n_convs")
    nodes = nodes.unionAll(root)
    deepest = reached.groupBy("conv_id").agg(F.max(F.struct("depth", "class", "least")).alias("at")).select("conv_id", "at.*")
    least = top.first()["least"]
    placed = cut(convs.join(deepest, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("class", F.lit(b"")).alias("class"), F.coalesce("least", F.lit(least).cast("long")).alias("least")))

    tails = placed.groupBy("class").agg(F.count_if(F.col("n_turns") > F.col("depth")).alias("tails"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("kids"))
    known = nodes.join(tails, "class", "left").join(kids, "class", "left").fillna(0, ["tails", "kids"])
    known = cut(known.withColumn("n_children", F.col("tails") + F.col("kids")).withColumn("leaves", F.col("tails") + (F.col("n_children") == 0).cast("int")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    named = nodes.select(F.col("class").alias("parent"), F.col("least").alias("parent_conv_id"))
    whole = known.drop("leaves", "saved").join(_fold(known), "class").join(_ends(placed.filter("n_turns = depth")), "class", "left").join(named, "parent", "left")
    shared = whole.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    chain = placed.filter("n_turns > depth").select("conv_id", "n_turns", "least", F.col("depth").alias("from"), F.explode(F.sequence(F.col("depth").cast("long") + 1, "n_turns")).alias("depth"))
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("n_turns")
    alone = chain.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("from") + 1, F.col("least")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return shared.unionByName(alone)


def rebuilt(keyed: DataFrame) -> DataFrame:
    """The turns of conversations that share beginnings: c takes its first h turns from c - c % 20, where h is its id's check sum modulo 4, and keeps its own after h."""
    turns = cut(numbered(keyed))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = turns.withColumn("h", h).filter("depth > h").select("conv_id", F.col("depth").cast("long").alias("turn"), "key", "words")
    convs = turns.filter("depth = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = turns.filter("depth <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "depth", "key", "words")
    taken = convs.join(heads, "base").filter("depth <= h").select("conv_id", (F.col("depth") - 4).cast("long").alias("turn"), "key", "words")
    return own.unionAll(taken)
