"""MinHash near-duplicate detection with tensored banding.

``halves`` collections of ``rows`` min-hashes are drawn twice; table (i, j) of
the ``halves**2`` tables has as key the i-th collection of the first kind joined
with the j-th of the second.  So ``2 * halves * rows`` min-hashes serve
``halves**2`` tables of ``2 * rows`` hashes each; with 12 and 3, 72 instead of
864.  Two texts of Jaccard similarity s meet in some table with probability
``(1 - (1 - s**rows)**halves)**2``: 0.9996 at 0.8, 0.9999999 at 0.9.

Texts of one shingle set are collapsed first and stand for each other.  In each
bucket the member that shares most buckets is the hub; members are verified
against it on full shingle sets.  Buckets that still hold several components
are finished exactly: their members are grouped by each collection of the first kind, that is,
half a key; a group that holds several components is laid out in blocks, and in each pair of
blocks the members that share a table and are not yet linked are verified, in the group of
the first collection that they share.  Only links leave a block.  Nothing is capped.

Defined cases: null, empty or blank text has no shingles and is linked with
nothing; fewer than k words are one shingle; repeated rows of one doc_id count
as copies of each other, and if their texts differ, each row has its own set, all of them
link, and one of the texts is verified; a null doc_id is no document: such rows are left out;
other columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm import textnp
from siltworks.llm.common import cut
from siltworks.llm.components import components

WORDS, PERCENT, HALVES, ROWS = 5, 80, 12, 3
BLOCK = 256


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    for i, j, text, at in textnp.each(batch, "text"):
        hashes, _, split = textnp.Words(text, at).shingles(k, short=True)
        for r in range(j - i):
            yield np.unique(hashes[split[r] : split[r + 1]])


def _signatures(k: int, halves: int, rows: int):
    multiply = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = textnp.MULTS[:rows]
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * halves), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, k))
            sizes = np.array([len(s) for s in sets], np.int64)
            f1, f2 = np.zeros((2, len(sets)), np.uint64)
            keys = np.zeros((len(sets), 2 * halves), np.uint64)
            some = np.flatnonzero(sizes)
            for part in np.array_split(some, max(1, int(sizes.sum()) // 400_000)):
                if not len(part):
                    continue
                flat, first = np.concatenate([sets[r] for r in part]), np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                f1[part] = np.add.reduceat(flat, first)
                f2[part] = np.add.reduceat(textnp.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
                least = np.stack([np.minimum.reduceat(flat * m, first) for m in multiply])
                keys[part] = textnp.mix((least.reshape(2 * halves, rows, -1) * weights[None, :, None]).sum(axis=1, dtype=np.uint64)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists(keys[:, :halves]), lists(keys[:, halves:])], schema=out
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in _sets(batch, k)], pa.binary())], names=["id", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sx"), batch.column("sy"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links between the members of two blocks of a half key that share a table and are of different components."""

    def run(table: pa.Table) -> pa.Table:
        us, vs = [], []
        side = table.column("side").to_numpy()
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        a, b = (np.stack([np.asarray(x, np.int64) for x in table.column(c).to_pylist()]) for c in "ab")
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        same = table.column("block")[0].as_py() == table.column("other")[0].as_py()
        half = table.column("half")[0].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        if len(right):
            flat, first = np.concatenate([sets[r] for r in right]), np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
            for x in left:
                # Each pair is tried in the group of the first half that it shares.
                near = ((a[right] == a[x]).argmax(axis=1) == half) & (b[right] == b[x]).any(axis=1) & (comps[right] != comps[x])
                near &= (100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x])) & (ids[right] > ids[x] if same else True)
                if not near.any():
                    continue
                if near.mean() > 0.3:
                    at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
                    both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), first)[near]
                else:
                    both = np.array([(sets[x][np.minimum(np.searchsorted(sets[x], sets[r]), sizes[x] - 1)] == sets[r]).sum() for r in right[near]])
                hit = right[near][100 * both >= percent * (sizes[x] + sizes[right[near]] - both)]
                us.append(np.full(len(hit), ids[x]))
                vs.append(ids[hit])
        join = lambda z: pa.array(np.concatenate(z) if z else np.zeros(0, np.int64), pa.int64())
        return pa.table({"u": join(us), "v": join(vs)})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    signed = cut(texts.mapInArrow(_signatures(words, halves, rows), "doc_id long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>"))
    fp = ["f1", "f2", "n_shingles"]
    reps = cut(signed.filter("n_shingles > 0").groupBy(*fp).agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")))

    tables = reps.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y"))
    keyed = tables.select("rep", F.xxhash64("i", "j", "x", "y").alias("key"))
    met = cut(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    mass = met.groupBy("rep").agg(F.sum("n").alias("mass"))
    hubs = met.join(mass, "rep").groupBy("key").agg(F.max_by("rep", F.struct("mass", -F.col("rep"))).alias("hub"))
    pairs = cut(met.join(hubs, "key").filter("rep != hub").select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y")).distinct())

    # Reading the texts of members anew costs less than to carry the sets of all.
    members = met.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(texts.join(members, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_full_sets(words), "id long, shingles binary"))
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy")), "y")
    links = cut(both.select("x", "y", "sx", "sy").mapInArrow(_verify(percent), "u long, v long"))
    labels = components(links)

    # What the hubs left: buckets with several components.
    of = met.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    unsettled = cut(of.join(mixed, "key").select("rep", "comp").distinct().join(reps.select("rep", "a", "b"), "rep"))
    halves = unsettled.select("rep", "comp", F.posexplode("a").alias("half", "x"))
    sizes = halves.groupBy("half", "x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").drop("lo", "hi")
    placed = halves.join(sizes, ["half", "x"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    laid = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "half", "x", F.least("mine", "with").alias("block"), F.greatest("mine", "with").alias("other"), (F.col("mine") > F.col("with")).cast("int").alias("side"), F.col("rep").alias("id"), "comp"
    )
    full = laid.join(unsettled.select(F.col("rep").alias("id"), "a", "b"), "id").join(sets, "id")
    more = cut(full.groupBy("half", "x", "block", "other").applyInArrow(_block_links(percent), "u long, v long"))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = signed.join(reps.select(*fp, "rep"), fp, "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
