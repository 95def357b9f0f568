"""Benchmark decontamination with SimHash windows, with DataFrame operations only.

Windows have the size of a benchmark item, in words, and are laid at every
alignment at which the document shares a shingle with an item of that size; a
window that shares none has similarity 0, so none of those is lost.  Windows and
items get 64-bit SimHash fingerprints, cut into ``radius + 1`` blocks; of two
fingerprints within ``radius`` bits, some block is equal.  At a similarity of 0.8 two
fingerprints differ in 9.7 bits on the average, so a radius that loses nothing leaves blocks
of three bits, which alone select nothing.  The index therefore joins on (size, shingle,
block number, block), with the shingles of a side's prefix: in the order of their hashes,
all but as many as it must share.  Of two sides that are similar enough, some shingle
of the prefixes is equal; so all such pairs within the radius are found, and hardly others.
Candidates are verified on the exact similarity of shingles weighted by how often they
occur: the sum of the smaller weights over the sum of the larger.

Shingles are of ``words`` words, lower-cased A-Z, or the whole item if it is
shorter; windows longer than the document are the document.

Defined cases: null or blank texts and items match nothing; repeated items or
documents give one row per (doc_id, item_id); of several windows the most
similar counts, the first on a tie; other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import ascii_lower, cut, words as words_of

WORDS, PERCENT, RADIUS, BITS = 5, 80, 21, 64
#: Shingles of items that are broadcast, at most; beyond, the join is shuffled.
BROADCAST_SHINGLES = 500_000


def bound(value: Column, f) -> Column:
    """f(value), with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grams_of(hashes: Column, k: int) -> Column:
    """Hashes of the k-word shingles, from the hashes of the words."""
    one = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, one).otherwise(F.array().cast("array<bigint>"))


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def grams(found: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words."""
    return bound(word_hashes(found), lambda h: grams_of(h, k))


def places(found: Column, ks: list[int]) -> Column:
    """struct<k, p, gram> of the shingles of every size, from one pass over the words."""
    of = lambda h, k: F.transform(grams_of(h, k), lambda g, p: F.struct(F.lit(k).alias("k"), p.alias("p"), g.alias("gram")))
    return bound(word_hashes(found), lambda h: F.concat(*[of(h, k) for k in ks]))


def fingerprint(hashes: Column) -> Column:
    """The 64 bits of a SimHash as a string: bit b is 1 if more hashes have it than not; repeats weigh."""
    count = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(2 * count(b) > F.size(hashes), "1").otherwise("0")), "")


def weighed(hashes: Column) -> Column:
    """A token for each occurrence of a shingle, the same for the n-th one everywhere, in order: tokens that
    two sides share are as many as the sum of their smaller weights."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda g, i: F.when(F.coalesce(F.get(s, i - 1) != g, F.lit(True)), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("g"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).alias("n"))))

    each = lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda o: F.xxhash64(r["g"], o))
    return F.sort_array(F.flatten(F.transform(bound(F.sort_array(hashes), runs), each)))


def prefix(tokens: Column, percent: int) -> Column:
    """The first tokens, all but as many as two sides of that similarity must share, and one more."""
    return F.slice(tokens, 1, (F.size(tokens) - F.ceil(F.size(tokens) * percent / 100) + 1).cast("int"))


def indexed(df: DataFrame, radius: int, percent: int) -> DataFrame:
    """Adds ``tokens``, ``first`` (the prefix of them), ``bits`` and ``blocks``, the pieces that bits are cut into."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    out = df.withColumn("tokens", weighed(F.col("grams"))).withColumn("first", prefix(F.col("tokens"), percent)).withColumn("bits", fingerprint(F.col("grams")))
    return out.withColumn("blocks", F.array(*[F.substring("bits", a + 1, b - a) for a, b in pairwise(edges)]))


def distance(x: Column, y: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda d: d))


def candidates(windows: DataFrame, bench: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(n, content, item_id) of the pairs of one size that share a shingle of the prefixes and a block, within ``radius``."""

    def keys(side: DataFrame, *names: str) -> DataFrame:
        return side.select("n", *names, "blocks", F.explode("first").alias("token")).select("n", *names, "token", F.posexplode("blocks").alias("i", "block"))

    left, right = keys(windows, "content", "bits"), keys(bench.withColumnRenamed("bits", "item_bits"), "item_id", "item_bits")
    met = left.join(right, ["n", "token", "i", "block"]).select("n", "content", "item_id", "bits", "item_bits").distinct()
    return met.filter(distance(F.col("bits"), F.col("item_bits")) <= radius).select("n", "content", "item_id")


def items_of(items: DataFrame, words: int) -> DataFrame:
    """item_id, n (words), k (words of a shingle), words."""
    bench = items.select("item_id", words_of(ascii_lower(F.col("text"))).alias("words")).filter(F.size("words") > 0).distinct()
    return bench.select("item_id", F.size("words").alias("n"), F.least(F.size("words"), F.lit(words)).alias("k"), "words")


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start and n_words of the window, shared and total weight of its shingles and the item's."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(ascii_lower(F.col("text"))).alias("words"))
    bench = items_of(items, words)
    ks = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most ``words`` numbers
    if not ks:
        return spark.createDataFrame([], "doc_id long, item_id long, start int, n_words int, shared int, total int")
    by_k = lambda w, pick: reduce(lambda rest, k: F.when(pick == k, grams(w, k)).otherwise(rest), ks[1:], grams(w, ks[0]))
    bench = cut(indexed(bench.select("item_id", "n", "k", by_k(F.col("words"), F.col("k")).alias("grams")), radius, percent))

    known = bench.select("n", "k", F.posexplode("grams").alias("q", "gram")).distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    spots = texts.select("doc_id", F.size("words").alias("size"), F.explode(places(F.col("words"), ks)).alias("at")).select("doc_id", "size", "at.*")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("size") - F.col("n"))).cast("int")
    # A document shorter than the item is a window as it is.
    windows = cut(spots.join(known, ["k", "gram"]).select("doc_id", "n", "k", start.alias("start")).distinct())

    held = texts.join(windows.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    laid = windows.join(held, "doc_id").select("doc_id", "n", "k", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("words"))
    laid = laid.select("doc_id", "n", "k", "start", by_k(F.col("words"), F.col("k")).alias("grams")).withColumn("content", F.xxhash64("n", "grams"))
    laid = cut(laid)
    # Windows of the same content are fingerprinted and verified once.
    distinct = cut(indexed(laid.groupBy("n", "content").agg(F.first("grams").alias("grams")), radius, percent))
    near = candidates(distinct, bench, radius)
    paired = near.join(distinct.select("n", "content", "tokens"), ["n", "content"]).join(bench.select("item_id", "n", F.col("tokens").alias("item_tokens")), ["item_id", "n"])
    scored = paired.withColumn("shared", F.size(F.array_intersect("tokens", "item_tokens")))
    scored = scored.withColumn("total", F.size("tokens") + F.size("item_tokens") - F.col("shared")).filter(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("total"))
    found = laid.join(scored.select("n", "content", "item_id", "shared", "total"), ["n", "content"])
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n", "shared", "total"), F.struct(F.col("shared") / F.col("total"), -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.start", F.col("b.n").alias("n_words"), "b.shared", "b.total")
