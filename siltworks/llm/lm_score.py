"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

The relation is n-grams of documents joined to the count table of their order, summed
by document.  Its rows travel in blocks.  Documents lie in buckets by the hash of their
id; a bucket combines its n-grams of one order to distinct hashes with counts, as a
partial aggregate does, and sends a block to each range of the hash space in which it
has any.  A partition of the count table adds up the blocks of its range and answers
each block with the totals of its hashes, in their order.  The bucket joins the totals
to the n-grams of its texts and sums the scores of each document.

Orders follow one another, and an n-gram is sent only if its first and its last words
but one (a bigram: both words; a trigram: both bigrams) occur in other buckets too: else
its own bucket has all there are.  That is exact and leaves out most long n-grams.
A very frequent n-gram is one entry of each bucket.  There are never more blocks than
entries, so their number grows no faster than the n-grams, whatever the number of ranges.

The counts of a document's own n-grams are taken off first, so a text is scored by
the rest of the corpus.  With c for such counts and N the words of the rest, the
word w after a, b scores c(abw)/c(ab) if c(abw) > 0, else ALPHA c(bw)/c(b) if
c(bw) > 0, else ALPHA**2 max(c(w), 1/2)/N; N is at least 1.

Words are lower-cased A-Z.  Defined cases: null or blank text has 0 words and sum
and mean 0; repeated documents, of one doc_id or several, count for each other, and each
row is scored; a null doc_id is scored like any other; other columns are ignored; an
empty table gives no rows.  A bucket's texts (about ``bucket_chars``) and a range's
entries, in proportion, are what a task holds; the longest document is the exception.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnp

ORDER, ALPHA = 3, 0.4
#: Characters of a bucket's texts, about, and buckets for each range of the hash space.
BUCKET_CHARS, BUCKETS_A_RANGE = 12_000_000, 2
BLOCK = pa.schema([("bucket", pa.int64()), ("ngram", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int64()), ("ngram", pa.int32()), ("part", pa.int64()), ("totals", pa.binary())])
BLOCK_DDL, ANSWER_DDL = "bucket long, ngram int, part long, keys binary, counts binary", "bucket long, ngram int, part long, totals binary"
NONE = ANSWER.empty_table()


def pack(values: np.ndarray) -> bytes:
    """Bytes of the same significance together, which the shuffle's codec can shorten."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows one after another, and the rows' splits of them."""
    text, at = textnp.rows(column)
    hashes, splits, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for i, j in textnp.steps(at):
        w = textnp.Words(text[at[i] : at[j]], at[i : j + 1] - at[i])
        hashes.append(w.hash)
        splits.append(w.split[1:] + n)
        n += len(w.hash)
    return np.concatenate(hashes), np.concatenate(splits)


@dataclass
class Level:
    """N-grams of one order in a bucket: distinct ``keys`` with ``counts`` there, those to be ``asked`` for,
    and of each n-gram its ``first`` word and ``which`` key it has."""

    keys: np.ndarray
    counts: np.ndarray
    asked: np.ndarray
    first: np.ndarray
    which: np.ndarray


def _level(words: np.ndarray, split: np.ndarray, k: int, elsewhere: np.ndarray) -> Level:
    """``elsewhere``: whether the n-gram of the order before that starts at a word occurs in other buckets."""
    hashes, first, _ = textnp.shingles(words, split, k + 1)
    keys, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    asked = np.zeros(len(keys), bool)
    asked[which[elsewhere[first] & elsewhere[first + (k > 0)]]] = True
    return Level(keys, counts, asked, first, which)


def _answered(level: Level, answers: pa.Table, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the level's keys in the corpus, and which n-grams, by first word, occur in other buckets."""
    rows = answers.filter(pc.equal(answers.column("ngram"), k)).sort_by("part")
    totals = level.counts.astype(np.int64)
    totals[level.asked] = np.concatenate([np.zeros(0, np.int64), *[unpack(x.as_py(), np.int64) for x in rows.column("totals")]])
    elsewhere = np.zeros(n + 1, bool)
    elsewhere[level.first] = (totals > level.counts)[level.which]
    return totals, elsewhere


def _ask(k: int, parts: int):
    """Blocks of the n-grams of order ``k`` + 1; ``answers`` has those of the orders before."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = docs.column("bucket")[0].as_py()
        words, split = _words(docs.column("text"))
        elsewhere = np.ones(len(words) + 1, bool)
        for before in range(k):
            _, elsewhere = _answered(_level(words, split, before, elsewhere), answers, before, len(words))
        level = _level(words, split, k, elsewhere)
        keys, counts = level.keys[level.asked], level.counts[level.asked].astype(np.uint32)
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
        rows = [(bucket, k, int(part[a]), pack_sorted(keys[a:b]), pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK) if rows else BLOCK.empty_table()

    return run if k else lambda docs: run(docs, NONE)


def _add_up(table: pa.Table) -> pa.Table:
    """The answers to all blocks of one range; a bucket's counts fit 32 bits, totals of the corpus take 64."""
    sent = [unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys, where = np.unique(np.concatenate(sent), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, where, np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64))
    ends = np.cumsum([len(x) for x in sent])
    answers = [pack(totals[where[e - len(x) : e]]) for x, e in zip(sent, ends, strict=True)]
    return pa.table([table.column("bucket"), table.column("ngram"), table.column("part"), pa.array(answers, pa.binary())], schema=ANSWER)


def _score(order: int, alpha: float, words_in_all: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, split = _words(docs.column("text"))
        n, size = len(words), np.diff(split)
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - split[:-1][doc]
        counts = np.zeros((order, n), np.int64)  # of the n-gram that starts at a word, in other documents
        elsewhere = np.ones(n + 1, bool)
        for k in range(order):
            level = _level(words, split, k, elsewhere)
            totals, elsewhere = _answered(level, answers, k, n)
            _, own, times = np.unique(doc[level.first] * max(len(level.keys), 1) + level.which, return_inverse=True, return_counts=True)
            counts[k, level.first] = totals[level.which] - times[own]
        rest = np.maximum(words_in_all - size, 1)[doc]
        score = np.log(np.maximum(counts[0], 0.5) / rest) + np.minimum(place, order - 1) * np.log(alpha)
        for k in range(1, order):
            at = np.flatnonzero(place >= k)
            at = at[counts[k, at - k] > 0]
            backed = np.minimum(place[at], order - 1) - k
            score[at] = np.log(counts[k, at - k] / counts[k - 1, at - k]) + backed * np.log(alpha)
        total = np.bincount(doc, score, len(size))
        return pa.table([docs.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(total), pa.array(total / np.maximum(size, 1))], schema=out)

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over words), mean_log_score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).alias("words")).first()
    buckets = max(1, -(-(whole["chars"] or 0) // bucket_chars))
    parts = -(-buckets // BUCKETS_A_RANGE)
    placed = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("long")).repartition(buckets, "bucket")
    answers = None
    for k in range(order):
        bucket = placed.groupBy("bucket")
        sent = (bucket if answers is None else bucket.cogroup(answers.groupBy("bucket"))).applyInArrow(_ask(k, parts), BLOCK_DDL)
        # Each order's answers are dealt by bucket once, like the texts, and read by all later orders.
        totals = sent.groupBy("part").applyInArrow(_add_up, ANSWER_DDL).repartition(buckets, "bucket")
        answers = totals if answers is None else answers.unionAll(totals)
    scored = placed.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    return scored.applyInArrow(_score(order, alpha, whole["words"] or 0), "doc_id long, n_words long, log_score double, mean_log_score double")
