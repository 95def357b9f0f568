"""Runs of repeated words in each text, from its suffix tree.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), at least ``2 * q`` and ``shortest`` words long, that no neighbouring word
extends.  A batch of texts is worked on together, but suffixes of different
texts share nothing:

* suffixes are ranked by their first 1, 2, 4, ... words until all differ; a text without
  repeats is done after few rounds.  The ranks of each round stay, for they say
  whether two blocks of a power of two words are equal;
* the suffix tree's inner nodes are the intervals of the sorted suffixes between which
  the common prefix doesn't fall below the node's depth;
* at each node the leaf lists of all children but the largest are read
  (Stoye and Gusfield's smaller half, so n log n leaves in all).  A leaf j
  whose suffix j + depth or j - depth lies below the node as well starts, or ends
  the first half of, a tandem repeat; it is branching if the next word breaks the period;
* a branching repeat is rotated to the left while the period holds, and repeats of the
  same stretch are merged to its smallest period: that stretch is the run.

One row comes out for one row that goes in, and nothing is shuffled.  A task holds the words of
``textnp.STEP_BYTES`` of text, or of one longer text, with four bytes a word for
each round.

Defined cases: null, empty and blank texts have no words and no runs; a null doc_id stays
null; repeated rows stay; further columns are ignored, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnp
from siltworks.llm.common import words

#: Words of the shortest run.
SHORTEST = 12
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Split(NamedTuple):
    """Words of some texts: their bytes without separators, sizes, numbers (equal words, equal numbers), and text r's words at [at[r], at[r + 1])."""

    data: np.ndarray
    size: np.ndarray
    word: np.ndarray
    at: np.ndarray


def split(text: np.ndarray, at: np.ndarray) -> Split:
    gap = textnp.IS_SPACE[text]
    edge = np.ones(len(text) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[at] = True  # words end where texts end
    start = np.flatnonzero(edge[:-1] & ~gap)
    edge[1:-1] = gap[1:]
    edge[at] = True
    end = np.flatnonzero(edge[1:] & ~gap) + 1
    size, data = end - start, text[~gap]
    ends = np.concatenate([[0], np.cumsum(size)])
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return Split(data, size, column.dictionary_encode().indices.to_numpy(), np.searchsorted(start, at))


class Suffixes(NamedTuple):
    """Sorted suffixes, text by text; ``levels[k][i]``: the rank of the 2**k words at i; ``common[t]``: words shared by sorted[t - 1] and sorted[t]."""

    sorted: np.ndarray
    levels: list[np.ndarray]
    common: np.ndarray


def _groups(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys at ``place``: the first place of each one's equals, and whether it has any."""
    opens = np.ones(len(key) + 1, bool)
    opens[1:-1] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(opens[:-1], place, 0)), ~(opens[:-1] & opens[1:])


def suffixes(word: np.ndarray, text: np.ndarray, end: np.ndarray) -> Suffixes:
    """``text`` and ``end`` are the number and the end of the text that each word is of."""
    n = len(word)
    key = text * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    first, shared = _groups(key[order], np.arange(n))
    rank = np.full(n + 1, -1, np.int32)  # the last is no suffix, and equals none
    rank[order] = first
    levels, place, step = [rank], np.flatnonzero(shared), 1
    while len(place):
        open_ = order[place]
        after = open_ + step
        key = rank[open_].astype(np.int64) * (n + 1) + np.where(after < end[open_], rank[np.minimum(after, n)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        order[place] = open_ = open_[by_key]
        first, shared = _groups(key[by_key], place)
        rank = rank.copy()
        rank[open_] = first
        levels.append(rank)
        place, step = place[shared], 2 * step
    common = np.zeros(n, np.int64)
    t = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[t - 1].copy(), order[t].copy()
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        a[equal] += 1 << k
        b[equal] += 1 << k
    common[t] = a - order[t - 1]
    return Suffixes(order, levels, common)


def _intervals(common: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes [low, high] that share the common[t] words of t - 1 and t, by powers of two over least values."""
    n, least = len(common), [common]
    while (least[-1] > 0).any() and 2 << (len(least) - 1) <= n:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    depth, low, high = common[t], t.copy(), t + 1
    for k in range(len(least) - 1, -1, -1):
        to = low - (1 << k)
        ok = (to >= 0) & (least[k][np.maximum(to, 0)] >= depth)
        low = np.where(ok, to, low)
        ok = high + (1 << k) <= n
        ok &= least[k][np.where(ok, high, 0)] >= depth
        high = np.where(ok, high + (1 << k), high)
    return low - 1, high - 1


def _smaller_half(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, depth, low, high): the leaves of all children but the largest, and their node."""
    t = np.flatnonzero(s.common)
    low, high = _intervals(s.common, t)
    by_node = np.lexsort((t, s.common[t], low))
    t, low, high = t[by_node], low[by_node], high[by_node]
    depth = s.common[t]
    opens = np.ones(len(t), bool)
    opens[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    node = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    # Children: one before a node's first boundary, and one after each boundary.
    closes = np.append(opens[1:], True) if len(t) else opens
    after = np.where(closes, high + 1, np.append(t[1:], 0)) if len(t) else t
    begin, stop, of = np.concatenate([low[heads], t]), np.concatenate([t[heads], after]), np.concatenate([node[heads], node])
    by_size = np.lexsort((stop - begin, of))
    begin, stop, of = begin[by_size], stop[by_size], of[by_size]
    small = np.zeros(len(of), bool)
    small[:-1] = of[1:] == of[:-1]  # the last of a node is its largest
    begin, stop, of = begin[small], stop[small], of[small]
    size = stop - begin
    place = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else size
    of = np.repeat(heads[of], size)
    return place, depth[of], low[of], high[of]


def runs(word: np.ndarray, at: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs, by text, start and period; words are numbered over all texts."""
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none, none
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    begin, end = np.repeat(at[:-1], size), np.repeat(at[1:], size)
    s = suffixes(word.astype(np.int64), text, end)
    rank = s.levels[-1]
    place, depth, low, high = _smaller_half(s)
    leaf = s.sorted[place]
    found = []
    for first, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
        inside = (first >= begin[leaf]) & (first + 2 * depth <= end[leaf])
        below = rank[np.where(inside, other, 0)]
        inside &= (below >= low) & (below <= high)
        i, d = first[inside], depth[inside]
        next_ = i + 2 * d
        breaks = (next_ == end[i]) | (word[np.minimum(next_, len(word) - 1)] != word[i + d])
        found.append(np.stack([i[breaks], d[breaks]]))
    start, period = np.concatenate(found, axis=1)
    stop = start + 2 * period
    for k in range(len(s.levels) - 1, -1, -1):
        to = start - (1 << k)
        ok = to >= begin[start]
        to = np.where(ok, to, 0)
        ok &= s.levels[k][to] == s.levels[k][to + period]
        start = np.where(ok, to, start)
    long = stop - start >= shortest
    start, stop, period = start[long], stop[long], period[long]
    by_stretch = np.lexsort((period, stop, start))
    start, stop, period = start[by_stretch], stop[by_stretch], period[by_stretch]
    opens = np.ones(len(start), bool)
    opens[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[opens], stop[opens], period[opens]
    order = np.lexsort((period, start))
    return text[start[order]], start[order], stop[order], period[order]


def collapse(s: Split, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and boundaries of the texts without the words that follow the first period of a run, joined by one space."""
    n = len(s.size)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, stop, -1)
    keep = np.cumsum(depth)[:n] == 0
    spaced = np.full(len(s.data) + n, 0x20, np.uint8)  # a space after each word
    spaced[np.arange(len(s.data)) + np.repeat(np.arange(n), s.size)] = s.data
    stays = np.repeat(keep, s.size + 1)
    ends = np.cumsum(s.size + 1)
    last = np.maximum.accumulate(np.where(keep, np.arange(n), -1)) if n else keep
    full = np.flatnonzero(s.at[1:] > s.at[:-1])
    stays[ends[last[s.at[1:][full] - 1]] - 1] = False  # none after a text's last word; its first is always kept
    kept = np.concatenate([[0], np.cumsum(stays)])
    return spaced[stays], kept[np.concatenate([[0], ends])[s.at]]


def _find(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text, at in textnp.each(batch, "text"):
                s = split(text, at)
                of, start, stop, period = runs(s.word, s.at, shortest)
                struct = pa.StructArray.from_arrays([pa.array(x) for x in (start - s.at[of], stop - start, period)], names=["start", "length", "period"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(j - i + 1)), pa.int32()), struct)
                left, ends = collapse(s, start, stop, period)
                texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(left)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(s.at)), found, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, in words, by start and period), collapsed (the text with one period of each run)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_find(shortest), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every text whose id's check sum ends in 0 goes on periodically from some word; its words are then joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n, a, p = F.size("w"), F.col("a"), F.col("p")
    w = w.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    w = w.withColumn("p", F.when(n > 0, F.floor((n - a) / (3 + F.col("g") % 8)) + 1).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.slice(F.concat(F.slice("w", F.lit(1), a), again), F.lit(1), n)
    return w.select("doc_id", F.when(n > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row a document: how many runs, the longest of them, check sums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))), "")
    held = found.withColumn("best", best)
    return held.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
