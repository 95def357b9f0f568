"""Token counts by section: whole documents are encoded once, and token spans are joined to section spans.

A byte-level vocabulary gives each token its length in bytes, so the running sum
of the lengths maps tokens to places in the text.  Section spans are half open
and in code points; the sorted spans and token starts of a document are joined
by binary search.  Allocation of a token that crosses a section's boundary, by
``rule``: ``first``, the section of its first byte; ``largest``, the section
that holds most of its bytes, the earlier on a tie.  Tokens that touch no section
count under ``outside``.

Defined cases: null text has no tokens; without spans, the sections are the lines
of a text, each with its line break; an empty text has one empty section; spans
that overlap, or are null or empty, are taken in order of start, each from the end
of the one before; repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SECTION = "array<struct<start: long, end: long, n_tokens: long, n_crossing: long>>"


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _spans(data: np.ndarray, spans: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the sections in bytes, then in code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if spans is None:
        ends = np.flatnonzero(data == 10) + 1
        if len(ends) == 0 or ends[-1] < len(data):
            ends = np.append(ends, len(data))
        starts = np.concatenate([[0], ends[:-1]])
        return starts, ends, np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    at = np.append(lead, len(data))
    bounds, last = [], 0
    for s in sorted((x["start"], x["end"]) for x in spans if x is not None and x["start"] is not None and x["end"] is not None):
        a, b = min(max(s[0], last), len(lead)), min(max(s[1], last, s[0]), len(lead))
        bounds.append((a, b))
        last = max(last, b)
    c = np.array(bounds, np.int64).reshape(-1, 2)
    return at[c[:, 0]], at[c[:, 1]], c[:, 0], c[:, 1]


def allocate(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, crossing tokens) of each section and the tokens outside all; starts and ends are sorted and disjoint."""
    stop = np.cumsum(sizes)
    begin, n = stop - sizes, len(starts)
    if n == 0 or len(sizes) == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), len(sizes)
    # The first and the last section that a token touches.
    low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, stop, "left") - 1
    touches = low <= high
    crosses = touches & ((begin < starts[np.minimum(low, n - 1)]) | (stop > ends[np.minimum(low, n - 1)]))
    mine = low.copy()
    if rule == "largest":
        for t in np.flatnonzero(crosses & (high > low)):
            k = np.arange(low[t], high[t] + 1)
            mine[t] = k[np.argmax(np.minimum(ends[k], stop[t]) - np.maximum(starts[k], begin[t]))]
    elif rule == "first":
        touches &= begin >= starts[np.minimum(low, n - 1)]
        crosses &= touches
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(mine[touches], minlength=n), np.bincount(mine[crosses], minlength=n), int((~touches).sum())


def _count(vocabulary: bytes, rule: str, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size_of = _encoder(vocabulary)
        for batch in batches:
            totals, outside, sections = [], [], []
            spans = batch.column("spans") if with_spans else None
            for r, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                sizes = size_of[np.array(encoder.encode_ordinary(text), np.int64)]
                a, b, ca, cb = _spans(np.frombuffer(text.encode(), np.uint8), (spans[r].as_py() or []) if with_spans else None)
                tokens, crossing, rest = allocate(sizes, a, b, rule)
                totals.append(len(sizes))
                outside.append(rest)
                sections.append([{"start": w, "end": x, "n_tokens": y, "n_crossing": z} for w, x, y, z in zip(ca.tolist(), cb.tolist(), tokens.tolist(), crossing.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(outside, pa.int64()), pa.array(sections, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "n_tokens", "n_crossing")])))],
                names=["doc_id", "n_tokens", "outside", "sections"],
            )

    return run


def token_counts(docs: DataFrame, spans: str | None = None, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """doc_id, n_tokens, outside, sections.  ``spans``: a column array<struct<start, end>> of docs.

    The vocabulary file is read once where the job is planned and travels with the tasks.
    """
    with open(vocabulary, "rb") as f:
        held = f.read()
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([F.col(spans).alias("spans")] if spans else [])
    return docs.select(*columns).mapInArrow(_count(held, rule, spans is not None), f"doc_id long, n_tokens long, outside long, sections {SECTION}")


def digest(counted: DataFrame) -> DataFrame:
    of = lambda x: F.transform("sections", lambda s: s[x])
    total = lambda x: F.aggregate(of(x), F.lit(0).cast("long"), lambda a, b: a + b)
    return counted.select(
        "doc_id",
        "n_tokens",
        F.size("sections").cast("long").alias("n_sections"),
        total("n_tokens").alias("section_tokens"),
        total("n_crossing").alias("crossing_tokens"),
        F.get(of("n_tokens"), F.lit(0)).alias("first_section_tokens"),
        F.array_max(of("n_tokens")).alias("largest_section_tokens"),
        F.xxhash64(F.concat_ws(",", F.transform(of("n_tokens"), lambda n: n.cast("string")))).alias("section_digest"),
    )
