"""Hashed word and character n-gram features of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltworks.llm import textnp

_U = np.uint64
#: Bytes of text of a step; a step's n-grams take some 80 times as much.
STEP_BYTES = 500_000


def ngrams(batch: pa.RecordBatch, sizes: tuple[int, ...], buckets: int, word_orders: tuple[int, ...] = (1, 2), lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each n-gram, row of each n-gram) for steps of a batch.

    Character n-grams are over code points, with white space at their ends only,
    so they hold where words begin and end.  ``buckets`` is a power of two.
    """
    for i, j, text, at in textnp.each(batch, "text", STEP_BYTES):
        words = textnp.Words(text, at, lower)
        found, rows = [], []
        for k in word_orders:
            h, word, _ = words.shingles(k)
            found.append(textnp.mix(h + _U(k)) if k > 1 else h)
            rows.append(np.searchsorted(words.split, word, "right") - 1)
        codes = np.frombuffer(words.text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        lead = np.flatnonzero((words.text & 0xC0) != 0x80)
        row = np.searchsorted(at, lead, "right") - 1
        if len(codes) == len(lead):
            space = (codes == 32) | ((codes >= 9) & (codes <= 13))
            codes[space] = 32
            for n in sizes:
                m = len(codes) - n + 1
                if m <= 0:
                    continue
                total = np.zeros(m, np.uint64)
                fits = (row[:m] == row[n - 1 :]) & ~(space[:m] & space[n - 1 :])
                for k in range(n):
                    total += codes[k : k + m] * textnp.MULTS[k + 8]
                    if 0 < k < n - 1:
                        fits &= ~space[k : k + m]
                found.append(textnp.mix(total[fits] + _U(97 * n)))
                rows.append(row[:m][fits])
        yield i, j, (np.concatenate(found) & _U(buckets - 1)).astype(np.int64), np.concatenate(rows)
