"""Totals of n-grams beyond what a bucket's counts can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltworks.llm import lm_score


def test_totals_take_sixty_four_bits():
    keys = np.array([3, 7, 11], np.uint64)
    counts = np.array([3_000_000_000, 1, 4_294_967_295], np.uint32)
    block = [lm_score.pack_sorted(keys), lm_score.pack(counts)]
    sent = pa.table([pa.array([0, 1], pa.int64()), pa.array([0, 0], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([block[0]] * 2, pa.binary()), pa.array([block[1]] * 2, pa.binary())], schema=lm_score.BLOCK)
    answers = lm_score._add_up(sent)
    level = lm_score.Level(keys, counts.astype(np.int64), np.ones(3, bool), np.arange(3), np.arange(3))
    totals, elsewhere = lm_score._answered(level, answers.slice(0, 1), 0, 3)
    assert totals.tolist() == [6_000_000_000, 2, 8_589_934_590]
    assert elsewhere.tolist() == [True, True, True, False]
