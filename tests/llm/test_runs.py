"""Periodic runs against brute force, and the defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from siltworks.llm import periodic_runs


def brute(w, shortest=12):
    """{(start, end): smallest period} by trying every period at every word."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(shortest, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, q, e) for (s, e), q in found.items())


def texts(rng, most=80):
    size, kinds = rng.choice([0, 1, 5, 30, most]), rng.choice([1, 2, 3, 5, 40])
    w = [f"é{rng.randrange(kinds)}" for _ in range(size)]
    if size > 10 and rng.random() < 0.5:
        a = rng.randrange(size)
        p = 1 + rng.randrange(max(1, (size - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
    return w


@pytest.mark.parametrize("shortest", [2, 12])
def test_runs_equal_brute_force(shortest):
    rng = random.Random(shortest)
    for _ in range(150):
        docs = [texts(rng) for _ in range(rng.randrange(1, 6))]
        at = np.cumsum([0, *map(len, docs)])
        word = np.array([int(x[1:]) for d in docs for x in d], np.int64)
        found = [(int(t), int(a - at[t]), int(q), int(b - at[t])) for t, a, b, q in zip(*periodic_runs.runs(word, at, shortest), strict=True)]
        assert found == [(t, s, q, e) for t, d in enumerate(docs) for s, q, e in brute(d, shortest)]


def test_rows_and_defined_cases(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b"), (None, "a " * 20), (3, "one"), (3, "one"), (4, "\n" + "x y " * 3000), (5, " ".join(["z"] * 12)), (6, " ".join(["z"] * 11))]
    rows += [(10 + i, rng.choice([" ", "\n", " \t "]).join(texts(rng))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(w)
        gone = {k for s, q, e in found for k in range(s + q, e)}
        want.append((i, len(w), [(s, e - s, q) for s, q, e in found], " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0))).collect() == []


def test_digest_takes_the_longest_run_and_breaks_ties(spark):
    text = " ".join([*["a"] * 12, "b", *["c", "d"] * 6, "e", *["f"] * 12])
    row = periodic_runs.digest(periodic_runs.periodic_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert tuple(row[0])[:6] == (1, 3, 0, 12, 1, 12000)
    assert row[0].runs_sha256 == hashlib.sha256(b"0,12,1\n13,12,2\n26,12,1\n").hexdigest()
    assert row[0].collapsed_sha256 == hashlib.sha256(b"a b c d e f").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(row[1]) == (2, 0, None, None, None, None, empty, empty)
