"""Removal of repeated byte strings against brute force, and the order of deep-shallow sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from siltworks.llm import suffix_dedup


def brute(texts, length):
    """(spans, kept) of each text by counting all of its strings."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * (len(d) + 1)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, i = [], 0
        while i < len(d):
            j = i
            while gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((spans, bytes(x for x, g in zip(d, gone) if not g)))  # noqa: B905
    return out


def some_texts(rng, n=40):
    letters = rng.choice(["ab", "abcdefgh é\n", "aß"])
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randrange(20, 160)) for _ in range(4)]
    texts = [None, "", "a" * 39, "a" * 150, "a" * 40]
    for _ in range(n):
        parts = [rng.choice([make(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    return texts + [texts[-1], texts[7]]


@pytest.mark.parametrize(("seed", "most"), [(1, 200), (2, 200), (3, 1), (4, 2)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "SORTED", 50)
    rng = random.Random(seed)
    texts = some_texts(rng)
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, spans string, id int").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 40, 16).collect()), key=repr)
    want = [(i // 2 if i % 7 else None, len((t or "").encode()), spans, kept) for i, (t, (spans, kept)) in enumerate(zip(texts, brute(texts, 40), strict=True))]
    assert got == sorted(want, key=repr)


def test_shuffled_texts_give_the_same(spark, monkeypatch):
    texts = some_texts(random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent = sorted(map(repr, suffix_dedup.remove_repeats(docs, 40, 16).collect()))
    monkeypatch.setattr(suffix_dedup, "BROADCAST", 0)
    assert sorted(map(repr, suffix_dedup.remove_repeats(docs.repartition(7), 40, 16).collect())) == sent


def test_empty_table_and_digest(spark):
    docs = spark.createDataFrame([(1, None), (2, "x" * 900), (3, "y" * 400), (4, "z" + "y" * 400)], "doc_id long, text string")
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(docs.limit(0))).collect() == []
    rows = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    of = lambda x: hashlib.sha256(x).hexdigest()
    assert rows == {1: (0, 0, 0, of(b"")), 2: (900, 900, 1, of(b"")), 3: (400, 400, 1, of(b"")), 4: (401, 400, 1, of(b"z"))}


def test_deep_shallow_sorts():
    rng = random.Random(11)
    for shallow in (0, 3, 16):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(120)]
        texts += [x[:-1] + b"c" for x in texts if x][:30] + texts[:20]
        assert [texts[k] for k in suffix_dedup.deep_shallow(texts, shallow)] == sorted(texts)
