"""Near-dedup, passages and decontamination against brute force and planted cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltworks.llm import decontaminate, near_dedup, substring_dedup

DOCS = "doc_id long, text string, source string, x string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "x") for i, t in texts], DOCS)


def sets(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k):
    shingles = {i: sets(t, k) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and shingles[a] and shingles[b]:
                both = len(shingles[a] & shingles[b])
                if 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(shingles[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One two"), (5, "one two three four")]
    n = 10
    for _ in range(25):
        base = prose(rng, rng.randrange(30, 400)).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows.append((n, prose(rng, 60_000, 5000)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4)


def test_a_chain_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    w = prose(rng, 200, 10**6).split()
    rows = []
    for i in range(12):
        rows.append((100 + i, " ".join(w)))
        w[i * 15] = f"new{i}"
        w[i * 15 + 1] = f"other{i}"
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 5).items()} and set(got.values()) == {100}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    found = substring_dedup.repeated_passages(none)
    assert found.count() == 0 and substring_dedup.digest(found).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0


def test_planted_passages_are_found_and_removed(spark):
    rng = random.Random(7)
    passage, other = prose(rng, 80, 10**6), prose(rng, 64, 10**6)
    near = passage.split()
    near[40] = "changed"
    rows = [
        (1, f"{prose(rng, 120, 10**6)} {passage} {prose(rng, 50, 10**6)}"),
        (2, f"{prose(rng, 40, 10**6)}\n{passage}\n{prose(rng, 200, 10**6)} {other}"),
        (3, f"{other} {prose(rng, 90, 10**6)} {' '.join(near)}"),
        (4, prose(rng, 300, 10**6)),
        (5, " ".join(passage.split()[:30]) + " " + prose(rng, 100, 10**6)),
        (6, None),
        (7, ""),
        (8, "short"),
        (9, passage),
    ]
    docs = frame(spark, rows)
    found = [r.asDict() for r in substring_dedup.repeated_passages(docs).collect()]
    assert {r["doc_id"] for r in found} == {2, 3, 9}
    left = {r.doc_id: r.text for r in substring_dedup.remove(docs, spark.createDataFrame(found)).collect()}
    whole = dict(rows)
    for i in (1, 4, 5, 6, 7, 8):
        assert left[i] == whole[i]
    assert words_of(left[2])[:40] == words_of(whole[2])[:40] and len(words_of(left[2])) in range(300, 309)
    assert len(words_of(left[9])) <= 2
    assert set(words_of(passage)[4:-4]).isdisjoint(words_of(left[2]))
    assert set(words_of(passage)[8:16]).isdisjoint(words_of(left[3]))
    classes = {r.doc_id: r.class_id for r in substring_dedup.digest(spark.createDataFrame(found)).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 9: 1}


def test_many_sharing_one_passage_are_all_found(spark):
    rng = random.Random(9)
    passage = prose(rng, 70, 10**6)
    rows = [(i, f"{prose(rng, 30, 10**6)} {passage} {prose(rng, 30, 10**6)}") for i in range(150)]
    assert {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()} == set(range(1, 150))


def test_interleaved_variants_of_a_passage_have_every_exact_repeat(spark):
    rng = random.Random(17)
    base, variants, rows = prose(rng, 60, 10**6).split(), [], []
    for v in range(20):
        w = list(base)
        for k in rng.sample(range(60), 3):
            w[k] = f"v{v}x{k}"
        variants.append(" ".join(w))
    seen, expected = set(), set()
    for i in range(300):
        v = rng.randrange(20)
        rows.append((i, f"{prose(rng, 30, 10**6)} {variants[v]} {prose(rng, 30, 10**6)}"))
        if v in seen:
            expected.add(i)
        seen.add(v)
    whole, text = set(), dict(rows)
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        assert r.other < r.doc_id
        if r.start <= 30 and r.end >= 90 and text[r.doc_id].split()[30:90] == text[r.other].split()[30:90]:
            whole.add(r.doc_id)
    assert whole == expected


def test_near_copies_in_one_group_of_variants_are_all_linked(spark):
    """Variants of a passage that aren't similar to each other, and one near copy of each, far from it in the order."""
    rng = random.Random(43)
    base, rows = prose(rng, 60, 10**6).split(), []
    for v in range(40):
        w = list(base)
        for k in (8 + v % 5, 28 + v % 7, 49 - v % 3):
            w[k] = f"v{v}x{k}"
        near = list(w)
        near[20] = f"e{v}"
        for i, p in ((v, w), (1000 + (v * 17) % 40, near)):
            rows.append((i, f"{prose(rng, 30, 10**6)} {' '.join(p)} {prose(rng, 30, 10**6)}"))
    found = {(r.doc_id, r.other) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert {(1000 + (v * 17) % 40, v) for v in range(40)} <= found


def seeds_of(*texts):
    spans = [[{"first": 0, "last": 10**6}]] * len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(spans), pa.array(texts)], names=["doc_id", "spans", "text"])
    rows = [r for b in substring_dedup._seeds(5, 46, 80)([batch]) for r in b.to_pylist()]
    return [{r["seed"] for r in rows if r["doc_id"] == i} for i in range(len(texts))]


def stutter(rng, n):
    return [f"s{rng.randrange(10**6)}" for _ in range(n)]


def repeated(words, times):
    return " ".join(" ".join([w] * k) for w, k in zip(words, times, strict=True))


def test_a_word_that_goes_on_is_no_seed_but_similar_stutters_share_one():
    rng = random.Random(47)
    x, y = stutter(rng, 8), stutter(rng, 8)
    y[4] = x[2]
    a, b, c = seeds_of(repeated(x, [20] * 8), repeated(y, [19] * 8), repeated(x, [17, 22, 18, 25, 19, 17, 20, 24]))
    assert not a & b and a & c


def test_near_copies_among_stutters_in_large_groups_are_found(spark):
    """A word goes on in all texts, so its group is large; each text has one near copy, far from it in the order."""
    rng = random.Random(53)
    rows = []
    for v in range(30):
        words = [*stutter(rng, 2), "on", *stutter(rng, 2), "on", *stutter(rng, 2)]
        rows += [(i, f"{prose(rng, 20, 10**6)} {repeated(words, [rng.randrange(10, 26) for _ in words])} {prose(rng, 20, 10**6)}") for i in (v, 1000 + (v * 17) % 30)]
    found = {(r.doc_id, r.other) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert {(1000 + (v * 17) % 30, v) for v in range(30)} <= found


def test_parts_of_boxes_are_taken_in_steps(monkeypatch):
    monkeypatch.setattr(substring_dedup.textnp, "STEP_BYTES", 100)
    boxes = [(i, {"part": b"x" * 30}) for i in range(10)]
    steps = list(substring_dedup._in_steps(iter(boxes)))
    assert [len(s) for s in steps] == [4, 4, 2] and [b for s in steps for b in s] == boxes


def test_passages_of_too_few_shared_shingles_are_not_tried():
    runs = lambda *ids: np.repeat(np.array(ids, np.uint64), 20)
    x, y = runs(1, 2, 3, 4, 5, 6), runs(7, 8, 3, 9, 10, 11)
    assert not substring_dedup.passages(x, y, 46, 80)
    assert substring_dedup.passages(x, x, 46, 80)
    assert list(substring_dedup._distinct(np.array([1, 1, 2, 1, 3, 3]), 3)) == [2, 2, 3, 2]


def test_shared_runs_of_similar_passages():
    assert substring_dedup.shared_run(5, 46, 80) == 21
    assert substring_dedup.shared_run(5, 46, 100) == 46


def test_a_line_that_also_stands_elsewhere_does_not_break_a_passage():
    width = substring_dedup.PASSAGE - substring_dedup.WORDS + 1
    rng = np.random.default_rng(13)
    fresh = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    for _ in range(60):
        passage, far, size = fresh(56), int(rng.integers(40, 100)), int(rng.integers(6, 12))
        for at in (0, 22, 56 - size):
            line = passage[at : at + size]
            x = np.concatenate([fresh(10), passage, fresh(10)])
            for y in ([line, fresh(far), passage, fresh(9)], [fresh(9), passage, fresh(far), line], [line, fresh(far), passage, fresh(far), line], [line, fresh(far), passage, fresh(far), passage]):
                found = substring_dedup.passages(x, np.concatenate(y), width, 80)
                assert any(a <= 10 and b >= 65 for a, b, _, _ in found)
    same = np.full(30_000, 7, np.uint64)
    assert substring_dedup.passages(same, same, width, 80)


def test_repeated_rows_and_very_long_texts_have_passages(spark):
    rng = random.Random(19)
    passage = prose(rng, 70, 10**6)
    rows = [(1, f"{prose(rng, 40, 10**6)} {passage}"), (2, f"{passage} {prose(rng, 9, 10**6)}"), (2, "short"), (2, prose(rng, 200, 10**6)), (3, f"{prose(rng, 20_000, 10**6)} {passage} {prose(rng, 20_000, 10**6)}"), (3, f"{passage} x"), (None, passage)]
    docs = frame(spark, rows)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {2, 3}
    left = substring_dedup.remove(docs, spark.createDataFrame(found)).collect()
    assert len(left) == len(rows) and {r.text for r in left if r.doc_id == 1} == {rows[0][1]}
    assert min(len(words_of(r.text)) for r in left if r.doc_id == 3) < 10 and max(len(words_of(r.text)) for r in left if r.doc_id == 3) > 39_000


@pytest.mark.parametrize("hashes,votes", [(6, 2), (12, 4)])
def test_passages_of_some_similarity_equal_brute_force(spark, hashes, votes):
    """Pairs of documents with a passage of 60 words that differ in a share of them: those that hold one of 0.8 are found, others not."""
    rng = random.Random(23)
    rows, expected, n = [], {}, 0
    for edits in (0, 0, 1, 1, 2, 2, 8, 8):
        for _ in range(6):
            base = prose(rng, 60, 10**6).split()
            other = list(base)
            for k in rng.sample(range(5, 55), edits):
                other[k] = f"e{rng.randrange(10**6)}"
            x, y = prose(rng, 30, 10**6).split() + base, other + prose(rng, 30, 10**6).split()
            rows += [(n, " ".join(x)), (n + 1, " ".join(y))]
            best = 0.0
            for a in range(len(x) - 49):
                for b in range(len(y) - 49):
                    p, q = sets(" ".join(x[a : a + 50]), 5), sets(" ".join(y[b : b + 50]), 5)
                    best = max(best, len(p & q) / len(p | q)) if len(p & q) > 20 else best
            expected[n + 1] = best
            n += 2
    found = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows), hashes=hashes, votes=votes).collect()}
    surely = {i for i, s in expected.items() if s >= 0.8}
    assert len(found & surely) >= 0.9 * len(surely) and len(surely) > 20
    assert all(expected.get(i, 0) > 0.5 for i in found)


def test_a_hot_value_is_split_and_every_holder_is_found(spark):
    rng = random.Random(29)
    passage = prose(rng, 70, 10**6)
    rows = [(i, f"{prose(rng, 10, 10**6)} {passage} {prose(rng, 10, 10**6)}") for i in range(400)]
    docs = frame(spark, rows).repartition(7)
    assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == set(range(1, 400))


def test_candidate_windows_are_few_and_hold_the_similar_ones(spark):
    rng = random.Random(31)
    items = [(i, prose(rng, 80, 10**6)) for i in range(30)]
    near = []
    for i, text in items:
        for edits in (0, 1, 2):
            w = text.split()
            for k in rng.sample(range(80), edits):
                w[k] = f"e{k}"
            near.append((100 * i + edits, " ".join(w)))
    of = lambda rows: decontaminate.indexed(decontaminate.items_of(spark.createDataFrame(rows, "item_id long, text string"), 5).withColumn("grams", decontaminate.grams(F.col("words"), 5)), decontaminate.RADIUS, decontaminate.PERCENT)
    met = {(r.content, r.item_id) for r in decontaminate.candidates(of(near).withColumnRenamed("item_id", "content"), of(items)).collect()}
    similar = set()
    for c, x in near:
        for i, y in items:
            a, b = sets(x, 5), sets(y, 5)
            if 100 * len(a & b) >= 80 * len(a | b):
                similar.add((c, i))
    assert len(met & similar) >= 0.9 * len(similar) and len(similar) >= 60
    assert len(met) <= 2 * len(near)  # of 2,700 pairs of one size


def test_repeated_shingles_weigh(spark):
    row = spark.createDataFrame([([1, 1, 2, 3, 3, 3], [1, 3, 3, 4])], "x array<bigint>, y array<bigint>").select(F.size(F.array_intersect(decontaminate.weighed(F.col("x")), decontaminate.weighed(F.col("y")))).alias("n")).first()
    assert row.n == 3
    assert spark.createDataFrame([([],)], "x array<bigint>").select(F.size(decontaminate.weighed(F.col("x"))).alias("n")).first().n == 0


def test_repeated_documents_items_and_ties_of_windows(spark):
    rng = random.Random(37)
    item = prose(rng, 30, 10**6)
    rows = [(1, f"{item} {prose(rng, 40, 10**6)} {item}"), (1, f"{item} {prose(rng, 40, 10**6)} {item}"), (2, f"{prose(rng, 50_000, 10**6)} {item}"), (3, None), (None, "x")]
    bench = spark.createDataFrame([(5, item), (5, item), (6, item.upper()), (7, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.contaminated(frame(spark, rows), bench).collect())
    assert got == [(1, 5, 0), (1, 6, 0), (2, 5, 50_000), (2, 6, 50_000)]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n, 10**6)) for i, n in enumerate([3, 12, 20, 40, 80])] + [(9, None), (10, " ")]
    rows = [(i, prose(rng, 150, 10**6)) for i in range(6)]
    for k, (_, text) in enumerate(items[:5]):
        w = text.split()
        if k >= 3:
            w[len(w) // 2] = "changed"
        rows.append((20 + k, f"{prose(rng, 60, 10**6)} {' '.join(w)} {prose(rng, 10, 10**6)}"))
        rows.append((30 + k, " ".join(w[: len(w) // 2]) + " " + prose(rng, 60, 10**6)))
    rows += [(40, None), (41, items[3][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    expected = set()
    for i, text in items:
        q = words_of(text)
        for d, doc in rows:
            w = words_of(doc)
            if not q or not w:
                continue
            k, n = min(5, len(q)), min(len(q), len(w))
            for s in range(len(w) - n + 1):
                a, b = sets(" ".join(w[s : s + n]), k), sets(text, k)
                if 100 * len(a & b) >= 80 * len(a | b):
                    expected.add((d, i))
    assert got == expected and len(got) >= 5
