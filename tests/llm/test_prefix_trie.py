"""The prefix tree of conversations against a tree built in memory."""

from __future__ import annotations

import hashlib
import random

import pytest

from siltworks.llm import prefix_trie


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(convs):
    """Rows of all nodes; convs: {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = [c for c in ids if len(convs[c]) == len(path)]
        rows.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids), leaves, saved, sha(ends)))
    return sorted(rows, key=repr)


def grown(rng, n):
    """Conversations that go on from, or copy, beginnings of others."""
    turn = lambda: (rng.choice(["user", "assistant", ""]), " ".join(rng.choice("abc") for _ in range(rng.randrange(4))))
    convs = {}
    for k in range(n):
        start = rng.choice(list(convs.values()))[: rng.randrange(45)] if convs and rng.random() < 0.8 else []
        convs[k * 3 - 20] = start + [turn() for _ in range(rng.choice([0, 0, 1, 2, 6, 30]))]
    return convs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "id_slice"), [(1, 4096), (2, 4)])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, id_slice):
    monkeypatch.setattr(prefix_trie, "ID_SLICE", id_slice)
    rng = random.Random(seed)
    convs = grown(rng, 40)
    rows = [(c, None if d == 0 else d, r or None, t or None, "x") for c, turns in convs.items() for d, (r, t) in enumerate(turns)]
    rows.append((None, 1, "user", "lost", "x"))
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    also = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_keys(turns), also)) == brute(convs)


def test_slices_of_many_turns(spark):
    """Two copies and a longer one of 600 turns go through slices of doubling and of full size."""
    turn = lambda k: ("user", f"t{k} é")
    convs = {1: [turn(k) for k in range(600)], 5: [turn(k) for k in range(600)], 3: [turn(k) for k in range(605)], 9: [turn(k) for k in range(3)]}
    turns = spark.createDataFrame([(c, d, *t) for c, x in convs.items() for d, t in enumerate(x)], "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_keys(turns))) == brute(convs)


def test_empty_single_and_repeated_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_keys(empty))) == []
    one = spark.createDataFrame([(7, 0, "user", "a b"), (7, 0, "user", "a b")], schema)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_keys(one))) == brute({7: [("user", "a b")] * 2})
    only = spark.createDataFrame([(4,), (2,)], "conv_id long")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_keys(empty), only)) == brute({4: [], 2: []})
