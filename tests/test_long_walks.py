"""Long chains take rounds by the logarithm of their length, also between and beside places where several parents meet."""

from __future__ import annotations

from siltworks.operators import trees

from test_walks import brute, walk


def test_rounds_of_a_long_chain(spark, monkeypatch):
    calls, plain = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df: calls.append(1) or plain(df))
    chain = [(i, i + 1) for i in range(600)]
    meeting = [(300, 1000), *[(i, i + 1) for i in range(1000, 1100)], (1100, 450), (20, 1050), (1050, 20), (600, 0)]
    lost = [(5001, 5002), (5002, 5003), (5003, 5001), (5003, 5004), (6000, 450)]
    assert walk(spark, [*chain, *chain[:9], *meeting, *lost], [0, 0]) == brute([*chain, *meeting, *lost], [0])
    assert len(calls) < 40
