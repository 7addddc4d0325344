"""The walk over arrays against the walk over tables."""

import random

import pytest

from burstloom.operators import walk


def _given(spark, alone):
    rng = random.Random(4)
    held = [(f"s{rng.randrange(40)}", p) for p in range(60) for _ in range(4)] + [(f"alone{i}", 1000 + i) for i in range(alone)]
    kb = [(f"s{i}", rng.random()) for i in range(0, 40, 2)]
    return spark.createDataFrame(held, "node string, post_id long"), spark.createDataFrame(kb, "node string, q double")


def _of(df):
    return {r["node"]: r["pi"] for r in df.collect()}


@pytest.mark.parametrize("alone", [0, 3])
def test_shares_equal_those_of_tables(spark, alone):
    held, kb = _given(spark, alone)
    want = _of(walk.power_iteration(walk.transition_prob(walk.jaccard_edges(held)), walk.teleport(held, kb), rounds=4))
    for most in (1 << 23, 3):
        got = _of(walk.walk_shares(held, kb, rounds=4, block_pairs=100, most_nodes=most))
        assert got == pytest.approx(want, abs=1e-15)


def test_steps_after_the_shape_is_still_are_a_power(spark, monkeypatch):
    """Nodes without posts in common lose mass for ever: all 500 rounds count, though far fewer are run."""
    held, kb = _given(spark, 3)
    want = _of(walk.walk_shares(held, kb, rounds=500))
    run, before = [], walk.math.fsum
    monkeypatch.setattr(walk.math, "fsum", lambda x: run.append(1) or before(x))
    got = _of(walk.walk_shares(held, kb, rounds=500, tolerance=1e-13))
    assert got == pytest.approx(want, abs=1e-11)
    assert sum(want.values()) < 0.9 and len(run) < 500


def test_the_queries_of_the_walk_take_the_arrays(spark, monkeypatch):
    """power_iteration and select_best: no step over tables; equal shares stand by their node."""
    from burstloom.plans import eval_queries

    held, kb = _given(spark, 3)
    monkeypatch.setattr(eval_queries, "_held", lambda s, d: held)
    monkeypatch.setattr(eval_queries, "_kb", lambda s, d: kb)
    monkeypatch.setattr(eval_queries, "ROUNDS", 2)
    monkeypatch.setattr(walk, "walk_step", None)
    all_shares = _of(eval_queries.QUERIES["power_iteration"](spark, ""))
    best = [(r["node"], r["pi"]) for r in eval_queries.QUERIES["select_best"](spark, "").collect()]
    assert best == sorted(all_shares.items(), key=lambda x: (-x[1], x[0]))[:50]
