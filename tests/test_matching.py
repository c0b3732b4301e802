"""Assignments against brute force, alignment and drift on constructed cases."""

from itertools import permutations
from random import Random

import numpy as np
import pytest

from corvata.operators import matching
from corvata.plans import profiles
from corvata.streaming.drift import decide


def best_total(w):
    n, m = w.shape
    if n > m:
        return best_total(w.T)
    return max(sum(max(w[i, j], 0) for i, j in enumerate(p)) for p in permutations(range(m), n)) if n else 0


@pytest.mark.parametrize("seed", range(12))
def test_hungarian(seed):
    r = np.random.default_rng(seed)
    w = r.integers(-3, 9, (r.integers(1, 6), r.integers(1, 6))).astype(float)
    got = matching.hungarian(w)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert sum(w[i, j] for i, j in got) == best_total(w)


def cardinality(t):
    if not t:
        return 0
    return max([cardinality(t[1:])] + [1 + cardinality([[None if k == j else x for k, x in enumerate(row)] for row in t[1:]]) for j, s in enumerate(t[0]) if s is not None])


@pytest.mark.parametrize("seed", range(8))
def test_most_pairs(seed):
    r = Random(seed)
    t = [[r.choice([None, None, 0.2, 0.7, 0.9]) for _ in range(4)] for _ in range(5)]
    assert len(matching.most_pairs(t)) == cardinality(t)
    wide = [[x for x in row for _ in range(6)] for row in t]  # beyond the exact size
    assert len(matching.most_pairs(wide)) == sum(any(x is not None for x in row) for row in wide)


def test_alignment_keeps_order():
    same = [[1.0, 0.0], [0.0, 1.0]]
    assert matching.align(same, 0.55) == [(0, 0), (1, 1)]
    crossed = [[0.0, 1.0], [1.0, 0.0]]
    assert len(matching.align(crossed, 0.55)) == 1
    assert matching.align([[1.0, 1.0]], 0.55) in ([(0, 0)], [(0, 1)])


def test_greedy_and_scores(spark):
    schema = "document_id long, page int, table_id string, row_order int, input int, description string, request_no string, cents long"
    gold = spark.createDataFrame([(1, 1, "t", 0, 0, "Needle", None, 500), (1, 1, "t", 1, 1, "Needle", None, 500), (1, 2, None, 0, 2, "Complete Blood Count", "R1", 5000)], schema)
    actual = spark.createDataFrame([(1, 1, "t", 1, 0, "needle", "", 500), (1, 2, "u", 5, 1, "zzz", "r-1", 5001), (1, 1, None, 0, 2, "Needle", None, 502)], schema)
    v1 = {(r.gold_order, r.actual_order): round(r.score, 6) for r in matching.scored_pairs(gold, actual, 1).collect()}
    v2 = {(r.gold_order, r.actual_order): round(r.score, 6) for r in matching.scored_pairs(gold, actual, 2).collect()}
    assert v1 == {(0, 0): 1.0, (1, 0): 1.0}
    assert v2 == {(0, 0): 1.3, (1, 0): 1.35}
    assert [(r.gold_order, r.actual_order) for r in matching.greedy(matching.scored_pairs(gold, actual, 2)).collect()] == [(1, 0)]
    assert [(r.gold_order, r.actual_order) for r in matching.greedy(matching.scored_pairs(gold, actual, 1)).collect()] == [(0, 0)]


def test_maximum_weight_and_mutual_best(spark):
    pairs = spark.createDataFrame([("d", "a", "x", 0.9), ("d", "a", "y", 0.8), ("d", "b", "x", 0.8), ("e", "a", "x", 0.1)], "k string, l string, r string, score double")
    got = {(x.k, x.l, x.r) for x in matching.maximum_weight(pairs, ["k"], "l", "r").collect()}
    assert got == {("d", "a", "y"), ("d", "b", "x"), ("e", "a", "x")}
    assert {(x.k, x.l, x.r) for x in matching.largest_assignment(pairs, ["k"], "l", "r").collect()} == got
    linked = {(x.k, x.l, x.r, x.state) for x in matching.mutual_best(pairs, ["k"], "l", "r", ["score"]).collect()}
    assert linked == {("d", "a", "x", "linked"), ("e", "a", "x", "linked")}
    best = {(x.k, x.l, x.r): x.competing for x in matching.competing_best(pairs, ["k"], "l", "r").collect()}
    assert best == {("d", "a", "x"): 0.8, ("d", "a", "y"): 0.9, ("d", "b", "x"): 0.9, ("e", "a", "x"): 0.0}


def test_drift_cases(spark):
    every_fourth = [(1, i, i % 4 == 0, False, False) for i in range(40)]
    hard = [(2, i, False, False, i == 39) for i in range(40)]
    few = [(3, i, True, False, False) for i in range(39)]
    old_hard = [(4, i, False, False, i == 0) for i in range(40)]
    rows = every_fourth + hard + few + old_hard
    df = spark.createDataFrame(rows, "profile_key long, seq long, escalated boolean, disagreed boolean, hard boolean")
    got = {r.profile_key: (r.drifted, r.immediate, r.breached) for r in profiles.drift(df, ["profile_key"], ["seq"]).collect()}
    assert got == {1: (True, False, 2), 2: (True, True, 1), 3: (False, False, 0), 4: (False, False, 0)}
    for k in got:
        own = [r for r in rows if r[0] == k]
        assert decide([r[2] or r[3] for r in own], [r[4] for r in own]) == got[k]


def test_drift_stream_agrees_with_batch(spark, tmp_path):
    from corvata.streaming.drift import drift_stream

    r = Random(5)
    rows = [(k, i, r.random() < 0.3, False, r.random() < 0.01) for k in range(3) for i in range(60)]
    schema = "profile_key long, seq long, escalated boolean, disagreed boolean, hard boolean"
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = drift_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("drift_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {x.profile_key: (x.drifted, x.immediate, x.breached) for x in spark.sql("select * from drift_out where seq = 59").collect()}
    batch = {x.profile_key: (x.drifted, x.immediate, x.breached) for x in profiles.drift(spark.createDataFrame(rows, schema), ["profile_key"], ["seq"]).collect()}
    assert last == batch
