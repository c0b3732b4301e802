import math
import random

from pyspark.sql import functions as F

from corvata.llm import topk


def brute(rows, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for a, (q, v) in enumerate(ok):
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for b, (i, w) in enumerate(ok) if a != b)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def corpus(n):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 0.2) + (i % 3) for _ in range(8)]) for i in range(n)]
    rows += [(20, [1.0] * 8), (40, rows[40][1]), (7, rows[40][1]), (60, None), (80, [1.0, None] + [0.0] * 6), (100, [float("nan")] * 8), (None, [1.0] * 8), (121, []), (140, [0.5, 0.5]), (160, [])]
    return rows


def test_against_brute_force(spark):
    for n, k, block in ((90, 5, topk.QUERY_BLOCK_BYTES), (300, 20, 256)):
        rows = corpus(n)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
        got = topk.search(df, k, F.col("vec_id") % 20 == 0, query_block_bytes=block).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, k)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, 20, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.search(df.limit(0), 20, F.lit(True)).count() == 0
    assert topk.search(df, 20, F.lit(False)).count() == 0
