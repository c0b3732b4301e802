import random
from collections import defaultdict

from pyspark.sql import functions as F

from corvata.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string")


def rows_of(n, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 9)), r.choice(["en", "fr", None]), r.choice(["src0", "src0", "src1", "src6", "web", None]), "x") for i in range(n)]
    return rows + [(None, "a b c", "en", "src0", "x"), (5, None, "en", "src0", "x"), rows[3], rows[3]]


def fill(budget, children):
    """children: name -> (capacity, weight); whole-number water filling in order of capacity by weight."""
    order = sorted(children, key=lambda c: (children[c][0] / children[c][1], c))
    got, left, weight = {}, budget, sum(w for _, w in children.values())
    while order and children[order[0]][0] * weight <= left * children[order[0]][1]:
        c = order.pop(0)
        got[c] = children[c][0]
        left, weight = left - children[c][0], weight - children[c][1]
    up = 0
    for c in order:
        w = children[c][1]
        got[c] = left * (up + w) // weight - left * up // weight
        up += w
    return got


def test_budgets_and_prefixes(spark):
    rows = rows_of(400)
    domain = mixing.domain_of_source(F.col("source"))
    weights = {"dom0": 5, "dom1": 1, "dom2": 2, "unknown": 1, "*/en": 3, "dom0/fr": 7, "*/*/src6": 0}
    got = mixing.mix(docs_of(spark, rows), domain, weights, budget=1100, epochs=2).collect()
    leaf = defaultdict(list)
    for i, t, lang, source, _ in rows:
        n = len((t or "").split())
        d = f"dom{int(source[3:]) % 4}" if source and source.startswith("src") else "unknown"
        if n and source != "src6":
            leaf[d, lang or "unknown", source or "unknown"].append((i, n))
    w1 = lambda d: weights.get(d, 1)
    w2 = lambda d, l: weights.get(f"{d}/{l}", weights.get(f"*/{l}", 1))
    cap = {k: 2 * sum(n for _, n in v) for k, v in leaf.items()}
    up = lambda depth, key: sum(c for k, c in cap.items() if k[:depth] == key)
    domains = {k[0] for k in cap}
    want = {}
    for d, b in fill(1100, {d: (up(1, (d,)), w1(d)) for d in domains}).items():
        langs = {k[1] for k in cap if k[0] == d}
        for l, c in fill(b, {l: (up(2, (d, l)), w2(d, l)) for l in langs}).items():
            for s, x in fill(c, {k[2]: (v, 1) for k, v in cap.items() if k[:2] == (d, l)}).items():
                want[d, l, s] = x
    have = defaultdict(int)
    seen = defaultdict(list)
    for r in got:
        have[r.domain, r.lang, r.source] += r.take_tokens
        seen[r.domain, r.lang, r.source, r.epoch].append(r)
        assert 0 < r.take_tokens <= r.n_tokens
    assert dict(have) == {k: v for k, v in want.items() if v}
    for (d, l, s, e), v in seen.items():
        whole = sum(n for _, n in leaf[d, l, s])
        assert (sum(r.take_tokens for r in v) == whole) == (e < want[d, l, s] // whole) and sum(r.take_tokens < r.n_tokens for r in v) <= 1


def test_same_seed_same_rows_and_text(spark):
    df = docs_of(spark, rows_of(120))
    runs = [mixing.mix(df.repartition(n), F.lit("d"), {}, budget=200) for n in (1, 3)]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))
    for r in mixing.with_text(runs[0], df).collect():
        assert len(r.text.split()) == r.take_tokens


def test_everything_and_nothing(spark):
    df = docs_of(spark, rows_of(50))
    assert mixing.mix(df.limit(0), F.lit("d"), {}).count() == 0
    full = mixing.mix(df, F.lit("d"), {}, budget=10**9, epochs=2)
    assert full.groupBy("epoch").count().count() == 2 and full.where("take_tokens < n_tokens").count() == 0
