import random
import re
from collections import Counter

import pytest

from corvata.llm import neardup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    big = 10**9
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if k is None else k)
    out = []
    for i, (k, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == big else c
        out.append((k, len(sets[i]), c, c == k))
    return Counter(out)


def corpus(seed):
    r = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    out = [None, "", " \n ", "one", "One", "one two", "a b c d e"]
    passage = text(40)
    for _ in range(12):
        base = text(r.randint(6, 90))
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(r.choice([" ", "\n"]).join(t))
    out += [" ".join(passage + text(r.randint(5, 40))) for _ in range(60)]
    r.shuffle(out)
    return out + out[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(None if i % 50 == 9 else 1000 - i, t) for i, t in enumerate(texts[:-3])] + [(None if i % 50 == 9 else 1000 - i, t) for i, t in enumerate(texts[-3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.components(df).collect()
    assert Counter((r.key, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_prefix_filter_with_repeated_rows(spark, monkeypatch):
    """Without leaders all units reach the prefix filter; rows that repeat key and text, and null keys that repeat a text, don't shorten its prefixes."""
    r = random.Random(5)
    rows = []
    for i in range(20):
        base = [f"w{r.randrange(3000)}" for _ in range(60)]
        other = list(base)
        other[30] = f"x{i}"
        rows += [(2 * i, " ".join(base)), (None if i % 4 == 0 else 2 * i + 1, " ".join(other))]
    rows *= 6
    led = neardup._led
    monkeypatch.setattr(neardup, "_led", lambda *a: led(*a).limit(0))
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((x.key, x.n_shingles, x.component_id, x.kept) for x in got) == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (3, None, "z"), (4, "", "z"), (1, "a b c d e f g h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [1, 3, 4]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_long_text_in_parts():
    import numpy as np
    import pyarrow as pa

    from corvata.llm.textblocks import blocks

    r = random.Random(3)
    text = " ".join(f"w{r.randrange(90)}" + "x" * r.choice([0, 0, 300]) for _ in range(900))
    (b,) = blocks(pa.array([text]))
    whole, parts = neardup.shingles(b), neardup.shingles(b, limit=64)
    assert np.array_equal(whole[1], parts[1]) and len(parts[1]) == len(shingle_set(text))


def test_hot_join(spark, monkeypatch):
    from corvata.llm import hot

    monkeypatch.setattr(hot, "LEAST", 100)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) k", "id v")
    table = rows.groupBy("k").count().selectExpr("k", "k * 2 w")
    got = hot.hot_join(rows, table, "k").collect()
    assert len(got) == 3000 and all(x.w == 2 * x.k for x in got)


def test_rows_that_differ_elsewhere(spark):
    """Which of several rows with one key and text stays doesn't hang on the order of rows."""
    rows = [(1, "a b c d e f g h", f"x{i}") for i in range(40)] + [(None, "  ", "y")] * 3
    picks = {tuple(sorted((r.doc_id or 0, r.other) for r in neardup.keep_one(spark.createDataFrame(random.Random(k).sample(rows, 43), "doc_id long, text string, other string").repartition(3)).collect())) for k in range(2)}
    assert len(picks) == 1 and len(next(iter(picks))) == 4
