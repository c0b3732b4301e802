"""Language and quality: accuracy on held-out rows, and odd rows."""

from pyspark.sql import functions as F

from corvata.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, SF)
    both = got.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 40")
    assert both.where("lang = lang_pred").count() >= 0.98 * both.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat assis", "fr"), (3, None, "en"), (4, "123 !?", "fr"), (5, "", None), (6, "日本語", None), (7, "the the", None)]
    df = spark.createDataFrame(rows, "score long, text string, lang string").withColumnRenamed("score", "doc_id").withColumn("lang_pred", F.lit(1))
    model = language.fit(df)
    got = {r.row.doc_id: r for r in language.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[7].lang_pred == "en" and got[6].lang_pred in ("en", "fr")
    assert all(got[i].rejected and got[i].score == 0 for i in (3, 4, 5))
    assert language.fit(df.limit(0)) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_quality_held_out(spark):
    got = queries.op9_quality_classifier(spark, SF)
    both = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.95 * len(both) > 0
    assert got.where("(score >= 0.5) <> (predicted = 1) or score < 0 or score > 1").count() == 0


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, "Good words in a row. Yes.", 5), (2, "BAD!! BAD!! BAD!!", 5), (3, None, 5), (4, "", 5), (None, "x", 5), (1, "Good words in a row. Yes.", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (9, 1), (3, 7)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = {r.row.doc_id: r for r in quality.score(df, model).collect()}
    assert got[1].score > got[2].score and got[3].score == got[4].score
    assert quality.fit(df, labels.where("quality = 1")) is None
    assert {(r.score, r.predicted) for r in quality.score(df, None).collect()} == {(0.5, 1)}
    assert quality.score(df.limit(0), model).count() == 0


def test_pairs_rank_good_over_bad():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = (x[:, 0] - x[:, 1] + 0.1 * r.normal(size=600) > 0.7).astype(int)
    m = quality.train(x, y, pairs=5000)
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.95
    assert abs((m.score(x) >= 0.5).mean() - y.mean()) < 0.01  # the quantile is that of the labels


def plain_trigrams(text):
    """Hashed trigrams of letters, one at a time."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    out = {}
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if b != 32:
            h = ((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 20
            out[h] = out.get(h, 0) + 1
    return out


def test_language_against_plain_nearest_centroid(spark):
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    m = language.fit(docs)
    for r in language.identify(docs, m).collect():
        text = r.row.text
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = {h: math.log1p(n) * float(m.idf[h]) for h, n in plain_trigrams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cos = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in m.centroids]
        best = max(range(len(cos)), key=lambda i: cos[i])
        near = sorted(cos)[-2:]
        if near[1] - near[0] > 1e-5:
            assert r.lang_pred == m.languages[m.owner[best]] and abs(r.score - max(0.0, cos[best])) < 1e-4
            assert r.rejected == (1 - cos[best] > m.radius[m.owner[best]]) or abs(1 - cos[best] - m.radius[m.owner[best]]) < 1e-4


def test_long_text_counts_in_parts():
    import numpy as np
    import pyarrow as pa

    from corvata.llm.textblocks import blocks

    (b,) = blocks(pa.array(["Ünïcode and plain wörds, " * 200]))
    assert np.array_equal(language.trigram_counts(b), language.trigram_counts(b, limit=101))
    counts = {h: n for h, n in enumerate(language.trigram_counts(b)[0].tolist()) if n}
    assert counts == plain_trigrams("Ünïcode and plain wörds, " * 200)


def plain_scores(texts, labels, keys):
    """Scores of texts by plain gradient descent on the same pairs of all labelled ones."""
    import numpy as np
    import pyarrow as pa

    from corvata.llm.textblocks import blocks

    x = np.concatenate([quality.features(b) for t in texts for b in blocks(pa.array([t or ""]))]).astype(np.float32)
    own = sorted((y, v.tobytes()) for v, y in zip(x, labels, strict=True) if y in (0, 1))
    y, lx = np.array([a for a, _ in own]), np.array([np.frombuffer(v, np.float32) for _, v in own])
    lx = lx.astype(float)
    mean, scale = lx.mean(axis=0), lx.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = ((lx - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(11)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, quality.PAIRS)] - z[rng.choice(bad, quality.PAIRS)]
    d, often = np.unique(d, axis=0, return_counts=True)
    often = often / often.sum()
    w, v, step = np.zeros(d.shape[1]), np.zeros(d.shape[1]), 4 / np.linalg.eigvalsh((d * often[:, None]).T @ d).max()
    for i in range(3000):  # gradient descent with momentum
        ahead = w + (i / (i + 3)) * v
        p = 1 / (1 + np.exp((d @ ahead).clip(-500, 500)))
        new = ahead + step * ((d * often[:, None]).T @ p - quality.RIDGE * ahead)
        v, w = new - w, new
    rank = sorted((z * w).sum(axis=1))
    cut = np.quantile(rank, len(bad) / len(y))
    raw = (((x - mean) / scale).clip(-8, 8) * w).sum(axis=1)
    return 1 / (1 + np.exp(-(raw - cut).clip(-500, 500)))


def test_quality_against_plain_gradient_descent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.row.doc_id: r.score for r in quality.score(docs, model).collect()}
    rows = docs.collect()
    want = plain_scores([r.text for r in rows], [labels.get(r.doc_id) for r in rows], [r.doc_id for r in rows])
    assert max(abs(got[r.doc_id] - s) for r, s in zip(rows, want, strict=True)) < 0.02


def test_plain_features():
    import math

    import numpy as np
    import pyarrow as pa

    from corvata.llm.textblocks import blocks

    text = "The cat sat sat. The DOG!!\nThe cat sat sat. The DOG!!\n3 x"
    (b,) = blocks(pa.array([text]))
    x = quality.features(b)[0]
    words = text.split()
    k = len(quality._CLASSES) + 1
    want = [math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / len(words), float(np.std([len(w) for w in words]))]
    low = [w.lower() for w in words]
    again = (len(low) - len(set(low))) / len(low)
    adjacent = sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(low)
    want += [again, again**2, adjacent, math.sqrt(adjacent), sum(w[0].isupper() for w in words) / len(words), sum(len(w) == 1 for w in words) / len(words)]
    assert np.allclose(x[k : k + len(want)], want)
    assert len(x) == k + 14 + 2 * quality.HASHED and abs((x[-quality.HASHED :] ** 2).sum() - 1) < 1e-9


def test_scores_that_do_not_fit_raise(spark):
    import pytest

    from corvata.llm import topk

    df = spark.createDataFrame([(0, [1e300]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.search(df, 20, F.col("vec_id") % 20 == 0).collect()


def test_languages_are_bounded(spark):
    df = spark.createDataFrame([(i, f"word number {i} the", f"l{i % 7}" if i < 70 else f"junk{i}") for i in range(100)], "doc_id long, text string, lang string")
    assert language.fit(df, languages=7).languages == [f"l{i}" for i in range(7)]


def test_features_of_a_long_text_in_parts():
    import numpy as np
    import pyarrow as pa

    from corvata.llm.textblocks import blocks

    for text in ("One two  two\nthree é, four!\n\n" * 300 + "One two  two", "x" * 9000, " \n \n" * 500):
        (b,) = blocks(pa.array([text]))
        assert np.allclose(quality.features(b), quality.features(b, limit=100))


def of_all_pairs(x, y):
    """Weights and threshold by Newton's method on every pair of a good and a bad row, laid out."""
    import numpy as np

    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)
    z = ((x - mean) / np.where(scale > 1e-9, scale, 1.0)).clip(-8, 8)
    good, bad = z[y == 1], z[y == 0]
    d = (good[:, None] - bad[None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w, np.quantile(z @ w, (y == 0).mean())


def test_weights_are_those_of_all_pairs():
    import numpy as np

    for seed, n, d, noise in ((0, 200, 5, 1.0), (1, 900, 12, 0.01), (2, 40, 3, 0.0)):
        r = np.random.default_rng(seed)
        x = r.normal(size=(n, d)).astype(np.float32)
        x[:, 2] = 3.0
        y = (x[:, 0] - x[:, 1] + noise * r.normal(size=n) > 0.7).astype(int)
        m, (w, cut) = quality.train(x, y), of_all_pairs(x, y)
        assert np.abs(m.weights - w).max() < 1e-4 and abs(m.threshold - cut) < 1e-4


def test_every_labelled_row_is_learned_from_in_the_driver_and_by_jobs(spark, monkeypatch):
    """As many rows as the former sample had by half again, one of which alone has a feature."""
    import numpy as np

    words = F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(w) for w in ("lorem", "Ipsum", "a", "dolor!!", "x1")]), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(5)).cast("int") + 1) for i in range(9)])
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(words, F.when(F.col("doc_id") == 29_999, " {}").otherwise("")))
    labels = docs.select("doc_id", F.when(F.length("text") % 5 == 0, 0).otherwise(1).alias("quality"))
    by_jobs = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "LOCAL_ROWS", 1 << 20)
    here = quality.fit(docs, labels)
    assert np.abs(by_jobs.weights - here.weights).max() < 1e-5 and abs(by_jobs.threshold - here.threshold) < 1e-5
    assert by_jobs.mean[quality._CLASS[ord("{")]] > 0
    got = quality.score(docs, by_jobs).groupBy("predicted").count().collect()
    bad = labels.where("quality = 0").count()
    assert abs({r.predicted: r["count"] for r in got}[0] - bad) <= 0.001 * 30_000


def test_quantile_where_many_scores_are_equal():
    import numpy as np

    r = np.random.default_rng(5)
    for x in (np.repeat(r.normal(size=5), 3000)[:, None], r.normal(size=(9000, 1)), np.ones((9000, 1))):
        m = quality.Model(np.zeros(1), np.ones(1), np.ones(1), 0.0)
        for share in (0.0, 0.123, 0.4, 0.5, 1.0):
            got = quality._quantile(lambda f, x=x: [f(iter([(np.zeros(len(x)), x)]))], m, len(x), share, most=64)
            assert abs(got - np.quantile(x, share)) < 1e-12
