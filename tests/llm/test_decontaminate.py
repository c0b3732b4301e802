import random
import re

from corvata.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w = words(text)
    hit, ids = set(), set()
    for item_id, t in items:
        p = words(t)
        for i in range(max(1, len(p) - window + 1) if p else 0):
            s = p[i : i + window]
            for j in range(len(w) - len(s) + 1):
                if w[j : j + len(s)] == s:
                    hit |= set(range(j, j + len(s)))
                    ids |= {str(item_id)} - {"None"}
    return len(w), len(hit), sorted(ids)


def corpus():
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["The", "cat", "é1", "x-y", "on", "a."]) for _ in range(n))
    items = [(10, text(14)), (2, text(12)), (3, "the cat"), (4, None), (5, ""), (None, "on on on"), (2, text(11)), (7, "!?")]
    docs = [None, "", "?!", text(3), *[text(r.randint(1, 40)) for _ in range(30)], *[f"{text(5)}\n{(t or '').upper()}, {text(6)}" for _, t in items]]
    return docs + docs[5:7], items


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for table_bytes in (d.TABLE_BYTES, 60):  # one pass, several
        got = d.decontaminate(df, bench, window=5, table_bytes=table_bytes).orderBy("row.doc_id").collect()
        assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [brute(t, items, 5) for t in docs]
        assert all(r.contaminated == (r.n_hit > 0) and r.row.n_hit == r.row.doc_id for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(df, none).first().n_hit == 0
    assert d.decontaminate(df.limit(0), none).count() == 0
