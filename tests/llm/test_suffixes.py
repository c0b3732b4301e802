import hashlib
import random
from collections import Counter

import pytest

from corvata.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 5)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(r.randint(5, 40)) for _ in range(6)]
    docs = [None, "", "a" * 300, "ab" * 90, "é" * 70]
    for _ in range(60):
        parts = [r.choice([*shared, text(r.randint(0, 30))]) for _ in range(r.randint(1, 5))]
        t = "".join(parts)
        if r.random() < 0.3 and t:
            i = r.randrange(len(t))
            t = t[:i] + "X" + t[i + 1 :]
        docs.append(t)
    return docs + docs[10:14]


@pytest.mark.parametrize(("seed", "length"), [(1, 40), (2, 24), (3, 7), (4, 60)])
def test_against_brute_force(spark, seed, length):
    texts = corpus(seed)
    rows = [(None if i == 7 else i if i < 64 else i - 54, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = suffixes.dedup(df, length=length).selectExpr("row.doc_id", "row.text", "n_bytes", "n_removed", "size(removed) n", "kept_sha256", "row.kept").collect()
    want = Counter((rows[i][0], rows[i][1], *x) for i, x in enumerate(brute(texts, length)))
    assert Counter(tuple(r)[:6] for r in got) == want
    assert {r.kept for r in got} == {"x"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(df).count() == 0


@pytest.mark.parametrize(("seed", "length", "shorter"), [(1, 40, 20), (2, 25, 13), (5, 60, 60)])
def test_two_lengths_against_brute_force(spark, seed, length, shorter):
    texts = corpus(seed)
    rows = [(None if i == 7 else i if i < 64 else i - 54, t) for i, t in enumerate(texts)]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, shorter=shorter).selectExpr("row.doc_id", "row.text", "n_bytes", "n_removed", "size(removed) n", "kept_sha256", "n_repeated").collect()
    want = Counter((*rows[i], *x, y[1]) for i, (x, y) in enumerate(zip(brute(texts, length), brute(texts, shorter), strict=True)))
    assert Counter(map(tuple, got)) == want


def test_query_tells_of_repeated_passages_under_400_bytes(spark, tmp_path):
    from corvata.llm import queries

    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = text(51)
    docs = [(0, f"{text(60)} {passage} {text(30)}"), (1, f"{text(20)} {passage}"), (2, text(150)), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) == 254 and got[0].n_repeated >= 254 and got[1].n_repeated >= 254
    assert [got[i].n_repeated for i in (2, 3, 4)] == [0, 0, 0] and not any(x.n_removed for x in got.values())
