"""Each stage on its own input, against a brute-force version of it."""

import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from test_models import plain_scores
from test_neardup import brute as near_copies
from test_neardup import shingle_set

import corpus_pipeline as p
from corvata.llm.queries import OP3_SQL

SF = "/root/testdata/sf0.001"


def cut_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if i < 4:
            assert out.columns == columns
        if i < 2 or i == 3:
            assert all(before[k] == r for k, r in after.items())
        if i == 0:
            keys = [k for k in before]
            scores = plain_scores([before[k].text for k in keys], [labels.get(k) for k in keys], keys)
            clear = {k: s for k, s in zip(keys, scores, strict=True) if abs(s - 0.5) > 0.01}
            assert len(clear) > 0.9 * len(keys) and all((k in after) == (s >= 0.5) for k, s in clear.items())
        elif i == 1:
            rows = [(k, r.text) for k, r in before.items()]
            assert set(after) == {k for (k, _, _, kept), n in near_copies(rows).items() if kept or not shingle_set(before[k].text)}
        elif i == 2:
            left = cut_repeats([r.text for r in before.values()], p.REPEAT_BYTES)
            for r, text in zip(before.values(), left, strict=True):
                assert after[r.doc_id].text == text and after[r.doc_id].n_chars == len(text)
        elif i == 3:
            items = [windows(r.text)[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            long = {x for w in items for x in w}
            sizes = {len(x) for x in long}
            for k, r in before.items():
                w, _ = windows(r.text)
                hit = any(tuple(w[j : j + n]) in long for n in sizes for j in range(len(w) - n + 1))
                assert (k in after) != hit
        else:
            con = duckdb.connect()
            con.register("documents", pd.DataFrame([r.asDict() for r in before.values()]))
            want = {(d, e): t for d, _, _, _, e, _, t in con.execute(OP3_SQL).fetchall()}
            assert {(r.doc_id, r.epoch): r.take_tokens for r in out.collect()} == want
            assert all(len(r.text.split()) == r.take_tokens for r in out.collect())
        docs = out


def test_passages_of_over_50_words_go(spark):
    """Words of three letters in 51-word passages that two documents share."""
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    passage = " ".join(words[:51])
    texts = [f"one {i} says {' '.join(words[60 + i :: 3])}. {passage} and ends {i * 7}" for i in range(2)] + ["clean " + " ".join(words[52:90])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in p.without_repeats(spark, docs, "").collect()}
    assert all(passage not in t and words[25] not in t for t in (got[0], got[1])) and got[2] == texts[2]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    long = "one two three four five six seven eight nine ten eleven twelve. " * 30
    rows = [(1, long, "en", "src0", 5), (2, long, None, None, None), (None, None, "en", "src1", 0), (3, "", "fr", "src2", 0), (3, "", "fr", "src2", 0), (4, "Ééé ñ " * 200, "es", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "key", "hash", "found", "epoch", "n_tokens", "kept", "items", "score", "_key", "_i", "set", "sid"):
        docs = docs.withColumn(c, F.lit("mine"))
    for i, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            assert {r["row"] for r in docs.collect()} <= {"mine"}
    assert {r.epoch_of_document for r in docs.collect()} <= {"mine"}
