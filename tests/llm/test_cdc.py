import random

import pyarrow as pa

from corvata.llm import cdc
from corvata.llm.textblocks import blocks


def pieces(text):
    data = text.encode()
    if not data:
        return []
    (b,) = blocks(pa.array([text]))
    ends = cdc.cuts(b)
    return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_cuts_follow_content():
    r = random.Random(3)
    text = prose(r, 600)
    a = pieces(text)
    assert b"".join(a) == text.encode() and all(p.decode() for p in a) and max(map(len, a)) <= cdc.MAX_CHUNK + 3
    b = pieces(text[:900] + "INSERTED" + text[900:])
    assert len(set(a) - set(b)) <= 3  # an insertion changes nearby chunks alone
    assert pieces("") == []


def brute(rows):
    """The rule, one document at a time."""
    seen, owner = {}, {}
    cut = [pieces(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        at = 0
        for p in cut[i]:
            seen[p] = seen.get(p, 0) + 1
            owner.setdefault(p, (i, at))
            at += len(p)
    out = []
    for i, parts in enumerate(cut):
        keep, at, run = [], 0, []

        def flush(run, keep):
            long = sum(len(p) for p, _ in run) >= cdc.MIN_RUN
            keep += [p for p, a in run if not long or owner[p] == (i, a)]

        for p in parts:
            if seen[p] > 1:
                run.append((p, at))
            else:
                flush(run, keep)
                keep.append(p)
                run = []
            at += len(p)
        flush(run, keep)
        out.append(b"".join(keep).decode())
    return out


def test_against_brute_force(spark):
    r = random.Random(7)
    shared = [prose(r, n) for n in (70, 90, 12)]
    rows = [(i, "\n".join(r.choice([prose(r, r.randint(1, 60)), *shared]) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(60, "ab " * 400), (61, None), (62, "")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").repartition(3)
    got = cdc.dedup(df).orderBy("row.doc_id").collect()
    assert [g.kept for g in got] == brute(rows)
    assert all(g.n_bytes - g.n_removed == len(g.kept.encode()) and g.row.kept == "k" for g in got)
    assert cdc.dedup(df.limit(0)).count() == 0


def test_repeated_rows_and_null_key(spark):
    t = prose(random.Random(1), 80)
    got = cdc.dedup(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((g.row.doc_id or -1, g.kept == t) for g in got) == [(-1, True), (1, False), (1, False), (2, False)]


def test_long_text_in_parts():
    import numpy as np

    r = random.Random(8)
    text = prose(r, 3000) + "a" * 5000 + prose(r, 500) + "é" * 900
    (b,) = blocks(pa.array([text]))
    whole = cdc.chunks(b)
    for limit in (700, 4096):
        got = [np.concatenate(c) for c in zip(*cdc.chunk_parts(b, limit), strict=True)]
        assert all(np.array_equal(x, y) for x, y in zip(whole, got, strict=True))
