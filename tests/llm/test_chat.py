from corvata.llm import chat

TURNS = [
    (1, 2, "user", "third"), (1, 0, "system", "rules"), (1, 1, "Ann Lee", "first <|im_end|>"), (1, None, "user", None), (1, 3, None, "é"), (1, 2, "user", "third"),
    (2, 0, "system", "alone"), (None, 0, "user", "x"), (None, 5, "user", "y"), (3, 1, "a", ""), (3, 700, "b", "later"),
]


def brute(turns):
    convs = {}
    for n, (c, t, role, text) in enumerate(turns):
        convs.setdefault((c, n if c is None else -1), []).append((t, (role or "unknown").replace(" ", "_"), (text or "").replace("<|", "<\u200b|")))
    out = []
    for (c, _), rows in convs.items():
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        for who in {r[1] for r in rows} - {"system"}:
            text, spans = "", []
            for _, role, said in rows:
                text += "<|im_start|>" + ("assistant" if role == who else role if role == "system" else f"user name={role}") + "\n"
                if role == who:
                    spans.append((len(text), len(text) + len(said) + len("<|im_end|>")))
                text += said + "<|im_end|>\n"
            out.append((c, who, len(rows), len(spans), text, tuple(spans)))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, participant string").repartition(3)


def test_against_brute_force(spark):
    got = [(*tuple(r)[:5], tuple(tuple(s) for s in r.spans)) for r in chat.rotate(frame(spark)).collect()]
    assert sorted(got, key=str) == brute(TURNS)
    for r in got:
        assert all(r[4][e - 10 : e] == "<|im_end|>" for _, e in r[5])
    assert chat.rotate(frame(spark).limit(0)).count() == 0


def test_pieces_laid_end_to_end_are_the_whole(spark):
    for segment in (1, 2, 512):
        parts = {}
        for r in chat.rotate(frame(spark), segment=segment).orderBy("segment", "page").collect():
            key = (r.conv_id, r.participant, r.text if r.conv_id is None else "")
            old = parts.setdefault(key, [0, 0, "", ()])
            assert r["at"] == len(old[2]) and r.n_turns <= segment
            parts[key] = [old[0] + r.n_turns, old[1] + r.n_targets, old[2] + r.text, (*old[3], *map(tuple, r.spans))]
        assert sorted(((c, who, *v) for (c, who, _), v in parts.items()), key=str) == brute(TURNS)
        assert chat.rotate(frame(spark).limit(0), segment=segment).count() == 0
