import re
from statistics import median

import duckdb
from oracle import SF, TABLES

from corvata.plans.queries_more import token_lines
from corvata.sources.testtables import LEDGER_SQL


def test_every_bill_has_its_tables(spark):
    """Against a loop over all pages: a ledger row is a line, as rows lie further apart than the tolerance of a line."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    pages = {}
    for d, p, order, part, text, q, c in con.sql(f"WITH {LEDGER_SQL} SELECT document_id, page, row_order, part, description, quantity, abs(cents) FROM ledger ORDER BY document_id, page, row_order").fetchall():
        words = [*text.split(" "), str(q), str(c)]
        numbers = sum(bool(re.match(r"^[^A-Za-z]*[0-9][0-9,]*(\.[0-9]+)?$", w)) for w in words)
        pages.setdefault((d, p), []).append((order * 22.0 + part % 5, len(words), numbers))
    want = set()
    for key, lines in pages.items():
        lines = [x for x in lines if x[1] >= 3 and x[2] >= 1]
        parts = []
        for x in lines:
            if parts and x[0] - (parts[-1][-1][0] + 14) <= 3 * median([14.0] * len(lines)):
                parts[-1].append(x)
            else:
                parts.append([x])
        for part in parts:
            n = len(part)
            if n >= 2:
                share = sum(x[2] for x in part) / sum(x[1] for x in part)
                want.add((*key, 0.0, part[0][0], max(x[1] for x in part) * 90.0 - 10, part[-1][0] + 14, n, round(min(0.95, 0.5 + n * 0.05 + share * 0.25), 9)))
    got = [(r.document_id, r.page, *r.box, r.rows, round(r.confidence, 9)) for r in token_lines(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(d % 10 for d, *_ in want)
