"""Queries on publication, pages, jobs, gates and scalar rules, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.functions import dates, descriptions, fields, geometry, money, text
from corvata.operators import graph, identity, jobs, layout, pages, publication
from corvata.operators import ledger as L
from corvata.plans import gates, metrics, profiles
from corvata.plans.queries import PLAIN_SQL, query
from corvata.sources.testtables import LEDGER_SQL, ledger, table
from corvata.streaming import drift


def pick(values: list[str | None], by: Column) -> Column:
    """The value whose place is by modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list[str | None], by: str) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[CAST(({by}) % {len(values)} + 1 AS INTEGER)]"


# Publication

_FIELDS = {"amount": ("a", 5), "description": ("d", 7), "quantity": ("q", 3), "service_code": ("c", 6), "service_date": ("s", 4)}


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with evidence for some of their fields."""
    rows = ledger(spark, sf_dir)
    entries = F.array_compact(F.array(*[F.when(F.col("part") % n != 0, F.struct(F.lit(k).alias("k"), F.array(F.concat_ws("-", "row_id", F.lit(v))).alias("v"))) for k, (v, n) in _FIELDS.items()]))
    role = F.when(F.col("quantity") == 3, "informational").otherwise(F.col("role"))
    kind = pick(["item_ledger", "pharmacy", "laboratory", "category_summary", "odd"], F.col("part"))
    return rows.select(
        "document_id", "page", "table_id", "row_id", F.col("row_order").alias("source_row"), role.alias("role"), kind.alias("table_type"), "description", F.col("cents").alias("amount"), "quantity",
        F.concat(F.lit("SC"), F.col("part").cast("string")).alias("service_code"), "service_date", F.map_from_entries(entries).alias("evidence"), F.when(F.col("part") % 23 != 0, F.lit(1)).alias("box"), "part",
    )


_ALIGNED_SQL = f"""{LEDGER_SQL}, aligned AS (SELECT *, CASE WHEN quantity = 3 THEN 'informational' ELSE role END AS r,
  list_filter([{', '.join(f"CASE WHEN part % {n} <> 0 THEN row_id || '-{v}' END" for v, n in _FIELDS.values())}], lambda x: x IS NOT NULL) AS tokens FROM ledger),
published AS (SELECT * FROM aligned WHERE part % 7 <> 0 AND part % 23 <> 0 AND CASE WHEN r = 'informational' THEN part % 6 <> 0 OR part % 4 <> 0 ELSE r IN ('detail', 'refund', 'category_rollup') AND part % 5 <> 0 END)"""


@query(f"""WITH {_ALIGNED_SQL} SELECT row_id, row_id IN (SELECT row_id FROM published) AS publishable FROM aligned""")
def publishable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("row_id", (L.publishable(F.col("role"), F.col("evidence"), F.col("description"), F.col("amount")) & F.col("box").isNotNull()).alias("publishable"))


@query(f"""WITH {_ALIGNED_SQL} SELECT row_id, r AS role, coalesce(([' ', 'itemized_bill', 'pharmacy', 'laboratory', 'summary', 'unknown'])[CAST(part % 5 + 2 AS INTEGER)], '') AS page_type,
  CAST(row_number() OVER (PARTITION BY document_id, page, table_id ORDER BY row_order) - 1 AS INTEGER) AS row_order, CASE WHEN part % 3 <> 0 THEN quantity END AS quantity, CASE WHEN part % 6 <> 0 THEN 'SC' || part END AS service_code,
  CASE WHEN part % 4 <> 0 THEN service_date END AS service_date, array_to_string(tokens, ',') AS token_ids,
  substr(sha256('{{"c0":' || document_id || ',"c1":' || page || ',"c2":"' || table_id || '","c3":' || row_order || ',"c4":["' || array_to_string(tokens, '","') || '"]}}'), 1, 24) AS canonical_id FROM published""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.canonical(_aligned(spark, sf_dir)).select("row_id", "role", "page_type", "row_order", "quantity", "service_code", "service_date", F.array_join("token_ids", ",").alias("token_ids"), "canonical_id")


@query(f"""WITH {LEDGER_SQL}, r AS (SELECT document_id, CASE WHEN part % 3 = 0 THEN section ELSE '' END AS section, CASE WHEN part % 5 = 0 THEN 'R' END AS request_no, CASE WHEN quantity > 30 THEN 'S' ELSE '' END AS service_code, NULL AS hsn_code, CASE WHEN discount_percent > 8 THEN discount_percent END AS discount FROM ledger)
SELECT document_id, concat_ws(',', max(CASE WHEN section <> '' THEN 'section' END), max(CASE WHEN request_no <> '' THEN 'request_no' END), max(CASE WHEN service_code <> '' THEN 'service_code' END), max(CASE WHEN discount IS NOT NULL THEN 'discount' END)) AS populated FROM r GROUP BY document_id""")
def populated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir).select(
        "document_id", F.when(F.col("part") % 3 == 0, F.col("section")).otherwise("").alias("section"), F.when(F.col("part") % 5 == 0, "R").alias("request_no"),
        F.when(F.col("quantity") > 30, "S").otherwise("").alias("service_code"), F.lit(None).cast("string").alias("hsn_code"), F.when(F.col("discount_percent") > 8, F.col("discount_percent")).alias("discount"),
    )
    return publication.populated(r, ["document_id"]).select("document_id", F.array_join("populated", ",").alias("populated"))


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT DISTINCT document_id, table_id, part % 4 AS column_id FROM ledger)
SELECT document_id, table_id, column_id, CASE WHEN (document_id + column_id) % 3 = 0 THEN 'net_amount' ELSE 'field' || column_id END AS canonical_field FROM c""")
def column_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger(spark, sf_dir).select("document_id", "table_id", (F.col("part") % 4).alias("column_id")).distinct().withColumn("canonical_field", F.concat(F.lit("field"), F.col("column_id").cast("string")))
    mapped = c.where("(document_id + column_id) % 3 = 0").withColumn("canonical_field", F.lit("net_amount"))
    return publication.remapped(c, mapped)


_PRINTED_SQL = f"""{LEDGER_SQL}, hit AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY document_id) AS total FROM ledger WHERE contains(lower(description), 'brand#1') OR contains(lower(section), 'brand#1') WINDOW w AS (PARTITION BY document_id ORDER BY CAST(table_id AS BIGINT), row_order, row_id)),
t AS (SELECT DISTINCT document_id, table_id, CAST(table_id AS BIGINT) AS table_order FROM ledger)"""


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("document_id", "page", F.col("table_id").cast("long").alias("table_order"), "table_id", "row_order", "row_id", F.array("description", "section", F.lit(None)).alias("cells"))


@query(f"""WITH {_PRINTED_SQL} SELECT document_id, table_id, string_agg(n || ':' || row_id, ',' ORDER BY n) AS rows, max(total) AS total FROM hit WHERE n > 1 AND n <= 3 GROUP BY document_id, table_id""")
def printed_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = publication.printed_rows(_printed(spark, sf_dir), " Brand#1", offset=1, limit=2)
    return found.select("document_id", "table_id", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["ordinal"].cast("string"), r["row_id"])), ",").alias("rows"), "total")


@query(f"""WITH {LEDGER_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CAST(table_id AS BIGINT), row_order, row_id) AS n, count(*) OVER (PARTITION BY document_id) AS total FROM ledger WHERE page = 1),
a AS (SELECT document_id, (min(n) - 1) // 2 * 2 AS first FROM n WHERE part % 2 = 0 GROUP BY document_id)
SELECT document_id, table_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS ordinals, max(total) AS total FROM n JOIN a USING (document_id) WHERE n > first AND n <= first + 2 GROUP BY document_id, table_id""")
def printed_table_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("row_id", (F.col("part") % 2 == 0).alias("even"))
    found = publication.printed_rows(_printed(spark, sf_dir).join(rows, "row_id"), page=1, limit=2, anchor=F.col("even"))
    return found.select("document_id", "table_id", F.array_join(F.transform("rows", lambda r: r["ordinal"].cast("string")), ",").alias("ordinals"), "total")


@query("""WITH j AS (SELECT o_orderkey AS job_id, (['queued', 'complete', 'needs_review', 'error'])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS status, CASE WHEN o_custkey % 3 <> 0 THEN 'H' || o_custkey END AS hospital, (['pass', 'fail'])[CAST(o_custkey % 2 + 1 AS INTEGER)] AS v, o_custkey % 9 AS n,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'v6' END AS contract, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 7 > 2 END AS certified, CASE WHEN o_orderkey % 11 = 0 THEN 'stale' END AS certification, CASE WHEN o_orderkey % 13 = 0 THEN 'General' WHEN o_orderkey % 13 = 1 THEN '' END AS o FROM orders)
SELECT job_id, status, CASE WHEN status IN ('complete', 'needs_review') AND o <> '' THEN o ELSE hospital END AS hospital_name, CASE WHEN status IN ('complete', 'needs_review') AND o <> '' THEN 'reviewer' WHEN hospital IS NOT NULL THEN 'machine' END AS hospital_source,
  CASE WHEN status IN ('queued', 'error') OR certified THEN v END AS validation_status, CASE WHEN status IN ('queued', 'error') OR certified THEN n END AS issue_count,
  CASE WHEN status IN ('complete', 'needs_review') AND contract IS NULL THEN 'legacy_v5' ELSE contract END AS evidence_contract, status IN ('complete', 'needs_review') AND contract IS NULL AS reprocess,
  CASE WHEN certified THEN v WHEN status IN ('complete', 'needs_review') THEN coalesce(certification, 'legacy_uncertified') END AS certification FROM j""")
def public_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    j = o.select(
        k.alias("job_id"), pick(["queued", "complete", "needs_review", "error"], k).alias("status"), F.when(c % 3 != 0, F.concat(F.lit("H"), c.cast("string"))).alias("hospital_name"), pick(["pass", "fail"], c).alias("validation_status"), (c % 9).alias("issue_count"),
        F.when(k % 5 != 0, "v6").alias("evidence_contract"), F.when(k % 7 != 0, k % 7 > 2).alias("certified"), F.when(k % 11 == 0, "stale").alias("certification"),
    )
    over = o.where(k % 13 <= 1).select(k.alias("job_id"), F.when(k % 13 == 0, "General").otherwise("").alias("name"))
    return publication.public_states(j, over)


@query(f"""WITH {LEDGER_SQL} SELECT row_id, CASE WHEN part % 3 = 0 THEN CASE WHEN part % 2 = 0 THEN service_date END ELSE service_date END AS service_date,
  CASE WHEN part % 3 = 0 AND part % 2 = 0 THEN 'e1,' || CASE WHEN part % 5 = 0 THEN 'e2' ELSE 'e' || part END ELSE 'e1' END AS evidence, CASE WHEN part % 3 = 0 AND part % 2 = 0 THEN 'seen,service_date_recovered' ELSE 'seen' END AS flags FROM ledger""")
def service_date_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    rows = r.select("row_id", F.when(F.col("part") % 3 != 0, F.col("service_date")).alias("service_date"), F.array(F.lit("e1")).alias("date_evidence"), F.array(F.lit("seen")).alias("flags"))
    found = r.where("part % 2 = 0").select("row_id", F.col("service_date").alias("date"), F.array(F.lit("e1"), F.when(F.col("part") % 5 == 0, "e2").otherwise(F.concat(F.lit("e"), F.col("part").cast("string")))).alias("evidence"))
    return publication.with_service_date(rows, found).select("row_id", "service_date", F.array_join("date_evidence", ",").alias("evidence"), F.array_join("flags", ",").alias("flags"))


# Pages

_FORM = ["Amount Received", "Receipt No 12", "Total", "Rs. 500", "12/03/2024", "paracetamol", "1,250.00", "Advance received", "Invoice", "###", "charge"]


def _form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ledger(spark, sf_dir).select("document_id", "page", "row_order", F.col("row_id").alias("token_id"), pick(_FORM, F.col("part")).alias("text"))
    return pages.page_tokens(tokens, ["document_id", "page"], ["row_order"])


_FORM_SQL = f"""{LEDGER_SQL}, tok AS (SELECT document_id, page, row_order, row_id, {pick_sql(_FORM, 'part')} AS text FROM ledger),
pg AS (SELECT document_id, page, trim(regexp_replace(lower(string_agg(text, ' ' ORDER BY row_order)), '[^a-z0-9₹./:-]+', ' ', 'g')) AS text,
  coalesce(string_agg(row_id, ',' ORDER BY row_order) FILTER (text IN ('Rs. 500', '1,250.00') OR regexp_matches(lower(text), 'amount|bill|charge|date|deposit|invoice|payment|receipt|reference|settlement')), '') AS evidence FROM tok GROUP BY document_id, page),
need AS (SELECT *, regexp_matches(text, 'amount|bill no|date|invoice no|payment|receipt no|receipt book|reservation receipt|distribution receipt|charges towards|payment received') AND regexp_matches(text, '[0-9]') AS needs FROM pg)"""


@query(f"""WITH {_FORM_SQL} SELECT document_id, page, needs, evidence FROM need""")
def full_page_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form_pages(spark, sf_dir).select("document_id", "page", pages.needs_recovery(F.col("text")).alias("needs"), F.array_join("evidence", ",").alias("evidence"))


@query(rf"""WITH {_FORM_SQL}, p AS (SELECT *, CASE WHEN document_id % 19 <> 0 THEN document_id % 40 / 10.0 END AS sd, document_id % 30 / 10000.0 AS fg, document_id % 5 AS ln, regexp_matches(text, '(?:₹|\brs\.?\s*)\d|\d[\d,]*\.\d{{2}}\b') AS money FROM need),
s AS (SELECT *, NOT regexp_matches(text, '[a-z0-9]') AND sd < 2 AND fg < 0.001 AS blank, ln >= 3 AND fg >= 0.002 AS drawn, list_filter([CASE WHEN needs THEN 'financial_ocr_text' END, CASE WHEN money THEN 'currency_geometry' END, CASE WHEN regexp_matches(text, 'receipt|amount received|charges towards|payment received|bill no|invoice no') THEN 'financial_form_language' END, CASE WHEN ln >= 3 AND fg >= 0.002 THEN 'form_line_structure' END], lambda x: x IS NOT NULL) AS sig FROM p),
q AS (SELECT *, NOT blank AND ((money AND (len(sig) > 0 OR regexp_matches(text, '\b(?:receipt|invoice|bill|reference|ref)\s*(?:no|number|#)') OR contains(text, '12/03/2024'))) OR drawn) AS sus FROM s)
SELECT document_id, page, sd IS NOT NULL AND coalesce(blank, false) AS blank, CASE WHEN sd IS NULL THEN needs ELSE sus END AS suspected, CASE WHEN sd IS NULL THEN 'unresolved' WHEN blank THEN 'blank' WHEN sus AND regexp_matches(text, 'advance received|deposit received|amount refunded|refund issued|settlement') AND NOT regexp_matches(text, 'charge|invoice|bill amount') THEN 'recognized_nonbillable' WHEN sus THEN 'unresolved' ELSE 'nonfinancial' END AS classification,
  CASE WHEN sd IS NULL THEN 'image_unreadable' ELSE array_to_string(sig, ',') END AS signals FROM q""")
def no_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("document_id")
    found = pages.no_table_page(F.col("text"), F.when(d % 19 != 0, d % 40 / 10.0), d % 30 / 10000.0, d % 5)
    return _form_pages(spark, sf_dir).withColumn("x", found).select("document_id", "page", F.coalesce("x.blank", F.lit(False)).alias("blank"), "x.suspected", "x.classification", F.array_join("x.signals", ",").alias("signals"))


@query("""SELECT p_partkey AS page, concat_ws(',', 'orientation_unverified', CASE WHEN p_size * 2 < 50 THEN 'blur' END, CASE WHEN p_retailprice % 50 < 25 THEN 'low_contrast' END, CASE WHEN p_partkey % 256 < 40 THEN 'underexposed' END, CASE WHEN p_partkey % 256 > 245 THEN 'overexposed' END, CASE WHEN p_size % 9 / 1000.0 < 0.005 THEN 'low_edge_density' END, CASE WHEN abs(p_partkey % 5 - 2) / 2.0 > 0.5 THEN 'skewed' END) AS flags FROM part""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    flags = pages.quality_flags(k % 256, F.col("p_retailprice") % 50, s * 2, s % 9 / 1000.0, (k % 5 - 2) / 2.0)
    return table(spark, sf_dir, "part").select(k.alias("page"), F.array_join(flags, ",").alias("flags"))


_GRID_SQL = "g AS (SELECT s_suppkey, i, j, j + (s_suppkey * i * 7 % 5) / 4.0 AS x, i + (s_suppkey * j * 3 % 7) / 4.0 AS y FROM (SELECT s_suppkey, unnest(range(6)) AS i FROM supplier), range(5) r(j))"


@query(f"""WITH {_GRID_SQL}, d AS (SELECT *, sqrt((x - j) * (x - j) + (y - i) * (y - i)) AS m, (lead(x) OVER r - x) * (lead(y) OVER c - y) - (lead(x) OVER c - x) * (lead(y) OVER r - y) AS jac FROM g WINDOW r AS (PARTITION BY s_suppkey, i ORDER BY j), c AS (PARTITION BY s_suppkey, j ORDER BY i))
SELECT s_suppkey, round(avg(m), 9) AS mean_shift, round(max(m), 9) AS largest_shift, round(quantile_cont(m, 0.95), 9) AS p95_shift, min(jac) AS least_jacobian, round(quantile_cont(jac, 0.05), 9) AS p5_jacobian, count(*) FILTER (jac <= 0) AS folded FROM d GROUP BY s_suppkey""")
def grid_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    points = s.select("s_suppkey", "i", "j", (F.col("j") + F.expr("s_suppkey * i * 7 % 5") / 4.0).alias("x"), (F.col("i") + F.expr("s_suppkey * j * 3 % 7") / 4.0).alias("y"))
    return pages.grid_diagnostics(points, ["s_suppkey"]).select("s_suppkey", *[F.round(c, 9).alias(c) for c in ("mean_shift", "largest_shift", "p95_shift")], "least_jacobian", F.round("p5_jacobian", 9).alias("p5_jacobian"), "folded")


def _box(left: Column, top: Column, width: Column, height: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(d(left).alias("l"), d(top).alias("t"), d(left + width).alias("r"), d(top + height).alias("b"))


@query(f"""WITH {LEDGER_SQL} SELECT row_id, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY CASE WHEN part % 9 = 0 THEN 0 ELSE part % 50 END, CASE WHEN part % 9 = 0 THEN 0 ELSE quantity END, CASE WHEN part % 9 = 0 THEN 0 ELSE part % 50 + 10 END, CASE WHEN part % 9 = 0 THEN 0 ELSE quantity + 5 END, row_id) - 1 AS INTEGER) AS ordinal FROM ledger""")
def anchor_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("part") % 9 != 0, _box(F.col("part") % 50, F.col("quantity"), F.lit(10), F.lit(5)))
    things = ledger(spark, sf_dir).select("document_id", "page", F.col("row_id").alias("thing_id"), box.alias("box"))
    return pages.anchors(things, ["document_id", "page"]).select(F.col("thing_id").alias("row_id"), "ordinal")


# Scores, gates

_PAIR_SQL = f"""{LEDGER_SQL}, b AS (SELECT *, CAST(part % 60 AS DOUBLE) AS gl, CAST(quantity AS DOUBLE) AS gt, part % 60 + 40.0 AS gr, quantity + 20.0 AS gb, part % 60 + part % 7 * 5.0 AS al, quantity + part % 3 * 6.0 AS atop, part % 60 + part % 7 * 5.0 + 40 AS ar, quantity + part % 3 * 6.0 + 20 AS ab, part % 4 <> 0 AS placed, row_order + part % 3 AS an,
  CASE WHEN part % 5 = 0 THEN '' ELSE role END AS gk, CASE WHEN part % 6 = 0 THEN 'other' ELSE role END AS ak, CASE WHEN part % 2 = 0 THEN row_id ELSE 'x' END AS aid FROM ledger),
i AS (SELECT *, greatest(0, least(gr, ar) - greatest(gl, al)) * greatest(0, least(gb, ab) - greatest(gt, atop)) AS common FROM b),
u AS (SELECT *, common / (1600 - common) AS iou, least(1, sqrt(((gl + gr - al - ar) / 2) * ((gl + gr - al - ar) / 2) + ((gt + gb - atop - ab) / 2) * ((gt + gb - atop - ab) / 2)) / 40) AS far, greatest(0, 1 - least(abs(row_order - an), 5) / 5.0) AS near FROM i)"""


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("part"), F.col("quantity")
    placed, n = p % 4 != 0, F.col("row_order") + p % 3
    g_box, a_box = _box(p % 60, q, F.lit(40), F.lit(20)), _box(p % 60 + p % 7 * 5, q + p % 3 * 6, F.lit(40), F.lit(20))
    g_role, a_role = F.when(p % 5 == 0, "").otherwise(F.col("role")), F.when(p % 6 == 0, "other").otherwise(F.col("role"))
    a_id = F.when(p % 2 == 0, F.col("row_id")).otherwise("x")
    names = lambda page, box, i, n, r: F.struct(page.alias("page"), F.when(placed, box).alias("box"), i.alias("thing_id"), n.alias("n"), r.alias("kind"), r.alias("role"), r.alias("continues"), r.alias("scope"), i.alias("label"))
    return ledger(spark, sf_dir).select("row_id", names(F.col("page"), g_box, F.col("row_id"), F.col("row_order"), g_role).alias("g"), names(F.when(p % 11 != 0, F.col("page") + (p % 13 == 0).cast("int")), a_box, a_id, n, a_role).alias("a"))


@query(f"""WITH {_PAIR_SQL}, k AS (SELECT *, CASE WHEN part % 11 <> 0 THEN page + CAST(part % 13 = 0 AS INTEGER) END AS ap FROM u)
SELECT row_id, round(CASE WHEN NOT (coalesce(ap <> page, false) OR (placed AND iou < 0.01)) THEN CASE WHEN ap = page THEN 0.45 ELSE 0.20 END + CASE WHEN placed THEN 0.45 * iou + 0.10 * (1 - far) WHEN aid = row_id THEN 0.65 ELSE 0.55 * near END + CASE WHEN aid = row_id THEN 0.08 ELSE 0 END + CASE WHEN gk = ak THEN 0.04 ELSE 0 END END, 9) AS table_score,
  round(CASE WHEN gk = ak OR c >= 0.18 THEN c END, 9) AS column_score, round(CASE WHEN r >= 0.20 AND NOT (placed AND iou < 0.005) THEN r END, 9) AS row_score, round(CASE WHEN t >= 0.35 THEN t END, 9) AS total_score
FROM (SELECT *, CASE WHEN gk <> '' AND gk = ak THEN 0.65 WHEN gk <> '' THEN 0.04 ELSE 0 END + CASE WHEN placed THEN 0.27 * iou + 0.08 * (1 - far) ELSE 0.27 * near END + CASE WHEN row_order = an THEN 0.08 ELSE 0 END AS c,
  CASE WHEN aid = row_id THEN 0.45 ELSE 0 END + CASE WHEN gk <> '' AND gk = ak THEN 0.18 WHEN gk <> '' THEN 0.02 ELSE 0 END + CASE WHEN gk <> '' AND gk = ak THEN 0.12 ELSE 0.01 END + CASE WHEN placed THEN 0.35 * iou + 0.15 * (1 - far) ELSE 0.35 * near END + CASE WHEN row_order = an THEN 0.08 ELSE 0 END AS r,
  CASE WHEN gk <> '' AND gk = ak THEN 0.60 ELSE 0 END + CASE WHEN aid = row_id THEN 0.20 ELSE 0 END + 0.20 * near AS t FROM k)""")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, a = F.col("g"), F.col("a")
    return _pair(spark, sf_dir).select("row_id", *[F.round(f(g, a), 9).alias(n) for n, f in (("table_score", gates.table_score), ("column_score", gates.column_score), ("row_score", gates.row_score), ("total_score", gates.total_score))])


@query("""WITH g AS (SELECT o_orderkey AS identity, o_custkey % 7 AS n FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT o_orderkey, 9 FROM orders WHERE o_orderkey % 29 = 0),
a AS (SELECT o_orderkey AS identity, o_custkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM orders WHERE o_orderkey % 19 <> 0 UNION ALL SELECT o_orderkey, 8 FROM orders WHERE o_orderkey % 31 = 0),
gs AS (SELECT identity, count(*) AS c, min(n) AS n FROM g GROUP BY identity), s AS (SELECT identity, count(*) AS c, min(n) AS n FROM a GROUP BY identity)
SELECT coalesce(gs.identity, s.identity) AS identity, gs.n AS gold_n, s.n AS actual_n, CASE WHEN gs.c > 1 THEN 'gold_duplicate' WHEN s.c > 1 THEN 'actual_duplicate' WHEN gs.c IS NULL THEN 'missing_in_gold' WHEN s.c IS NULL THEN 'missing_in_actual' WHEN gs.n <> s.n THEN 'order_differs' END AS fault FROM gs FULL JOIN s ON gs.identity = s.identity""")
def cohort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, n = table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("identity"), F.col("o_custkey") % 7
    g = o.where("o_orderkey % 17 <> 0").select(k, n.alias("n")).unionByName(o.where("o_orderkey % 29 = 0").select(k, F.lit(9).alias("n")))
    a = o.where("o_orderkey % 19 <> 0").select(k, (n + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("n")).unionByName(o.where("o_orderkey % 31 = 0").select(k, F.lit(8).alias("n")))
    return gates.cohort_pairs(g, a)


_LEVELS = ["cell", "row", "table", "total"]


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT document_id, {pick_sql(_LEVELS, 'part')} AS level, row_order AS n, 'i' || part % 6 AS gold_id, CASE WHEN part % 3 = 0 THEN 'i' || quantity % 6 END AS actual_id, role AS status FROM ledger),
f AS (SELECT DISTINCT document_id, CASE WHEN quantity % 2 = 0 THEN {pick_sql(_LEVELS, 'quantity // 2')} || ':' ELSE '' END AS prefix, 'i' || discount_percent % 6 AS id FROM ledger),
h AS (SELECT f.*, o.level, o.status, row_number() OVER (PARTITION BY f.document_id, f.prefix, f.id ORDER BY CASE o.level WHEN 'cell' THEN 0 WHEN 'row' THEN 1 WHEN 'total' THEN 2 ELSE 3 END, o.n, o.status) AS k FROM f JOIN o ON f.document_id = o.document_id AND (f.id = o.gold_id OR f.id = o.actual_id) AND (f.prefix = '' OR f.prefix = o.level || ':'))
SELECT f.document_id, f.prefix || f.id AS failure_id, h.level, h.status FROM f LEFT JOIN h ON f.document_id = h.document_id AND f.prefix = h.prefix AND f.id = h.id AND h.k = 1""")
def failure_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    i = lambda c: F.concat(F.lit("i"), (c % 6).cast("string"))
    o = r.select("document_id", pick(_LEVELS, F.col("part")).alias("level"), F.col("row_order").alias("n"), i(F.col("part")).alias("gold_id"), F.when(F.col("part") % 3 == 0, i(F.col("quantity"))).alias("actual_id"), F.col("role").alias("status"))
    prefix = F.when(F.col("quantity") % 2 == 0, F.concat(pick(_LEVELS, F.expr("quantity div 2")), F.lit(":"))).otherwise("")
    f = r.select("document_id", F.concat(prefix, i(F.col("discount_percent"))).alias("failure_id")).distinct()
    return gates.resolved_failures(f, o)


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 7 <> 0 END AS e, (['eligible', 'Accepted', 'include', 'maybe', NULL])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS s, CASE WHEN p_size % 9 <> 0 THEN p_size % 8 = 0 END AS y, CASE WHEN p_size % 4 <> 0 THEN p_size % 10 = 1 END AS d, CASE WHEN p_partkey % 13 = 0 THEN 'sha256:' || sha256(p_name) WHEN p_partkey % 13 = 1 THEN 'bad' END AS o, p_partkey % 2 = 0 AS nd FROM part)
SELECT p_partkey, CASE WHEN e IS NULL THEN 'eligible_missing' WHEN NOT e THEN 'not_eligible' WHEN s IS NOT NULL AND lower(s) NOT IN ('eligible', 'accepted', 'include') THEN 'status_not_accepted' WHEN y IS NULL THEN 'synthetic_missing' WHEN y THEN 'synthetic' WHEN d IS NULL AND NOT nd THEN 'duplicate_missing' WHEN o = 'bad' THEN 'duplicate_of_invalid' WHEN d OR o IS NOT NULL THEN 'duplicate' END AS refused FROM r""")
def intake_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    of = F.when(k % 13 == 0, F.concat(F.lit("sha256:"), F.sha2("p_name", 256))).when(k % 13 == 1, "bad")
    why = gates.eligibility(F.when(k % 11 != 0, k % 7 != 0), pick(["eligible", "Accepted", "include", "maybe", None], k), F.when(s % 9 != 0, s % 8 == 0), F.when(s % 4 != 0, s % 10 == 1), of, k % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", why.alias("refused"))


@query("""WITH r AS (SELECT p_partkey, p_size % 5 <> 0 AS p, CASE WHEN p_partkey % 17 <> 0 THEN round(0.88 + p_partkey % 10 / 100.0, 2) END AS c, round(0.86 + p_partkey % 7 / 100.0, 2) AS l, round(0.84 + p_size % 6 / 100.0, 2) AS a, round(0.85 + p_partkey % 3 / 100.0, 2) AS b, p_size % 11 = 1 AS g, CASE WHEN p_size % 2 = 0 THEN p_size % 13 % 2 END AS v FROM part)
SELECT p_partkey, coalesce(p AND c > l AND c >= 0.9 AND least(a, b) >= 0.85 AND NOT g AND coalesce(v, 0) = 0, false) AS approved FROM r""")
def challenger_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda base, n: F.lit(base).cast("decimal(4,2)") + (n / 100).cast("decimal(4,2)")
    ok = gates.promotion(s % 5 != 0, F.when(k % 17 != 0, d("0.88", k % 10)), d("0.86", k % 7), [d("0.84", s % 6), d("0.85", k % 3)], (s % 11 == 1).cast("int"), F.when(s % 2 == 0, s % 13 % 2))
    return table(spark, sf_dir, "part").select("p_partkey", ok.alias("approved"))


_SECTIONS = {"rows": ["description", "cents"], "dates": ["service_date"]}


@query(f"""WITH {LEDGER_SQL}, h AS (SELECT document_id, sha256('{{"description":"' || description || '","cents":' || cents || ',"_row_id":"' || row_id || '"}}') AS a, sha256('{{"service_date":"' || service_date || '","_row_id":"' || row_id || '"}}') AS b FROM ledger),
s AS (SELECT document_id, count(*) AS n, sum(CAST('0x' || substr(a, 1, 12) AS BIGINT)) AS a1, sum(CAST('0x' || substr(a, 17, 12) AS BIGINT)) AS a2, sum(CAST('0x' || substr(b, 1, 12) AS BIGINT)) AS b1, sum(CAST('0x' || substr(b, 17, 12) AS BIGINT)) AS b2 FROM h GROUP BY document_id)
SELECT document_id, n AS rows, sha256(a1 || ':' || a2 || ':' || n) AS rows_sha256, sha256(b1 || ':' || b2 || ':' || n) AS dates_sha256 FROM s""")
def fingerprint_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.snapshot(ledger(spark, sf_dir), ["document_id"], _SECTIONS, ["row_id"])


@query("""WITH b AS (SELECT 'm' || p_partkey AS measure, p_size AS v FROM part WHERE p_partkey % 10 <> 0), c AS (SELECT 'm' || p_partkey AS measure, p_size + p_partkey % 3 - 1 AS v FROM part WHERE p_partkey % 9 <> 0)
SELECT coalesce(b.measure, c.measure) AS measure, b.v AS before, c.v AS after, coalesce(CASE WHEN coalesce(b.measure, c.measure) IN ('m1', 'm2', 'm3') THEN c.v <= b.v ELSE c.v >= b.v END, false) AS passed FROM b FULL JOIN c ON b.measure = c.measure""")
def same_or_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, name = table(spark, sf_dir, "part"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("measure")
    return gates.same_or_better(p.where("p_partkey % 10 <> 0").select(name, F.col("p_size").alias("value")), p.where("p_partkey % 9 <> 0").select(name, F.expr("p_size + p_partkey % 3 - 1").alias("value")), ("m1", "m2", "m3"))


@query("""WITH f AS (SELECT p_name AS path, p_size % 9 AS size, CASE WHEN p_partkey % 4 <> 0 THEN sha256(p_brand) END AS sha256 FROM part)
SELECT path, max(size) AS size, min(sha256) AS sha256, CASE WHEN count(DISTINCT sha256) = 0 THEN 'no_digest' WHEN count(DISTINCT sha256) > 1 THEN 'digests_differ' WHEN max(size) <= 0 THEN 'empty' WHEN count(*) > 1 THEN 'listed_twice' END AS fault FROM f GROUP BY path""")
def sealed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.sealed(table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), (F.col("p_size") % 9).alias("size"), F.when(F.col("p_partkey") % 4 != 0, F.sha2("p_brand", 256)).alias("sha256")))


# Jobs

_STATES = ["queued", "processing", "complete", "cancelling", "queued"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), pick(_STATES, k).alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_custkey") % 9).alias("page"), F.when(k % 6 == 0, "late").alias("error"))


_JOBS_SQL = f"j AS (SELECT o_orderkey AS job_id, {pick_sql(_STATES, 'o_orderkey')} AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_custkey % 9 AS page, CASE WHEN o_orderkey % 6 = 0 THEN 'late' END AS error FROM orders)"


@query(f"""WITH {_JOBS_SQL} SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS place FROM j WHERE status = 'queued'""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue(_jobs(spark, sf_dir)).select("job_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_JOBS_SQL}, l AS (SELECT l_orderkey AS job_id, max({{'s': l_linenumber, 'c': l_quantity > 20}}).c AS c FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey)
SELECT j.job_id, CASE WHEN status = 'cancelling' THEN 'aborted' WHEN coalesce(c, false) THEN 'complete' WHEN status = 'processing' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'processing' AND NOT coalesce(c, false) THEN 0 ELSE page END AS page, CASE WHEN status = 'processing' AND NOT coalesce(c, false) THEN NULL ELSE error END AS error,
  CASE WHEN status = 'cancelling' THEN 'abort' WHEN c THEN 'replay' WHEN NOT c THEN 'undo' WHEN status = 'processing' THEN 'requeue' ELSE 'none' END AS action FROM j LEFT JOIN l ON j.job_id = l.job_id""")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") > 20).alias("committed"))
    return jobs.recovered(_jobs(spark, sf_dir), journal)


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS key, l_linenumber AS n, l_linenumber - 1 + CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE 0 END AS expected FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1),
c AS (SELECT o_orderkey AS key, o_custkey % 2 AS revision FROM orders),
step(key, revision, n) AS (SELECT w.key, coalesce(c.revision, 0), 0 FROM (SELECT DISTINCT key FROM w) w LEFT JOIN c ON w.key = c.key UNION ALL
  SELECT s.key, s.revision + 1, m.n FROM step s JOIN (SELECT key, expected, min(n) AS n FROM w GROUP BY key, expected) m ON m.key = s.key AND m.expected = s.revision AND m.n > s.n)
SELECT w.key, w.n, w.expected, EXISTS (SELECT 1 FROM step s WHERE s.key = w.key AND s.n = w.n AND s.n > 0) AS applied FROM w""")
def revision_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    one = i.withColumn("r", F.expr("row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey)")).where("r = 1")
    w = one.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") - 1 + F.when(F.col("l_partkey") % 4 == 0, -1).otherwise(0)).alias("expected"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 2).alias("revision"))
    return jobs.compare_and_set(c, w, ["n"])


@query(f"""WITH {_JOBS_SQL}, h AS (SELECT o_orderkey // 3 * 6 AS job_id, o_orderdate AS finished_at, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, o_totalprice > 50000 AS ok FROM orders)
SELECT job_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY finished_at DESC, digest DESC) AS k FROM h WHERE ok AND job_id NOT IN (SELECT job_id FROM j)) WHERE k = 1""")
def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3 * 6").alias("job_id"), F.col("o_orderdate").alias("finished_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), "o_totalprice")
    return jobs.imported(h, _jobs(spark, sf_dir), F.col("o_totalprice") > 50000).select("job_id", "digest")


# Scalars

_LINES = ["Sub Total", "Total 1,250.00", "Total charges of ward", "Grand Total (A+B)", "bill total 12 30", "Net Payable", "Payments Break up", "Payment mode", "Amount: Paid", "Amount due", "Receipts summary", "Rupees in words", "Ten Thousand only", "For use only", "Date of Admission", "Print Date Time page 1", "CGST", "X-Ray chest", "E-mail id", "paracetamol 500", ""]


@query(rf"""WITH {LEDGER_SQL}, t AS (SELECT row_id, {PLAIN_SQL.format(pick_sql(_LINES, 'part'))} AS t FROM ledger), w AS (SELECT *, string_split(t, ' ') AS ws FROM t)
SELECT row_id, t IN ('total', 'totals', 'tota', 'sub total', 'subtotal', 'bill total') OR regexp_matches(t, 'net payable') OR regexp_matches(t, '^(sub total|grand total|amount paid)') OR regexp_matches(t, '^(bill total|sub total|total) [^a-z]*$') AS is_total,
  regexp_matches(t, 'in words|e mail') OR t = 'cgst' OR regexp_matches(t, ' (admission|discharge)$') OR (contains(t, 'date time') AND contains(t, 'page')) OR t LIKE 'rupees in%' OR (t LIKE '% only' AND (list_contains(ws, 'ten') OR list_contains(ws, 'thousand'))) AS is_metadata,
  CASE WHEN ws[1] = 'amount' THEN list_contains(ws, 'paid') ELSE ws[1] IN ('payment', 'payments', 'receipts') AND (list_contains(ws, 'mode') OR list_contains(ws, 'summary') OR list_contains(ws, 'break')) END AS is_payment_footer FROM w""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick(_LINES, F.col("part"))
    return ledger(spark, sf_dir).select("row_id", descriptions.is_total(t).alias("is_total"), descriptions.is_metadata(t).alias("is_metadata"), descriptions.is_payment_footer(t).alias("is_payment_footer"))


_RAW = ["1. Dressing kit", "12) 450.00", "3 Total", "Bed charge Bed charge", "Nursing Care - nursing care", "12/03/2024 ward round", "- Oxygen; ", "5 self", "7. HSN 3004", "a b a b", "one two three"]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, {pick_sql(["1.", None, None, None, None, None, None, None, None, None, None], 'part')} AS serial, {pick_sql(["Dressing kit", None, None, None, None, None, None, None, None, None, None], 'part')} AS described,
  {pick_sql(["1. Dressing kit", "12) 450.00", "3 Total", "Bed charge", "Nursing Care - nursing care", "ward round", "Oxygen", "5 self", "7. HSN 3004", "a b", "one two three"], 'part')} AS cleaned FROM ledger""")
def description_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick(_RAW, F.col("part"))
    return ledger(spark, sf_dir).select("row_id", descriptions.split_serial(t).alias("s"), descriptions.cleaned(t).alias("cleaned")).select("row_id", F.col("s.serial").alias("serial"), F.col("s.description").alias("described"), "cleaned")


_VALUES = ["1,234.50", "(250)", "₹ 99", "INR 12.5", "-7", "", "12 CR", "Rs. 40 and Rs. 60.25", "n/a", "1e3", "5.", "01/02/2024", "(1,000.75)", "--3", "12.345678"]
_LOOSE = ["1234.5", "-250", "99", "12.5", "-7", None, None, None, None, "1000", "5", None, "-1000.75", "-3", "12.345678"]
_MONEY = ["1,234.50=1234.5000", "(250)=-250.0000", "₹ 99=99.0000", "INR 12.5=12.5000", "-7=-7.0000", "", "12 CR=-12.0000", "Rs. 40=40.0000|Rs. 60.25=60.2500", "", "1=1.0000|3=3.0000", "5=5.0000", "01=1.0000|02=2.0000|2024=2024.0000", "(1,000.75)=-1000.7500", "-3=-3.0000", "12.3456=12.3456|78=78.0000"]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, CAST({pick_sql(_LOOSE, 'part')} AS DECIMAL(28,8)) AS loose, {pick_sql(_MONEY, 'part')} AS found FROM ledger""")
def loose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick(_VALUES, F.col("part"))
    found = F.array_join(F.transform(money.money_values(t), lambda x: F.concat_ws("=", x["raw"], x["value"].cast("string"))), "|")
    return ledger(spark, sf_dir).select("row_id", money.loose_decimal(t).alias("loose"), found.alias("found"))


_DATES = ["2024-03-05", "05/03/2024", "05-03-2024", "05.03.2024", "05/03/24", "5 Mar 2024", "5 March 2024", "2024/03/05", "31/02/2024", "20240305", "Next  Week", "2024-3-5", None]


@query("""WITH {ledger} SELECT row_id, CASE WHEN i IN (0, 1, 2, 4, 5, 6, 11) THEN '2024-03-05' ELSE {field} END AS field_date, CASE WHEN i IN (0, 1, 2, 3, 7, 9) THEN '2024-03-05' ELSE {auth} END AS authority_date FROM (SELECT *, part % 13 AS i FROM ledger)""".format(
    ledger=LEDGER_SQL, field=pick_sql([None, None, None, "05_03_2024", None, None, None, "2024_03_05", "31_02_2024", "20240305", "next_week", None, None], "i"), auth=pick_sql([None, None, None, None, "05/03/24", "5 mar 2024", "5 march 2024", None, "31/02/2024", None, "next week", "2024-3-5", ""], "i")))
def evaluation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick(_DATES, F.col("part"))
    return ledger(spark, sf_dir).select("row_id", dates.field_date(t).alias("field_date"), dates.authority_date(t).alias("authority_date"))


_SEEN = [("05/03/2024", "Date", False, "Bed", "2024-03-05"), ("05/03/2024", "Expiry", False, "tablet", None), ("05/03/2024 ABC-1/22", "Particulars", False, "Bed", "2024-03-05"), ("Bed charge 05/03/2024", "Particulars", False, "Bed", "2024-03-05"), ("Bed 05/03/2024 to 06/03/2024", "Particulars", False, "Bed", None), ("05/03/2024", "Bill Date", True, "Bed", "2024-03-05"), ("05/03/2024", "Bill Date", False, "Bed", None), (None, "Date", True, "Bed", None)]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, CAST({pick_sql([x[4] for x in _SEEN], 'part')} AS DATE) AS service_date FROM ledger""")
def service_dates_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, label, mapped, described = (pick([x[i] for x in _SEEN], F.col("part")) for i in range(4))
    return ledger(spark, sf_dir).select("row_id", dates.service_date_from_context(value, label, mapped, described).alias("service_date"))


_VALID = [("service_code", "AB-12", True), ("service_code", "ABC", False), ("hsn_code", "3004", True), ("hsn_code", "05/03/2024", False), ("request_no", "R/1", True), ("section", "Ward", True), ("section", "120.00", False), ("description", "", False), ("service_date", "05/03/2024", True), ("quantity", "5", False)]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, {pick_sql([str(x[2]).lower() for x in _VALID], 'part')} = 'true' AS valid FROM ledger""")
def field_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("row_id", fields.is_valid(pick([x[0] for x in _VALID], F.col("part")), pick([x[1] for x in _VALID], F.col("part"))).alias("valid"))


_EDITS = [("quantity", "007.50", "7.50", None), ("net_amount", "1,200", None, "not_a_decimal"), ("discount", "+.5", "0.5", None), ("unit_price", "1000000000000000", None, "out_of_range"), ("gross_amount", "-12.", "-12", None), ("quantity", " ", None, None), ("service_date_iso", "2024-02-30", None, "not_an_iso_date"), ("service_date_iso", "2024-02-29", "2024-02-29", None), ("role", "payment", None, "role_not_editable"), ("role", "refund", "refund", None), ("review_disposition", "pending", "pending", None), ("review_disposition", None, None, "disposition_invalid"), ("section", "  Ward ", "Ward", None), ("cents", "5", None, "unsupported_field"), ("description", "", None, None)]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, {pick_sql([e[2] for e in _EDITS], 'part')} AS value, {pick_sql([e[3] for e in _EDITS], 'part')} AS error FROM ledger""")
def checked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fields.checked_change(pick([e[0] for e in _EDITS], F.col("part")), pick([e[1] for e in _EDITS], F.col("part")))
    return ledger(spark, sf_dir).select("row_id", x.alias("x")).select("row_id", "x.value", "x.error")


_CELLS = [("quantity", "3 days", "3.0000", "quantity", "quantity"), ("unit_price", " 1,250.00 ", "1250.0000", "unit_price", "rate"), ("net_amount", "(40)", "-40.0000", "net_amount", "amount"), ("net_amount", "n/a", None, None, None), ("service_date", "05/03/2024", "2024-03-05", "service_date_iso", "service_date"), ("service_date", "soon", None, None, None), ("service_code", "AB12", "AB12", "service_code", "service_code"), ("service_code", "AB", None, None, None), ("description", "Bed  charge", "Bed charge", "description", "description"), ("section", "12.00", None, None, None), ("hsn_code", "", None, None, None)]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, {pick_sql([c[2] for c in _CELLS], 'part')} AS value, {pick_sql([c[3] for c in _CELLS], 'part')} AS target, {pick_sql([c[4] for c in _CELLS], 'part')} AS evidence FROM ledger""")
def alias_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fields.alias_value(pick([c[0] for c in _CELLS], F.col("part")), pick([c[1] for c in _CELLS], F.col("part")))
    return ledger(spark, sf_dir).select("row_id", x.alias("x")).select("row_id", "x.value", "x.target", "x.evidence")


_NAMES = ["Bill of March.pdf", "a/b/H 12.tar.gz", "---.pdf", "", "naïve bill", ".hidden", "x_y-z.v2.json"]


@query(f"""SELECT p_partkey, {pick_sql(['Bill-of-March', 'H-12.tar', 'bill', 'bill', 'na-ve-bill', 'hidden', 'x_y-z.v2'], 'p_partkey')} AS stem, CASE WHEN p_partkey % 4 = 0 THEN p_size || ' MiB' WHEN p_partkey % 4 = 1 THEN p_size || ' KiB' ELSE p_size || ' bytes' END AS label FROM part""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    size = F.when(k % 4 == 0, s * (1 << 20)).when(k % 4 == 1, s * (1 << 10)).otherwise(s)
    return table(spark, sf_dir, "part").select("p_partkey", fields.download_stem(pick(_NAMES, k)).alias("stem"), fields.byte_label(size).alias("label"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(t), '\\[[^\\]]+\\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS match_text, nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), '') AS header_key, nullif(regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'), '') AS code_key,
  round(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE), 9) AS jaccard, 'UNKNOWN-' || substr(sha256(p_name), 1, 12) AS plain_id, 'H' || (10000 + p_partkey) || 'AB' AS hospital_id
FROM (SELECT *, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b, '[x' || p_size || '] ' || p_brand || ' - ' || p_name || '!' AS t FROM part)""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("[x"), F.col("p_size").cast("string"), F.lit("] "), F.col("p_brand"), F.lit(" - "), F.col("p_name"), F.lit("!"))
    a, b = text.words(F.col("p_name")), text.words(F.concat_ws(" ", "p_type", "p_name"))
    named = F.concat(F.lit("scan h"), (F.col("p_partkey") + 10000).cast("string"), F.lit("ab.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", text.match_text(t).alias("match_text"), text.header_key(t).alias("header_key"), text.code_key(t).alias("code_key"), F.round(text.jaccard(a, b), 9).alias("jaccard"), fields.hospital_id(F.col("p_name")).alias("plain_id"), fields.hospital_id(named).alias("hospital_id"))


_QUANTITIES = [("3 days", "3.0000"), ("3.", "3.0000"), ("2 Day(s)", "2.0000"), ("1,000", "1000.0000"), ("x", None), ("-4.5 days", "-4.5000")]


@query(f"""WITH {LEDGER_SQL} SELECT row_id, CAST({pick_sql([q[1] for q in _QUANTITIES], 'part')} AS DECIMAL(18,4)) AS quantity, sign(cents) * (abs(cents) // 10 + CASE WHEN abs(cents) % 10 > 5 OR (abs(cents) % 10 = 5 AND abs(cents) // 10 % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS half_even, sign(cents) * ((abs(cents) + 5) // 10) / 100.0 AS half_up,
  coalesce(abs(part % 3 - 1) <= 0.01, false) AS matches, CASE WHEN part % 2 = 0 THEN '12.5000,-7.0000' ELSE '' END AS parts FROM ledger""")
def money_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousandth = (F.col("cents").cast("decimal(18,3)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,3)")
    parts = money.numeric_parts(F.when(F.col("part") % 2 == 0, "rate 12.5 less -7").otherwise("only 4"), 2)
    a = F.col("part").cast("decimal(18,4)") % 3
    return ledger(spark, sf_dir).select(
        "row_id", money.parse_quantity(pick([q[0] for q in _QUANTITIES], F.col("part"))).alias("quantity"), money.half_even(thousandth).cast("double").alias("half_even"), money.half_up(thousandth).cast("double").alias("half_up"),
        money.amount_matches(a, F.lit(1).cast("decimal(18,4)")).alias("matches"), F.array_join(F.transform(parts, lambda x: x.cast("string")), ",").alias("parts"),
    )


@query(f"""WITH {_PAIR_SQL} SELECT row_id, round(iou, 9) AS iou, round(greatest(0, 1 - sqrt(((gl + gr - al - ar) / 2) * ((gl + gr - al - ar) / 2) + ((gt + gb - atop - ab) / 2) * ((gt + gb - atop - ab) / 2)) / sqrt(200.0 * 200 + 100 * 100)), 9) AS proximity, CAST(800 AS DOUBLE) AS area, round(2 * gl + 3, 9) AS x, round((gt - 1) / 2, 9) AS y FROM u""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("part"), F.col("quantity")
    g, a = _box(p % 60, q, F.lit(40), F.lit(20)), _box(p % 60 + p % 7 * 5, q + p % 3 * 6, F.lit(40), F.lit(20))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(g["l"], g["t"]), corner(g["r"], g["t"]), corner(g["r"], g["b"]), corner(g["l"], g["b"]))
    m = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    both = geometry.compose(m(2, 0, 3, 0, 0.5, 0, 0, 0, 1), m(1, 0, 0, 0, 1, -1, 0, 0, 1))  # first down by one, then wider and flatter
    x = ledger(spark, sf_dir).select("row_id", g.alias("g"), a.alias("a"), ring.alias("ring"))
    g, a = F.col("g"), F.col("a")
    to = geometry.project(both, g["l"], g["t"])
    return x.select("row_id", F.round(geometry.iou(g, a), 9).alias("iou"), F.round(geometry.centre_proximity(g, a, F.lit(200.0), F.lit(100.0)), 9).alias("proximity"), geometry.shoelace(F.col("ring")).alias("area"), F.round(to["x"], 9).alias("x"), F.round(to["y"], 9).alias("y"))


@query("""SELECT p_partkey, p_size % 7 <> 0 AS has_inverse, CASE WHEN p_size % 7 <> 0 THEN true END AS within FROM part""")
def mapping_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    flat = F.col("p_size") % 7 == 0
    h = F.array(s, F.lit(2.0), k, F.when(flat, s).otherwise(F.lit(1.0)), F.when(flat, F.lit(2.0)).otherwise(s + 3), F.lit(5.0), F.when(flat, F.lit(0.0)).otherwise(F.lit(1e-4)), F.lit(0.0), F.lit(1.0))
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (100.0, 20.0), (640.0, 480.0))])
    return table(spark, sf_dir, "part").select("p_partkey", geometry.inverse(h).isNotNull().alias("has_inverse"), (geometry.round_trip_error(h, points) <= 2.0).alias("within"))


@query()
def polygons_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes under a slight perspective, with as many points as their edges need."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")  # few bytes a row, but hundreds of points to work out
    h = F.array(F.lit(1.0), F.lit(0.1), F.lit(5.0), F.lit(0.05), F.lit(1.0), F.lit(2.0), F.col("p_size") * 1e-5, F.lit(0.0), F.lit(1.0))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = geometry.subdivided(h, F.array(corner(0.0, 0.0), corner(900.0, 0.0), corner(900.0, 600.0), corner(0.0, 600.0)), 0.5)
    found = money.let(ring, lambda r: F.struct(F.size(r).alias("points"), F.round(geometry.shoelace(r), 3).alias("area")))
    return p.select("p_partkey", found.alias("found")).select("p_partkey", "found.points", "found.area")


# Profiles, cohorts, graphs

_METRICS = {"holdout_bills": 12, "holdout_rows": 220, "precision": 96, "recall": 97, "f1": 96, "precision_low": 88, "recall_low": 87, "f1_low": 86, "amount_accuracy": 97, "negative_recall": 1, "ungrounded": 0, "incomplete_pages": 0, "identity_ambiguities": 0, "unsafe_numeric": 0, "field_failures": 0, "capture_conditions": 2}


@query("""SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'missing_metrics' ELSE concat_ws(',', CASE WHEN p_size % 6 = 0 THEN 'holdout_bills_below_10' END, CASE WHEN p_size % 7 = 0 THEN 'holdout_rows_below_200' END, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN 'row_metrics_below_95_percent' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'accepted_ungrounded_rows' END, CASE WHEN p_size % 10 = 3 THEN 'construction_holdout_leakage' END, CASE WHEN p_size % 4 = 1 THEN 'missing_calibration_artifact' END, CASE WHEN p_partkey % 9 = 0 THEN 'missing_core_supported_fields' END) END AS failures FROM part""")
def activation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    share = {"precision", "recall", "f1", "precision_low", "recall_low", "f1_low", "amount_accuracy"}
    value = {n: F.lit(v / 100.0 if n in share else v) for n, v in _METRICS.items()}
    value["holdout_bills"] = F.when(s % 6 == 0, 9).otherwise(12)
    value["holdout_rows"] = F.when(s % 7 == 0, F.lit(None).cast("int")).otherwise(220)
    value["recall"] = F.when(k % 5 == 0, 0.90).when(k % 11 != 0, 0.97)
    value["ungrounded"] = F.when(k % 7 == 0, 1).otherwise(0)
    m = F.when(k % 23 != 0, F.struct(*[v.alias(n) for n, v in value.items()]))
    sets = F.array(F.lit("a"), F.lit("b"))
    held = F.when(s % 10 == 3, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    supported = F.when(k % 9 == 0, F.array(F.lit("amount"))).otherwise(F.array(F.lit("amount"), F.lit("description")))
    x = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), held.alias("held"), F.when(s % 4 != 1, "cal").alias("cal"), supported.alias("sup"))
    return x.select("p_partkey", F.array_join(profiles.activation_failures(F.col("m"), F.array(F.lit("scan")), sets, F.col("held"), F.col("cal"), F.col("sup")), ",").alias("failures"))


@query("""WITH p AS (SELECT p_brand AS profile_key, p_partkey AS version, (['active', 'archived', 'drifted', 'draft'])[CAST(p_size % 4 + 1 AS INTEGER)] AS lifecycle, p_partkey % 3 <> 0 AS passed FROM part)
SELECT profile_key, max(version) FILTER (lifecycle = 'active') AS archive_version, max(version) FILTER (lifecycle IN ('archived', 'drifted') AND passed) AS activate_version FROM p GROUP BY profile_key HAVING count(*) FILTER (lifecycle = 'active') > 0 AND count(*) FILTER (lifecycle IN ('archived', 'drifted') AND passed) > 0""")
def profile_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("profile_key"), F.col("p_partkey").alias("version"), pick(["active", "archived", "drifted", "draft"], F.col("p_size")).alias("lifecycle"), (F.col("p_partkey") % 3 != 0).alias("passed"))
    return profiles.rollback(p)


_LIVES = ["candidate", "shadow", "active", "drifted", "archived"]


@query("""WITH a AS (SELECT * FROM (VALUES {}) t(f, t)) SELECT p_partkey AS version, EXISTS (SELECT 1 FROM a WHERE a.f = {} AND a.t = {}) AS allowed FROM part""".format(", ".join(f"('{f}', '{t}')" for f, t, *_ in profiles.TRANSITIONS), pick_sql(_LIVES, "p_size"), pick_sql(_LIVES, "p_partkey")))
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("profile_key"), F.col("p_partkey").alias("version"), pick(_LIVES, F.col("p_size")).alias("from_state"), pick(_LIVES, F.col("p_partkey")).alias("to_state"))
    return profiles.transitions(e).select("version", "allowed")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'aggregate_row_metrics_below_90_percent' END, CASE WHEN p_partkey % 7 = 0 THEN 'accepted_ungrounded_rows' END, CASE WHEN p_partkey % 4 = 0 THEN 'unseen_10_hospital_gate_missing' WHEN p_size % 3 = 0 THEN 'unseen_row_metrics_below_85_percent' END,
  CASE WHEN p_partkey % 9 = 0 THEN 'known_active_profile_gate_missing' END, CASE WHEN p_size % 8 = 0 THEN 'active_zero_call_fraction_below_95_percent' END) AS failures FROM part""")
def cohort_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    c = {n: F.lit(v) for n, v in dict(all_rows=0.95, all_amount=0.97, all_negative=1.0, ungrounded=0, privacy=0, unseen_hospitals=12, unseen_rows=0.9, known_documents=10, known_gold=200, known_rows=0.96, known_amount=0.96, known_negative=1.0, bound=0.9, active=3, zero_calls=0.97).items()}
    c |= {"all_rows": F.when(s % 5 == 0, 0.8).otherwise(0.95), "ungrounded": F.when(k % 7 == 0, 2).otherwise(0), "unseen_hospitals": F.when(k % 4 == 0, 9).otherwise(10), "unseen_rows": F.when(s % 3 == 0, 0.8).otherwise(0.9), "known_gold": F.when(k % 9 == 0, 199).otherwise(200), "zero_calls": F.when(s % 8 == 0, 0.5).otherwise(0.97)}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(metrics.cohort_failures(c), ",").alias("failures"))


@query(f"""WITH {LEDGER_SQL} SELECT row_id, array_to_string(list(description) OVER (PARTITION BY document_id ORDER BY row_order ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING), ' ') AS local_text FROM ledger""")
def neighbour_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.context_text(ledger(spark, sf_dir), ["document_id"], ["row_order"], "description").select("row_id", "local_text")


_PRIVATE = ["Patient Name", "Asha Rao", "UHID", "12345678", "ward 3", "a@b.in", "9876543210", "Amount"]


@query(rf"""WITH {LEDGER_SQL}, k AS (SELECT *, {pick_sql(_PRIVATE, 'part')} AS text, part % 80 * 10.0 AS l, row_order * 7.0 AS t FROM ledger),
m AS (SELECT *, greatest(6, median(10.0) OVER (PARTITION BY document_id, page) * 0.75) AS tol, text IN ('Patient Name', 'UHID') AS label FROM k)
SELECT b.row_id, b.text IN ('Patient Name', 'UHID', '12345678', 'a@b.in', '9876543210') OR EXISTS (SELECT 1 FROM m a WHERE a.label AND a.document_id = b.document_id AND a.page = b.page AND a.row_id <> b.row_id AND b.l >= a.l AND b.l <= a.l + 60 + 450 AND (abs(b.t - a.t) <= a.tol OR (b.t > a.t AND b.t - a.t <= a.tol * 2.5 AND b.l >= a.l - 50))) AS masked FROM m b""")
def sibling_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ledger(spark, sf_dir).select("document_id", "page", F.col("row_id").alias("token_id"), pick(_PRIVATE, F.col("part")).alias("text"), _box(F.col("part") % 80 * 10, F.col("row_order") * 7, F.lit(60), F.lit(10)).alias("box"), F.lit(1000.0).alias("page_width"))
    return identity.sensitive_tokens(tokens).select(F.col("token_id").alias("row_id"), "masked")


@query("""WITH j AS (SELECT o_orderkey AS job_id, CAST(o_orderdate AS TIMESTAMP) AS a FROM orders), r AS (SELECT o_orderkey AS job_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 40 DAY AS a FROM orders WHERE o_orderkey % 3 = 0)
SELECT j.job_id FROM j LEFT JOIN r ON j.job_id = r.job_id WHERE greatest(j.a, coalesce(r.a, j.a)) < TIMESTAMP '1997-06-30' - INTERVAL 30 DAY""")
def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    r = o.where("job_id % 3 = 0").select("job_id", F.expr("updated_at + interval 40 days").alias("reviewed_at"))
    return drift.expired(o, r, F.lit("1997-06-30").cast("timestamp"), 30).select("job_id")


@query("""WITH n AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 10 <> 3), e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)
SELECT child AS node, 'missing_parent' AS fault FROM e WHERE parent NOT IN (SELECT node FROM n)""")
def artifact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    nodes = p.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("node"))
    edges = p.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.graph_faults(nodes, edges)
