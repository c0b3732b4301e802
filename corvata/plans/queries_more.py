"""More queries: choosing between readings, recovery, alignment, and evaluation against authoritative cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.functions.text import plain
from corvata.operators import alignment, layout, recovery, selection
from corvata.operators import ledger as L
from corvata.operators.reconstruction import UNIT, reconstruct
from corvata.plans import authority
from corvata.plans.queries import PLAIN_SQL, query
from corvata.sources.testtables import LEDGER_SQL, PREDICTED_SQL, ledger, predicted, table

NAMES = ("raw", "bright", "straight")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table of a page as seen raw and in two changed variants, a little displaced."""
    t = ledger(spark, sf_dir).groupBy("document_id", "page", "table_id").agg(F.min("part").alias("k"), F.collect_set("section").alias("words"))
    t = t.select("*", F.posexplode(F.array(*[F.lit(v) for v in NAMES])).alias("preference", "variant"))
    left, top = (F.col("k") % 60 * 10).cast("double"), (F.col("table_id").cast("long") * 7919 % 120 * 10).cast("double")
    off = F.col("preference") * (F.col("k") % 40).cast("double")
    box = F.struct((left + off).alias("l"), top.alias("t"), (left + off + 300).alias("r"), (top + 200).alias("b"))
    words = F.when(F.col("preference") < 2, F.col("words")).otherwise(F.array().cast("array<string>"))
    return t.select("document_id", "page", F.concat_ws(":", "variant", "table_id").alias("proposal_id"), "variant", "preference", box.alias("box"), F.lit(1).alias("reading_order"), F.lit("item_ledger").alias("table_type"), words.alias("words"), F.lit(1000.0).alias("page_width"), F.lit(2000.0).alias("page_height"), (F.col("k") % 9 == 0).alias("grounded"), "k")


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, page, table_id, min(part) AS k, list(DISTINCT section) AS words FROM ledger GROUP BY document_id, page, table_id),
p AS (SELECT document_id, page, x.v || ':' || table_id AS id, x.v AS variant, CAST(k % 60 * 10 + x.i * (k % 40) AS DOUBLE) AS l, CAST(CAST(table_id AS BIGINT) * 7919 % 120 * 10 AS DOUBLE) AS top, CASE WHEN x.i < 2 THEN words ELSE [] END AS words FROM (SELECT *, unnest([{{'i': 0, 'v': 'raw'}}, {{'i': 1, 'v': 'bright'}}, {{'i': 2, 'v': 'straight'}}]) AS x FROM t)),
m AS (SELECT b.document_id, b.page, b.variant, a.id AS anchor_id, b.id AS candidate_id, greatest(0, 300 - abs(a.l - b.l)) * greatest(0, 200 - abs(a.top - b.top)) AS common, sqrt((a.l - b.l) * (a.l - b.l) + (a.top - b.top) * (a.top - b.top)) / sqrt(5000000.0) AS far, len(list_intersect(a.words, b.words)) AS w, len(a.words) AS na, len(b.words) AS nb
  FROM p a JOIN p b ON a.document_id = b.document_id AND a.page = b.page WHERE a.variant = 'raw' AND b.variant <> 'raw'),
e AS (SELECT document_id, page, variant, anchor_id, candidate_id, round(0.45 * common / (120000 - common) + 0.15 * greatest(0, 1 - far) + 0.2 + CASE WHEN nb > 0 THEN 0.2 * w / (na + nb - w) ELSE 0 END, 6) AS score FROM m)
SELECT *, CASE WHEN score < 0.6 THEN 'rejected_below_threshold' WHEN EXISTS (SELECT 1 FROM e o WHERE o.document_id = e.document_id AND o.page = e.page AND o.variant = e.variant AND o.score >= 0.6 AND e.score - o.score < 0.1 AND ((o.anchor_id = e.anchor_id) <> (o.candidate_id = e.candidate_id))) THEN 'abstained_ambiguous' ELSE 'accepted_maximum_weight' END AS reason FROM e""")
def proposal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.proposal_edges(_proposals(spark, sf_dir), "raw")


@query()
def derived_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _proposals(spark, sf_dir)
    return selection.derived_tables(p, selection.proposal_edges(p, "raw"), "raw")


@query(f"""WITH {LEDGER_SQL}, v AS (SELECT document_id, page, row_id AS proposal_id, quantity % 5 AS score, part % 3 AS tokens, abs(cents) % 7 AS distortion, CAST(part % 3 AS INTEGER) AS preference FROM ledger)
SELECT document_id, page, proposal_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY score DESC, tokens DESC, distortion, preference, proposal_id DESC) AS r FROM v) WHERE r <= 2""")
def table_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ledger(spark, sf_dir).select("document_id", "page", F.col("row_id").alias("proposal_id"), (F.col("quantity") % 5).alias("score"), (F.col("part") % 3).alias("tokens"), (F.abs("cents") % 7).alias("distortion"), (F.col("part") % 3).cast("int").alias("preference"))
    return selection.best_variants(v, ["document_id", "page"], ["score", "tokens"], ["distortion"], 2).select("document_id", "page", "proposal_id", "rank")


_VARIANT_SQL = f"""{LEDGER_SQL}, pg AS (SELECT document_id, page, sum(quantity) AS q, sum(part) AS p, count(*) AS n FROM ledger GROUP BY document_id, page), v AS (SELECT document_id, page, x.i AS preference, ['raw', 'bright', 'straight'][x.i + 1] AS variant, q + x.i * (p % 9 - 4) AS tokens, (80 + x.i * (p % 7 - 3)) / 100.0 AS confidence, n + CASE WHEN x.i > 0 AND p % 4 = 0 THEN 1 ELSE 0 END AS financial, 1 AS tables, (p + x.i) % 3 AS score FROM pg, (VALUES (0), (1), (2)) x(i))"""


@query(f"""WITH {_VARIANT_SQL}, j AS (SELECT v.*, v.preference > 0 AND (r.tokens < 10 OR v.tokens >= greatest(1, round_even(r.tokens * 0.9, 0))) AND v.confidence >= r.confidence - 0.03 AND v.financial >= r.financial AND v.score >= r.score
  AND (v.score > r.score OR v.financial > r.financial OR v.tokens >= r.tokens + greatest(3, round_even(r.tokens * 0.1, 0)) OR v.confidence >= r.confidence + 0.05) AS safe FROM v JOIN v r ON r.document_id = v.document_id AND r.page = v.page AND r.preference = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY safe DESC, score DESC, financial DESC, tokens DESC, confidence DESC, preference) AS n FROM j WHERE safe OR preference = 0)
SELECT document_id, page, variant, CASE WHEN safe THEN 'selected_safe_structural_improvement' ELSE 'selected_raw_no_safe_improvement' END AS reason FROM k WHERE n = 1""")
def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = ledger(spark, sf_dir).groupBy("document_id", "page").agg(F.sum("quantity").alias("q"), F.sum("part").alias("p"), F.count(F.lit(1)).alias("n"))
    x = pg.select("*", F.posexplode(F.array(*[F.lit(v) for v in NAMES])).alias("preference", "variant"))
    i, p = F.col("preference"), F.col("p")
    v = x.select("document_id", "page", "preference", "variant", (F.col("q") + i * (p % 9 - 4)).alias("tokens"), ((80 + i * (p % 7 - 3)) / F.lit(100.0)).alias("confidence"), (F.col("n") + F.when((i > 0) & (p % 4 == 0), 1).otherwise(0)).alias("financial"), F.lit(1).alias("tables"), ((p + i) % 3).alias("score"))
    return selection.page_variant(v)


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, table_id, count(*) AS n, min(part) AS k FROM ledger GROUP BY document_id, table_id),
u AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0 ELSE n END AS rws, 8 + k % 20 AS lines, (['item_ledger', 'unknown', 'payment', 'pharmacy'])[1 + k % 4] AS tt, CASE WHEN k % 5 = 0 THEN ['line_arithmetic_mismatch'] ELSE [] END AS fl FROM t),
r AS (SELECT *, CASE WHEN tt = 'payment' THEN [] ELSE list_filter([CASE WHEN rws = 0 THEN 'zero_yield' WHEN rws BETWEEN 1 AND 2 AND lines >= 12 AND rws / lines < 0.2 THEN 'low_yield' END, CASE WHEN len(fl) > 0 THEN 'validation_failure' END, CASE WHEN k % 6 = 0 THEN 'no_schema' END, CASE WHEN tt = 'unknown' THEN 'unknown_table' END, CASE WHEN k % 13 = 0 THEN 'vlm_truncated' END, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'profile_ambiguous' END], lambda x: x IS NOT NULL) END AS reasons FROM u)
SELECT document_id, table_id, CASE WHEN len(reasons) > 0 AND (NOT (k % 2 = 0 AND k % 3 = 0) OR list_contains(reasons, 'validation_failure')) THEN 'local_recovery' WHEN k % 2 = 0 AND k % 3 = 0 THEN 'profile_fast' ELSE 'local_ocr' END AS route, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN 'high_resolution,photometric,crop_ocr,local_vlm,review' ELSE '' END AS stages FROM r""")
def recovery_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir).groupBy("document_id", "table_id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("k"))
    k = F.col("k")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("item_ledger", "unknown", "payment", "pharmacy")]), (k % 4 + 1).cast("int"))
    flags = F.when(k % 5 == 0, F.array(F.lit("line_arithmetic_mismatch"))).otherwise(F.array().cast("array<string>"))
    x = t.select("document_id", "table_id", F.when(k % 11 == 0, 0).otherwise(F.col("n")).alias("rows"), (8 + k % 20).alias("lines"), kinds.alias("table_type"), (k % 6 != 0).alias("has_schema"), flags.alias("flags"), (k % 13 == 0).alias("truncated"), F.when(k % 2 == 0, "p").alias("profile_key"), (k % 3 == 0).alias("profile_selected"))
    return recovery.routing(x)


def _reading(rows: DataFrame, bad) -> DataFrame:
    flags = F.when(bad, F.array(F.lit("line_arithmetic_mismatch"))).otherwise(F.array().cast("array<string>"))
    x = rows.withColumn("publishable", F.col("role") != "metadata").withColumn("grounded", F.col("part") % 2 == 0).withColumn("flags", flags).withColumn("mapped", (F.col("part") % 4).cast("int")).withColumn("cells", F.lit(5))
    q = recovery.quality_tuple(x, ["document_id", "table_id"])
    n = x.groupBy("document_id", "table_id").agg(F.count_if("publishable").alias("published"), F.sum(F.when(F.col("publishable"), F.col("mapped")).otherwise(0)).alias("mapped"))
    return q.join(n, ["document_id", "table_id"]).withColumn("table_type", F.lit("item_ledger"))


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT document_id, table_id, count(*) FILTER (role <> 'metadata') AS pub, count(*) FILTER (part % 3 = 0) AS b0, count(*) FILTER (part % 3 = 0 AND part % 2 = 0) AS b1 FROM ledger GROUP BY document_id, table_id)
SELECT document_id, table_id, b1 < b0 AS safe FROM o""")
def safe_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    old, new = _reading(rows, F.col("part") % 3 == 0), _reading(rows, F.col("part") % 6 == 0)
    matched = old.select("document_id", "table_id", F.col("published").alias("pairs"), F.lit(0).alias("worse"), F.lit(0).alias("stray"))
    return recovery.safe_improvement(old, new, matched)


@query(f"""WITH {LEDGER_SQL}, a AS (SELECT document_id, row_order, CASE WHEN part % 10 = 0 THEN 'nonsense' ELSE 'description' END AS field, part, row_id FROM ledger)
SELECT document_id, row_order, field, CASE WHEN part % 10 = 0 THEN 'unknown_field' WHEN part % 9 = 0 THEN 'unknown_token' WHEN part % 8 = 0 THEN 'out_of_crop' WHEN part % 7 = 0 THEN 'polygon_token_mismatch' WHEN part % 6 = 0 THEN 'column_mismatch' WHEN part % 5 = 0 THEN 'unsupported_value' END AS reason FROM a""")
def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = ledger(spark, sf_dir), F.col("part")
    box = lambda left, top: F.struct(left.alias("l"), F.lit(top).alias("t"), (left + 50.0).alias("r"), F.lit(top + 10.0).alias("b"))
    tokens = r.select("document_id", F.col("row_id").alias("token_id"), F.col("description").alias("text"), box(F.lit(10.0), 20.0).alias("box"))
    left = F.when(p % 8 == 0, -5.0).when(p % 7 == 0, 500.0).otherwise(10.0)
    answers = r.select("document_id", "row_order", F.when(p % 10 == 0, "nonsense").otherwise("description").alias("field"), F.when(p % 5 == 0, "not printed").otherwise(F.col("description")).alias("raw_value"), F.array(F.when(p % 9 == 0, F.concat(F.lit("no-"), "row_id")).otherwise(F.col("row_id"))).alias("token_ids"), box(left, 20.0).alias("box"), F.lit(1000).alias("crop_width"), F.lit(1000).alias("crop_height"), F.when(p % 6 == 0, 0.9).otherwise(0.035).alias("centre"))
    return recovery.grounded(answers, tokens, ("description", "amount"))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT document_id, row_order, CASE WHEN part % 3 = 1 THEN '' ELSE description END AS d, CASE WHEN part % 3 = 2 THEN 0 ELSE 1 END AS n, CASE WHEN part % 3 <> 2 THEN cents END AS v FROM ledger),
w AS (SELECT *, d <> '' AND n = 0 AS t, d = '' AND n > 0 AS b FROM s), x AS (SELECT *, t AND coalesce(lead(b) OVER o, false) AS merged, b AND coalesce(lag(t) OVER o, false) AS used, CASE WHEN t AND coalesce(lead(b) OVER o, false) THEN lead(v) OVER o ELSE v END AS nv FROM w WINDOW o AS (PARTITION BY document_id ORDER BY row_order))
SELECT document_id, row_order, d AS description, nv AS "values", merged FROM x WHERE NOT used""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part") % 3
    rows = ledger(spark, sf_dir).select("document_id", "row_order", F.when(p == 1, "").otherwise(F.col("description")).alias("description"), F.when(p == 2, 0).otherwise(1).alias("numbers"), F.when(p != 2, F.col("cents")).alias("values"))
    return alignment.continuations(rows, ["document_id"], "row_order").select("document_id", "row_order", "description", "values", "merged")


@query()
def provider_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    ours = r.select("document_id", F.col("page").cast("string").alias("table_id"), F.col("row_order").alias("input"), "description", "cents")
    theirs = predicted(r).select("document_id", F.col("page").cast("string").alias("table_id"), (F.col("row_order") * 2 + F.col("copy")).alias("input"), "description", "cents")
    return alignment.fused(ours, theirs)


@query()
def token_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    top = (F.col("row_order") * 30).cast("double")
    word = lambda kind, text, left, cents: r.where(F.col("part") % 17 != kind).select("document_id", "page", F.concat(F.lit(f"{kind}-"), "row_id").alias("token_id"), text.alias("text"), cents.alias("cents"), F.struct(F.lit(left).alias("l"), top.alias("t"), F.lit(left + 200).alias("r"), (top + 12).alias("b")).alias("box"))
    tokens = word(0, F.col("description"), 10.0, F.lit(None).cast("long")).unionByName(word(1, F.col("cents").cast("string"), 700.0, F.col("cents")))
    return alignment.grounded_rows(r.select("document_id", "page", F.col("row_order").alias("input"), "description", "cents"), tokens)


def _cells(rows: DataFrame) -> DataFrame:
    p = F.col("part")
    cols = F.array(*[F.struct(F.lit(i).alias("column_key"), F.lit(role).alias("role"), v.alias("value")) for i, (role, v) in enumerate((("description", F.col("description")), ("quantity", F.col("quantity").cast("string")), ("amount", F.col("cents").cast("string"))))])
    return rows.select("document_id", "table_id", F.col("row_order").alias("row_key"), p.alias("part"), F.explode(cols).alias("c")).select("document_id", "table_id", "row_key", "part", "c.column_key", "c.role", "c.value")


_CELLS_SQL = f"""{LEDGER_SQL}, {PREDICTED_SQL}, gc AS (SELECT document_id, table_id, row_order, part, unnest([0, 1, 2]) AS ck, unnest(['description', 'quantity', 'amount']) AS role, unnest([description, CAST(quantity AS VARCHAR), CAST(cents AS VARCHAR)]) AS v FROM ledger),
ac AS (SELECT document_id, table_id, row_order, part, unnest([0, 1, 2]) AS ck, unnest(['description', 'quantity', 'amount']) AS role, unnest([description, CAST(quantity AS VARCHAR), CAST(cents AS VARCHAR)]) AS v FROM predicted WHERE copy = 0),
j AS (SELECT coalesce(g.document_id, a.document_id) AS document_id, g.part AS gp, a.part AS ap, g.part % 14 <> 0 AS gr, a.part % 21 <> 0 AS ar, g.v = a.v AS same, a.part % 21 <> 0 AND list_contains((SELECT list(v) FROM ac b WHERE b.document_id = g.document_id AND b.table_id = g.table_id AND b.row_order = g.row_order), g.v) AS other FROM gc g FULL JOIN ac a ON g.document_id = a.document_id AND g.table_id = a.table_id AND g.row_order = a.row_order AND g.ck = a.ck)"""


@query(f"""WITH {_CELLS_SQL}, o AS (SELECT document_id, CASE WHEN ap IS NULL THEN 'missing' WHEN gp IS NULL THEN 'extra' WHEN NOT gr AND NOT ar THEN 'unreadable' WHEN gr <> ar THEN 'readability_mismatch' WHEN NOT same AND other THEN 'wrong_column' WHEN same THEN 'exact' ELSE 'wrong_value' END AS outcome FROM j) SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def authority_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ledger(spark, sf_dir)
    actual = predicted(gold).where("copy = 0")
    return authority.cell_outcomes(_cells(gold).withColumn("readable", F.col("part") % 14 != 0), _cells(actual).withColumn("readable", F.col("part") % 21 != 0))


@query(f"""WITH {_CELLS_SQL}, c AS (SELECT count(gp) AS gold_cells, count(ap) AS actual_cells, count(*) FILTER (gp IS NOT NULL AND ap IS NOT NULL) AS aligned, count(*) FILTER (gr) AS ga, count(*) FILTER (ar) AS aa, count(*) FILTER (gr AND ar AND same) AS exact, count(*) FILTER (NOT gr AND NOT ar) AS un, count(*) FILTER (NOT gr) AS gu, count(*) FILTER (NOT ar) AS au FROM j)
SELECT round((exact + un) / aa, 12) AS "precision", round((exact + un) / ga, 12) AS recall, round(aligned / actual_cells, 12) AS cell_structure_precision, round(aligned / gold_cells, 12) AS cell_structure_recall, round(exact / ga, 12) AS readable_cell_recall, round(un / au, 12) AS unreadable_precision, round(un / gu, 12) AS unreadable_recall FROM c""")
def authority_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = authority.cell_counts(_outcomes(spark, sf_dir), ["document_id"])
    return authority.micro_average(counts).select("precision", "recall", "cell_structure_precision", "cell_structure_recall", "readable_cell_recall", "unreadable_precision", "unreadable_recall")


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, row_id, (['Advance', 'Amount Received ', '', ''])[1 + part % 4] || CASE WHEN part % 4 = 0 THEN '' ELSE description END AS d, (['item_ledger', 'payment', 'metadata', 'category_summary', 'pharmacy'])[1 + part % 5] AS tt, cents, part % 23 = 0 AS m FROM ledger), n AS (SELECT *, {PLAIN_SQL.format('d')} AS x FROM t)
SELECT document_id, row_id, CASE WHEN m THEN 'unresolved' WHEN tt = 'payment' OR x = 'advance' OR contains(x, 'amount received') THEN 'payment' WHEN tt = 'metadata' THEN 'unresolved' WHEN tt = 'category_summary' THEN 'category_rollup' WHEN cents < 0 THEN 'refund' ELSE 'detail' END AS role FROM n""")
def charge_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Advance", "Amount Received ", "", "")]), (p % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("item_ledger", "payment", "metadata", "category_summary", "pharmacy")]), (p % 5 + 1).cast("int"))
    role = L.charge_role(F.concat(lead, F.when(p % 4 == 0, "").otherwise(F.col("description"))), p % 23 == 0, kind, F.col("cents"))
    return ledger(spark, sf_dir).select("document_id", "row_id", role.alias("role"))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, count(*) AS charges, sha256(string_agg(x, ';' ORDER BY x)) AS inventory FROM (SELECT document_id, {PLAIN_SQL.format('description')} || '|' || cents AS x FROM ledger WHERE role IN ('detail', 'refund', 'category_rollup')) GROUP BY document_id""")
def financial_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's multiset of charges."""
    r = ledger(spark, sf_dir).where(F.col("role").isin(*L.ITEM_ROLES)).select("document_id", F.concat_ws("|", plain(F.col("description")), "cents").alias("x"))
    return r.groupBy("document_id").agg(F.count(F.lit(1)).alias("charges"), F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ";"), 256).alias("inventory"))


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL}, a AS (SELECT document_id, section, cents, row_number() OVER (PARTITION BY document_id, section, cents) AS k FROM ledger), b AS (SELECT document_id, section, cents, row_number() OVER (PARTITION BY document_id, section, cents) AS k FROM predicted)
SELECT 'old' AS side, document_id, section, cents FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', document_id, section, cents FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def reading_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    return recovery.unlike(r, predicted(r), ["document_id", "section", "cents"])


@query("""SELECT c_mktsegment AS hospital, count(*) AS pages, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS table_recall, CAST(sum(o_orderkey % 1000) AS BIGINT) AS total_ms, max(o_orderkey % 1000) AS max_ms, count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS zero_calls FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def layout_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hospital: pages, the share with a table, time, and the share of pages without model calls."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("hospital")), F.col("o_custkey") == F.col("c_custkey"))
    ms = F.col("o_orderkey") % 1000
    return o.groupBy("hospital").agg(F.count(F.lit(1)).alias("pages"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("table_recall"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"), F.avg((F.col("o_orderkey") % 3 == 0).cast("int")).alias("zero_calls"))


@query()
def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of tokens on pages, and the tables that they make."""
    r = ledger(spark, sf_dir)
    top = (F.col("row_order") * 22 + F.col("part") % 5).cast("double")
    words = F.split("description", " ")
    t = r.select("document_id", "page", "row_id", top.alias("top"), F.posexplode(F.concat(words, F.array(F.col("quantity").cast("string"), F.abs("cents").cast("string")))).alias("i", "text"))
    left = (F.col("i") * 90).cast("double")
    tokens = t.select("document_id", "page", F.concat_ws("-", "row_id", "i").alias("token_id"), "text", F.struct(left.alias("l"), F.col("top").alias("t"), (left + 80).alias("r"), (F.col("top") + 14).alias("b")).alias("box"))
    return layout.table_proposals(layout.line_texts(layout.lines(tokens)))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, page, row_order, description, quantity, CAST(abs(cents) // quantity * CASE WHEN cents < 0 THEN -1 ELSE 1 END * quantity AS BIGINT) AS cents, CASE WHEN cents < 0 THEN 'refund' ELSE 'detail' END AS role FROM ledger WHERE abs(cents) >= quantity""")
def reconstructed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger printed as lines of tokens and read back; a quantity in five is left out and derived."""
    r = ledger(spark, sf_dir).withColumn("unit", F.expr("abs(cents) div quantity")).where("unit > 0")
    signed = F.when(F.col("cents") < 0, -F.col("unit") * F.col("quantity")).otherwise(F.col("unit") * F.col("quantity"))
    money = lambda c: F.format_string("%.2f", c / 100.0)
    cell = lambda x, text: F.struct(F.lit(x).alias("x"), text.alias("text"))
    cells = F.array(cell(0.05, F.col("row_order").cast("string")), cell(0.3, F.col("description")), cell(0.6, F.when(F.col("part") % 5 != 0, F.col("quantity").cast("string"))), cell(0.75, money(F.col("unit"))), cell(0.95, money(signed)))
    body = r.select("document_id", "page", "row_order", F.posexplode(cells).alias("i", "c"))
    head = r.select("document_id", "page").distinct().select("document_id", "page", F.lit(-1).alias("row_order"), F.posexplode(F.array(*[cell(x, F.lit(t)) for x, t in ((0.05, "Sr No"), (0.3, "Particulars"), (0.6, "Qty"), (0.75, "Rate"), (0.95, "Net Amount"))])).alias("i", "c"))
    printed = head.unionByName(body).where("c.text is not null")
    tokens = printed.select("document_id", "page", F.lit("t").alias("table_id"), F.col("row_order").alias("line"), F.concat_ws("-", "row_order", "i").alias("token_id"), "c.text", "c.x", (F.col("row_order") * 20 + 20).cast("double").alias("y"), F.lit(10.0).alias("height"), F.lit("item_ledger").alias("table_type"))
    found = reconstruct(tokens)
    order = F.split("amount_token", "-")[0].cast("int")
    return found.select("document_id", "page", order.alias("row_order"), "description", (F.col("quantity") / UNIT).cast("long").alias("quantity"), (F.col("amount") / (UNIT / 100)).cast("long").alias("cents"), "role")
