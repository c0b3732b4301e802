"""Queries on the rules that need more than single rows, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvata.plans import rules
from corvata.plans.queries import query
from corvata.plans.queries_core import _box, pick, pick_sql
from corvata.sources.testtables import LEDGER_SQL, ledger, table


def _part() -> Column:
    return F.col("part")


@query(f"""WITH {LEDGER_SQL}, p AS (SELECT document_id, row_id, 'p-' || row_id AS pid, part, CASE WHEN part % 5 = 0 THEN NULL WHEN part % 11 = 0 THEN 'gone' WHEN part % 7 = 0 THEN min(row_id) OVER (PARTITION BY document_id) ELSE row_id END AS linked FROM ledger)
SELECT document_id, 'unknown_canonical_source_link' AS code, 'fatal' AS severity, pid AS row_id FROM p WHERE linked = 'gone' UNION ALL SELECT document_id, 'unlinked_financial_source_row', 'blocking', pid FROM p WHERE linked IS NULL AND part % 2 = 0
UNION ALL SELECT document_id, 'duplicate_canonical_source_link', 'blocking', min(pid) FROM p WHERE linked IS NOT NULL GROUP BY document_id, linked HAVING count(*) > 1
UNION ALL SELECT document_id, 'canonical_source_link_missing', 'blocking', row_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = l.document_id AND p.linked = l.row_id)""")
def link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    first = F.min("row_id").over(Window.partitionBy("document_id"))
    linked = F.when(_part() % 5 == 0, None).when(_part() % 11 == 0, "gone").when(_part() % 7 == 0, first).otherwise(F.col("row_id"))
    printed = r.select("document_id", "page", "table_id", F.concat(F.lit("p-"), "row_id").alias("row_id"), linked.alias("linked_id"), (_part() % 2 == 0).alias("has_money"))
    return rules.link_rules(r, printed).select("document_id", "code", "severity", "row_id")


#: Field, value, what the token says, and whether it says the value.
_SAID = [
    ("net_amount", "1250.00", "₹ 1,250", True), ("net_amount", "1250", "1250 500", False), ("quantity", "3", "3 days", False), ("quantity", "3.0", "3", True), ("description", "Gauze", "  gauze ", True), ("description", "Gauze", "Gauze pad", False),
    ("rate", "10", "Rs 10", True), ("rate", "10", "INR 11", False), ("discount", "-5", "(5)", True), ("service_date", "2024-03-12", "12/03/2024", False), ("service_date", "12/03/2024", "12/03/2024", True), ("amount", " ", "x", True), ("amount", "abc", "5", False),
]


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT *, {pick_sql([str(x[3]) for x in _SAID], 'part')} = 'True' AS ok, {pick_sql([x[1] for x in _SAID], 'part')} = ' ' AS blank FROM ledger)
SELECT document_id, 'evidence_token_missing' AS code, 'fatal' AS severity, row_id FROM c WHERE part % 17 = 0
UNION ALL SELECT document_id, 'canonical_evidence_value_mismatch', 'blocking', row_id FROM c WHERE part % 17 <> 0 AND NOT blank AND (NOT ok OR part % 19 = 0)""")
def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    ids = F.array_compact(F.array(F.concat("row_id", F.lit("/0")), F.when(_part() % 19 == 0, F.concat("row_id", F.lit("/1")))))
    evidence = r.select("document_id", "page", "table_id", "row_id", pick([x[0] for x in _SAID], _part()).alias("field"), pick([x[1] for x in _SAID], _part()).alias("value"), F.explode(ids).alias("token_id"))
    token = lambda n: F.struct(F.concat("row_id", F.lit(f"/{n}")).alias("token_id"), pick([x[2] for x in _SAID], _part()).alias("text"))
    tokens = r.select("document_id", F.inline(F.array_compact(F.array(F.when(_part() % 17 != 0, token(0)), F.when(_part() % 19 == 0, token(1))))))
    return rules.evidence_rules(evidence, tokens).select("document_id", "code", "severity", "row_id")


@query(f"""WITH {LEDGER_SQL}, pg AS (SELECT DISTINCT document_id, page FROM ledger), d AS (SELECT document_id, max(page) + CASE WHEN document_id % 4 = 0 THEN 1 ELSE 0 END AS n FROM pg GROUP BY document_id),
t AS (SELECT DISTINCT document_id, table_id, min(page) OVER (PARTITION BY document_id, table_id) AS page FROM ledger WHERE document_id % 13 <> 0), dp AS (SELECT * FROM pg WHERE document_id % 3 <> 0), dt AS (SELECT * FROM t WHERE document_id % 2 = 0)
SELECT document_id, 'page_inventory_incomplete' AS code, CAST(n AS INTEGER) AS page, NULL AS table_id, NULL AS row_id FROM d WHERE document_id % 4 = 0
UNION ALL SELECT d.document_id, 'page_inventory_incomplete', CAST(i AS INTEGER), NULL, NULL FROM d, range(1, 9) x(i) WHERE i <= n AND (document_id % 4 <> 0 OR i < n) AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.document_id = d.document_id AND pg.page = i)
UNION ALL SELECT document_id, 'page_count_mismatch', NULL, NULL, NULL FROM d WHERE n <> (SELECT count(*) FROM pg WHERE pg.document_id = d.document_id)
UNION ALL SELECT document_id, 'duplicate_source_table_id', page, table_id, NULL FROM t WHERE document_id % 9 = 0
UNION ALL SELECT document_id, 'source_tables_missing', NULL, NULL, NULL FROM d WHERE document_id % 13 = 0
UNION ALL SELECT document_id, 'page_diagnostic_inventory_incomplete', page, NULL, NULL FROM pg WHERE document_id % 3 = 0
UNION ALL SELECT document_id, 'table_diagnostic_inventory_incomplete', page, table_id, NULL FROM t, range(0, 2) x(i) WHERE document_id % 2 <> 0 AND (i = 0 OR document_id % 9 = 0)
UNION ALL SELECT document_id, 'orphan_table_diagnostic', 1, 'gone', NULL FROM d WHERE document_id % 7 = 0
UNION ALL SELECT document_id, 'source_row_anchor_missing', page, NULL, row_id FROM ledger, range(0, 2) x(i) WHERE part % 31 = 0 AND (i = 0 OR part % 37 = 0)
UNION ALL SELECT document_id, 'duplicate_source_row_id', page, CASE WHEN part % 31 <> 0 THEN table_id END, row_id FROM ledger WHERE part % 37 = 0""")
def inventory_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    pages = r.select("document_id", "page").distinct()
    documents = pages.groupBy("document_id").agg((F.max("page") + F.when(F.col("document_id") % 4 == 0, 1).otherwise(0)).alias("page_count"))
    tables = r.where("document_id % 13 <> 0").groupBy("document_id", "table_id").agg(F.min("page").alias("page"))
    diagnosed = pages.where("document_id % 3 <> 0").select("*", F.lit(None).cast("string").alias("table_id")).unionByName(tables.where("document_id % 2 = 0"))
    diagnosed = diagnosed.unionByName(documents.where("document_id % 7 = 0").select("document_id", F.lit(1).alias("page"), F.lit("gone").alias("table_id")))
    rows = r.select("document_id", "page", F.when(_part() % 31 != 0, F.col("table_id")).alias("table_id"), "row_id", "part")
    rows = rows.unionByName(rows.where("part % 37 = 0")).drop("part")
    found = rules.inventory_rules(documents, pages, tables.unionByName(tables.where("document_id % 9 = 0")), rows, diagnosed)
    return found.select("document_id", "code", "page", "table_id", "row_id")


@query(f"""WITH {LEDGER_SQL} SELECT row_id, 'duplicate_token_manifest_id' AS code FROM ledger WHERE part % 29 = 0 UNION ALL SELECT row_id, 'token_bounds_invalid' FROM ledger, range(0, 2) x(i) WHERE (i = 0 OR part % 29 = 0) AND (part % 90 * 10 + 120 > 1000 OR part % 41 = 0)
UNION ALL SELECT row_id, 'token_manifest_entry_invalid' FROM ledger, range(0, 2) x(i) WHERE (i = 0 OR part % 29 = 0) AND part % 23 = 0""")
def token_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(_part() % 41 != 0, _box(_part() % 90 * 10, F.col("row_order") * 10, F.lit(120), F.lit(40)))
    t = ledger(spark, sf_dir).select("document_id", "page", F.col("row_id").alias("token_id"), F.when(_part() % 23 == 0, " ").otherwise("x").alias("text"), box.alias("box"), F.lit(1000.0).alias("page_width"), F.lit(2000.0).alias("page_height"), "part")
    return rules.token_rules(t.unionByName(t.where("part % 29 = 0"))).select("row_id", "code")


_STATES = ["match", "bill_total_missing", "multiple_printed_totals", "mismatch"]


@query(f"""WITH s AS (SELECT o_orderkey AS document_id, {pick_sql(_STATES, 'o_custkey')} AS c FROM orders) SELECT document_id, CASE c WHEN 'bill_total_missing' THEN 'document_total_unavailable' WHEN 'mismatch' THEN 'document_total_mismatch' ELSE 'ambiguous_primary_total' END AS code,
  CASE c WHEN 'bill_total_missing' THEN 'warning' ELSE 'blocking' END AS severity FROM s WHERE c <> 'match'""")
def total_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), pick(_STATES, F.col("o_custkey")).alias("comparison"))
    return rules.total_rules(state).select("document_id", "code", "severity")


@query("""WITH d AS (SELECT o_orderkey AS document_id, o_custkey AS k FROM orders), f AS (SELECT document_id, k, n, CASE WHEN n = 2 AND k % 5 = 0 THEN 'payment' ELSE 'document' END AS scope, CASE WHEN k % 7 = 0 THEN 'c1' ELSE 'c' || n END AS ctx FROM d, range(1, 3) x(n) WHERE n = 1 OR k % 2 = 0),
n AS (SELECT document_id, count(DISTINCT ctx) AS n FROM f WHERE scope = 'document' GROUP BY document_id), c AS (SELECT document_id, k, CASE WHEN k % 11 = 0 THEN 9 ELSE 1 END AS cents, CASE WHEN k % 13 = 0 THEN 'payment' ELSE 'document' END AS scope FROM d WHERE k % 3 <> 0)
SELECT document_id, 'primary_total_not_in_candidates' AS code FROM c WHERE cents = 9 UNION ALL SELECT document_id, 'invalid_primary_total_scope' FROM c WHERE scope <> 'document'
UNION ALL SELECT n.document_id, CASE WHEN n = 1 THEN 'primary_total_missing_for_unique_context' ELSE 'ambiguous_primary_total' END FROM n WHERE document_id NOT IN (SELECT document_id FROM c)
UNION ALL SELECT c.document_id, 'primary_total_requires_unique_context' FROM c JOIN n USING (document_id) WHERE n <> 1 UNION ALL SELECT document_id, 'inconsistent_document_total_context' FROM d WHERE k % 2 = 0 AND k % 5 = 0 AND k % 7 = 0""")
def primary_total_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k, n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("k")), F.col("k"), F.col("n")
    found = d.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where((n == 1) | (k % 2 == 0))
    context = F.when(k % 7 == 0, "c1").otherwise(F.concat(F.lit("c"), n.cast("string")))
    found = found.select("document_id", n.cast("long").alias("cents"), F.lit("Total").alias("label"), F.when((n == 2) & (k % 5 == 0), "payment").otherwise("document").alias("scope"), F.lit("document_final").alias("context_kind"), context.alias("context_id"))
    chosen = d.where("k % 3 <> 0").select("document_id", F.when(k % 11 == 0, 9).otherwise(1).cast("long").alias("cents"), F.lit("Total").alias("label"), F.when(k % 13 == 0, "payment").otherwise("document").alias("scope"), F.lit("c1").alias("context_id"))
    return rules.primary_total_rules(chosen, found).select("document_id", "code")


@query(f"""WITH {LEDGER_SQL}, x AS (SELECT row_id, f, CASE WHEN part % 3 <> 0 THEN f || part END AS p, CASE WHEN part % 5 <> 0 THEN CASE WHEN part % 7 = 0 THEN 'other' ELSE f || part END END AS c FROM ledger, (VALUES ('amount'), ('rate')) v(f))
SELECT row_id, f AS field, CASE WHEN c IS NULL THEN 'printed_value_missing_canonical' WHEN p IS NULL THEN 'canonical_value_missing_printed' ELSE 'mapped_cell_value_mismatch' END AS code FROM x WHERE p IS DISTINCT FROM c""")
def linked_value_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field at a time, so that an issue's field shows."""
    r = ledger(spark, sf_dir)
    value = lambda f: F.concat(F.lit(f), _part().cast("string"))

    def of(f: str) -> DataFrame:
        cells = r.where("part % 3 <> 0").select("document_id", "page", "table_id", "row_id", F.lit(f).alias("field"), value(f).alias("value"))
        values = r.where("part % 5 <> 0").select("document_id", "row_id", F.lit(f).alias("field"), F.when(_part() % 7 == 0, "other").otherwise(value(f)).alias("value"))
        return rules.linked_value_rules(cells, values).select("row_id", F.lit(f).alias("field"), "code")

    return of("amount").unionByName(of("rate"))


@query("""WITH u AS (SELECT o_orderkey AS document_id, o_custkey AS k FROM orders) SELECT document_id, 'provider_usage_aggregate_mismatch' AS code FROM u WHERE k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 UNION ALL SELECT document_id, 'provider_usage_contract_invalid' FROM u WHERE k % 3 = 0
UNION ALL SELECT document_id, 'recovery_hosted_model_invoked' FROM u WHERE k % 13 = 0""")
def usage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    first = F.when(k % 3 == 0, -1).otherwise(2)
    u = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), first.alias("initial_calls"), F.lit(3).alias("recovery_calls"), (first + 3 + F.when(k % 5 == 0, 1).otherwise(0)).alias("total_calls"), F.lit(0.25).alias("initial_cost"),
        F.when(k % 7 != 0, 0.5).alias("recovery_cost"), F.when(k % 11 == 0, 0.8).otherwise(0.75).alias("total_cost"), F.when(k % 13 == 0, 1).alias("hosted_recovery_calls"),
    )
    return rules.usage_rules(u).select("document_id", "code")


@query(f"""WITH {LEDGER_SQL}, p AS (SELECT document_id, row_id AS l, CASE WHEN part % 3 = 0 THEN 'gone-' || row_id WHEN part % 5 = 0 THEN row_id ELSE min(row_id) OVER (PARTITION BY document_id) END AS r, row_id AS f FROM ledger WHERE part % 2 = 0)
SELECT DISTINCT document_id, 'receipt_duplicate_pair_invalid' AS code, row_id FROM (SELECT document_id, r AS row_id FROM p WHERE r NOT IN (SELECT row_id FROM ledger) UNION ALL SELECT document_id, l FROM p WHERE l = r) UNION ALL SELECT DISTINCT document_id, 'possible_duplicate_supporting_charge', f FROM p""")
def receipt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    other = F.when(_part() % 3 == 0, F.concat(F.lit("gone-"), "row_id")).when(_part() % 5 == 0, F.col("row_id")).otherwise(F.col("first"))
    pairs = r.where("part % 2 = 0").withColumn("first", F.min("row_id").over(Window.partitionBy("document_id"))).select("document_id", F.col("row_id").alias("left_id"), other.alias("right_id"), F.col("row_id").alias("flagged"))
    return rules.receipt_rules(pairs, r).select("document_id", "code", "row_id")
