"""The library's queries over the star-schema tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvata.functions import dates, fields, money, text
from corvata.operators import classify, graph, layout, matching, review, totals
from corvata.operators import ledger as L
from corvata.plans import corpus, metrics, profiles, rules
from corvata.sources import otsl
from corvata.sources.testtables import LEDGER_SQL, PREDICTED_SQL, TOTALS_SQL, ledger, predicted, printed_totals, table
from corvata.sources.testtables import money as decimal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLAIN_SQL = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {LEDGER_SQL}, {TOTALS_SQL},
s AS (SELECT document_id, sum(cents) AS items, bool_or(role <> 'category_rollup') AS fine, list(cents) FILTER (role = 'category_rollup') AS rollups FROM ledger WHERE role IN ('detail', 'refund', 'category_rollup') GROUP BY document_id),
t AS (SELECT document_id, count(DISTINCT total_cents) AS n, min(total_cents) AS bill FROM printed GROUP BY document_id),
b AS (SELECT coalesce(s.document_id, t.document_id) AS document_id, CASE WHEN NOT fine AND list_contains(rollups, bill) THEN bill ELSE coalesce(items, 0) END AS items, bill, n FROM s FULL JOIN t ON s.document_id = t.document_id)
SELECT document_id, CAST(items AS DOUBLE) / 100 AS items_total, CAST(bill AS DOUBLE) / 100 AS bill_total,
  CASE WHEN bill IS NULL THEN 'bill_total_missing' WHEN n > 1 THEN 'multiple_printed_totals' WHEN abs(items - bill) <= 1 THEN 'match' ELSE 'mismatch' END AS comparison FROM b""")
def ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("document_id", "role", "cents")
    state = L.reconcile(rows, printed_totals(spark, sf_dir, rows))
    return state.select("document_id", (F.col("items_cents") / 100).alias("items_total"), (F.col("bill_cents") / 100).alias("bill_total"), "comparison")


@query(f"""WITH {LEDGER_SQL}, k AS (SELECT *, {PLAIN_SQL.format('description')} AS key FROM ledger),
kept AS (SELECT * FROM k r WHERE role <> 'category_rollup' OR (cents <> 0
  AND NOT EXISTS (SELECT 1 FROM k d WHERE d.document_id = r.document_id AND d.role IN ('detail', 'refund') AND d.section = r.section)
  AND NOT EXISTS (SELECT 1 FROM k d WHERE d.document_id = r.document_id AND d.role IN ('detail', 'refund') AND d.key = r.key AND d.cents IS NOT DISTINCT FROM r.cents)))
SELECT document_id, row_id, role, CAST(row_number() OVER (PARTITION BY document_id ORDER BY row_order, row_id) - 1 AS INTEGER) AS row_order FROM kept""")
def charge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.charge_policy(ledger(spark, sf_dir)).select("document_id", "row_id", "role", "row_order")


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL} SELECT document_id, row_id, copy, CAST(row_number() OVER (PARTITION BY document_id, page, table_id, row_order ORDER BY copy, row_id) - 1 AS INTEGER) AS occurrence FROM predicted""")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.occurrence(predicted(ledger(spark, sf_dir)), ["document_id", "page", "table_id", "row_order"], ["copy", "row_id"])
    return rows.select("document_id", "row_id", "copy", "occurrence")


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL}
SELECT document_id, page, section, row_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page, section ORDER BY (CASE WHEN role = 'metadata' THEN 1 ELSE 0 END), quantity DESC, length(description) DESC, row_order, copy) AS r FROM predicted) WHERE r = 1""")
def best_row_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = [(F.col("role") == "metadata").cast("int"), F.desc("quantity"), F.desc(F.length("description"))]
    return L.best_rows(predicted(ledger(spark, sf_dir)), ["document_id", "page", "section"], better, ["row_order", "copy"]).select("document_id", "page", "section", "row_id", "copy")


def _fields(rows: DataFrame) -> DataFrame:
    """(document_id, page, table_id, row_order, occurrence, field, value) of the comparable fields."""
    rows = L.occurrence(rows, ["document_id", "page", "table_id", "row_order"], ["copy", "row_id"])
    values = F.array(
        F.struct(F.lit("description").alias("field"), text.plain(F.col("description")).alias("value")), F.struct(F.lit("net_amount").alias("field"), F.col("cents").cast("string").alias("value")),
        F.struct(F.lit("request_no").alias("field"), text.code_key(F.when(F.col("part") % 5 != 0, F.col("row_id"))).alias("value")), F.struct(F.lit("section").alias("field"), text.plain(F.col("section")).alias("value")),
    )
    return rows.select("document_id", "page", "table_id", "row_order", "occurrence", F.explode(values).alias("v")).select("document_id", "page", "table_id", "row_order", "occurrence", "v.field", "v.value")


_FIELDS_SQL = f"""{{name}}_f AS (SELECT document_id, page, table_id, row_order, occurrence, unnest(['description', 'net_amount', 'request_no', 'section']) AS field,
  unnest([{PLAIN_SQL.format('description')}, CAST(cents AS VARCHAR), CASE WHEN part % 5 <> 0 THEN regexp_replace(lower(row_id), '[^a-z0-9]+', '', 'g') END, {PLAIN_SQL.format('section')}]) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page, table_id, row_order ORDER BY copy, row_id) - 1 AS occurrence FROM {{source}}))"""


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL}, {_FIELDS_SQL.format(name='g', source='(SELECT *, 0 AS copy FROM ledger)')}, {_FIELDS_SQL.format(name='p', source='predicted')},
j AS (SELECT coalesce(g.field, p.field) AS field, g.value AS g, p.value AS p FROM g_f g FULL JOIN p_f p ON g.document_id = p.document_id AND g.page = p.page AND g.table_id = p.table_id AND g.row_order = p.row_order AND g.occurrence = p.occurrence AND g.field = p.field),
c AS (SELECT field, count(g) AS gold, count(p) AS predicted, count(*) FILTER (g IS NOT NULL OR p IS NOT NULL) AS compared, count(*) FILTER (g = p) AS correct FROM j GROUP BY field)
SELECT field, gold, predicted, compared, correct, correct / predicted AS precision, correct / gold AS recall, correct / compared AS accuracy, compared > 0 AS observed, least(correct / predicted, correct / gold, correct / compared) > 0.95 AS passed FROM c""")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ledger(spark, sf_dir)
    keys = ["document_id", "page", "table_id", "row_order", "occurrence"]
    return metrics.field_metrics(_fields(gold.withColumn("copy", F.lit(0))), _fields(predicted(gold)), keys, [])


def _exact_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold = ledger(spark, sf_dir).withColumn("copy", F.lit(0))
    actual = predicted(gold.drop("copy"))
    key = ["document_id", "page", "row_id"]
    same = gold.select(*key, "cents", "description").join(actual.where("copy = 0").select(*key, F.col("cents").alias("c"), F.col("description").alias("d")), key).where("cents = c and description = d")
    return gold, actual, same


_EXACT_SQL = f"{LEDGER_SQL}, {PREDICTED_SQL}, m AS (SELECT g.document_id, g.row_id FROM ledger g JOIN predicted p ON g.row_id = p.row_id AND g.document_id = p.document_id AND p.copy = 0 AND g.cents = p.cents AND g.description = p.description)"


@query(f"""WITH {_EXACT_SQL}, d AS (SELECT o_orderkey AS document_id, c_mktsegment AS cohort, (SELECT count(*) FROM ledger g WHERE g.document_id = o_orderkey) AS gold, (SELECT count(*) FROM predicted p WHERE p.document_id = o_orderkey) AS predicted, (SELECT count(*) FROM m WHERE m.document_id = o_orderkey) AS matched FROM orders JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM ledger g WHERE g.document_id = o_orderkey)),
s AS (SELECT cohort, count(*) AS documents, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(matched) AS BIGINT) AS matched, CAST(grouping(cohort) AS INTEGER) AS is_total FROM d GROUP BY GROUPING SETS ((cohort), ()))
SELECT cohort, documents, gold, predicted, matched, is_total, matched / predicted AS precision, matched / gold AS recall, 2 * (matched / predicted) * (matched / gold) / (matched / predicted + matched / gold) AS f1 FROM s""")
def cohort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, actual, same = _exact_matches(spark, sf_dir)
    counts = metrics.document_counts(gold, actual, same)
    cohort = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cohort")), "o_custkey")
    return metrics.with_ratios(metrics.cohorts(counts.join(cohort, "document_id"), "cohort", ["gold", "predicted", "matched"]))


@query(f"WITH {_EXACT_SQL} SELECT document_id, row_id FROM ledger g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.document_id = g.document_id AND m.row_id = g.row_id)")
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, same = _exact_matches(spark, sf_dir)
    return gold.select("document_id", "row_id").join(same.select("document_id", "row_id"), ["document_id", "row_id"], "left_anti")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of matching: rows of a page in input order, with a request number for some."""
    rows = ledger(spark, sf_dir)
    request = F.when(F.col("part") % 3 == 0, F.col("row_id")).alias("request_no")
    cols = ["document_id", "page", "table_id", "row_order", "description", "cents"]
    return rows.select(*cols, request, F.col("row_order").alias("input")), predicted(rows).select(*cols, request, (F.col("row_order") * 2 + F.col("copy")).alias("input"))


@query()
def greedy_match_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy(matching.scored_pairs(*_sides(spark, sf_dir), version=1)).withColumn("score", F.round("score", 9))


@query()
def greedy_match_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy(matching.scored_pairs(*_sides(spark, sf_dir), version=2)).withColumn("score", F.round("score", 9))


@query()
def monotone_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.monotone(*_sides(spark, sf_dir)).withColumn("text", F.round("text", 9))


@query()
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, actual = _sides(spark, sf_dir)
    both = [metrics.with_ratios(metrics.document_counts(gold, actual, matching.greedy(matching.scored_pairs(gold, actual, v))).agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "matched")])).select(*[F.col(c).alias(f"{c}_{v}") for c in ("precision", "recall", "f1")]) for v in (1, 2)]
    below = lambda x: x.where("cents < 0")
    negative = metrics.with_ratios(metrics.document_counts(below(gold), below(actual), matching.greedy(matching.scored_pairs(below(gold), below(actual), 1))).agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "matched")])).select(F.col("recall").alias("negative_recall"))
    amounts = matching.monotone(gold, actual).agg(F.coalesce(F.avg(F.col("amount_equal").cast("int")), F.lit(0.0)).alias("amount_accuracy"))
    one = lambda x: x.withColumn("_k", F.lit(1))
    state = one(both[0]).join(one(both[1]), "_k").join(one(negative), "_k").join(one(amounts), "_k").drop("_k")
    passed = metrics.row_gate(("precision_1", "recall_1", "f1_1"), ("precision_2", "recall_2", "f1_2"), F.col("amount_accuracy"), F.col("negative_recall"), F.lit(0))
    return state.withColumn("passed", passed)


@query()
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, actual, same = _exact_matches(spark, sf_dir)
    return metrics.bootstrap(metrics.document_counts(gold, actual, same), ["matched"])


@query("""WITH g AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS g FROM customer), r AS (SELECT g, row_number() OVER (ORDER BY sha256('seed-1:' || g)) - 1 AS i, count(*) OVER () AS n FROM g),
t AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(CAST(round_even(n * 0.6, 0) AS INTEGER), 1), n - 2) ELSE CAST(round_even(n * 0.6, 0) AS INTEGER) END AS tr FROM r),
h AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(CAST(round_even(n * 0.2, 0) AS INTEGER), 1), n - tr - 1) ELSE CAST(round_even(n * 0.2, 0) AS INTEGER) END AS he FROM t)
SELECT g AS c_nationkey, CASE WHEN i < tr THEN 'train' WHEN i < tr + he THEN 'validation' ELSE 'holdout' END AS split FROM h""")
def grouped_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grouped_splits(table(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", "seed-1")


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS splits FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.leakage(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("profile_key"), "ts", "event_id", (F.col("event_type") == "error").alias("escalated"), (F.col("event_type") == "purchase").alias("disagreed"), (F.col("event_id") % 997 == 0).alias("hard"))


@query("""WITH o AS (SELECT user_id AS profile_key, event_type IN ('error', 'purchase') AS failed, event_id % 997 = 0 AS hard, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS r FROM events),
g AS (SELECT profile_key, count(*) AS n, bool_or(hard AND r < 20) AS hard, count(*) FILTER (failed AND r < 20) AS nw, count(*) FILTER (failed AND r BETWEEN 20 AND 39) AS od FROM o GROUP BY profile_key),
b AS (SELECT *, CAST(nw / 20 >= 0.25 AS INTEGER) + CAST(od / 20 >= 0.25 AS INTEGER) AS br FROM g)
SELECT profile_key, hard OR (n >= 40 AND br = 2) AS drifted, hard AS immediate, CAST(CASE WHEN hard THEN 1 WHEN n >= 40 THEN br ELSE 0 END AS INTEGER) AS breached, CASE WHEN hard THEN 'hard_incompatibility' WHEN n < 40 THEN 'insufficient_window' WHEN br = 2 THEN 'two_consecutive_drift_windows' END AS reason FROM b""")
def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.drift(_observations(spark, sf_dir), ["profile_key"], ["ts", "event_id"])


@query("""WITH o AS (SELECT l_suppkey AS profile_key, l_orderkey AS document_id, CASE WHEN l_linenumber % 3 = 0 THEN 'amount' WHEN l_linenumber % 3 = 1 THEN 'description' ELSE 'quantity' END AS role, l_discount + l_linenumber * 0.1 AS centre FROM lineitem),
a AS (SELECT profile_key, count(DISTINCT document_id % 4) AS n FROM o GROUP BY profile_key), m AS (SELECT profile_key, role, count(DISTINCT document_id % 4) AS k, median(centre) AS centre FROM o GROUP BY profile_key, role),
l AS (SELECT m.profile_key, m.role, m.centre FROM m JOIN a ON m.profile_key = a.profile_key AND m.k = a.n)
SELECT l.profile_key, l.role, round(l.centre, 9) AS centre, round(least(0.2, greatest(0.02, CASE WHEN l.role = 'amount' THEN 0.04 ELSE 0.06 END, max(abs(o.centre - l.centre)) * 2 + 0.01)), 9) AS tolerance FROM l JOIN o ON o.profile_key = l.profile_key AND o.role = l.role GROUP BY l.profile_key, l.role, l.centre""")
def profile_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") % 3 == 0, "amount").when(F.col("l_linenumber") % 3 == 1, "description").otherwise("quantity")
    seen = i.select(F.col("l_suppkey").alias("profile_key"), (F.col("l_orderkey") % 4).alias("document_id"), role.alias("role"), (F.col("l_discount") + F.col("l_linenumber") * 0.1).alias("centre"))
    return profiles.column_lanes(seen, "profile_key").select("profile_key", "role", F.round("centre", 9).alias("centre"), F.round("tolerance", 9).alias("tolerance"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice AS score, round(o_totalprice - coalesce(second, 0), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS second FROM orders) WHERE r = 1""")
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("o_totalprice").over(w)).where("r = 1")
    return x.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"), F.round(F.col("o_totalprice") - F.coalesce("second", F.lit(0.0)), 6).alias("margin"))


def _boxes(rows: DataFrame) -> DataFrame:
    """Ledger rows as boxes on their pages: 40 high, as far down as their cents say."""
    top = (F.abs("cents") % 2000).cast("double")
    left = (F.col("part") % 700).cast("double")
    return rows.select("document_id", "page", F.col("row_id").alias("thing_id"), "role", "table_id", F.struct(left.alias("l"), top.alias("t"), (left + 120).alias("r"), (top + 40).alias("b")).alias("box"))


_BOX_SQL = f"{LEDGER_SQL}, box AS (SELECT document_id, page, row_id AS thing_id, role, table_id, CAST(part % 700 AS DOUBLE) AS l, CAST(abs(cents) % 2000 AS DOUBLE) AS t FROM ledger)"


@query(f"""WITH {_BOX_SQL}, g AS (SELECT *, CASE WHEN t - lag(t + 40) OVER w > 160 THEN 1 ELSE 0 END AS new FROM box WINDOW w AS (PARTITION BY document_id, page, role ORDER BY t, thing_id))
SELECT document_id, page, thing_id, CAST(sum(new) OVER (PARTITION BY document_id, page, role ORDER BY t, thing_id ROWS UNBOUNDED PRECEDING) + 1 AS INTEGER) AS ordinal FROM g""")
def context_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.context_ordinals(_boxes(ledger(spark, sf_dir)), ["document_id", "page", "role"]).select("document_id", "page", "thing_id", "ordinal")


@query(f"""WITH {_BOX_SQL}, reg AS (SELECT s AS region_order, 'region-' || s AS region_id, (s - 1) * 350.0 AS l, (s - 1) * 350.0 + 400 AS r FROM range(1, 4) x(s)),
h AS (SELECT b.document_id, b.page, b.thing_id, region_id, row_number() OVER (PARTITION BY b.document_id, b.page, b.thing_id ORDER BY region_order) AS n FROM box b LEFT JOIN reg ON b.l + 60 BETWEEN reg.l AND reg.r AND b.t + 20 BETWEEN 0 AND 1500)
SELECT document_id, page, thing_id, region_id FROM h WHERE n = 1""")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(ledger(spark, sf_dir))
    n = F.explode(F.sequence(F.lit(1), F.lit(3)))
    regions = boxes.select("document_id", "page").distinct().select("document_id", "page", n.alias("region_order"))
    left = (F.col("region_order") - 1) * 350.0
    regions = regions.select("document_id", "page", "region_order", F.concat(F.lit("region-"), F.col("region_order").cast("string")).alias("region_id"), F.struct(left.alias("l"), F.lit(0.0).alias("t"), (left + 400.0).alias("r"), F.lit(1500.0).alias("b")).alias("box"))
    return layout.in_regions(boxes, regions).select("document_id", "page", "thing_id", "region_id")


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, page, table_id, min(quantity % 2) AS o, avg(quantity) / 50 AS lane, min(part) AS k FROM ledger GROUP BY document_id, page, table_id),
s AS (SELECT document_id, page AS source_page, table_id AS schema_id, o, lane, (k % 100) / 100.0 AS confidence FROM t WHERE k % 2 = 0), w AS (SELECT * FROM t WHERE k % 2 = 1),
j AS (SELECT w.document_id, w.page, w.table_id, s.schema_id, s.source_page, row_number() OVER (PARTITION BY w.document_id, w.page, w.table_id ORDER BY s.source_page DESC, s.confidence DESC, s.schema_id) AS n FROM w JOIN s ON w.document_id = s.document_id AND w.o = s.o AND w.page - s.source_page BETWEEN 0 AND 2 AND abs(w.lane - s.lane) <= 0.05)
SELECT w.document_id, w.page, w.table_id, j.schema_id, j.source_page FROM w LEFT JOIN j ON j.document_id = w.document_id AND j.page = w.page AND j.table_id = w.table_id AND j.n = 1""")
def schema_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir).groupBy("document_id", "page", "table_id").agg(F.min(F.col("quantity") % 2).alias("orientation"), (F.avg("quantity") / 50).alias("lane"), F.min("part").alias("k"))
    schemas = t.where("k % 2 = 0").select("document_id", F.col("page").alias("source_page"), F.col("table_id").alias("schema_id"), "orientation", F.col("lane").alias("amount_centre"), (F.col("k") % 100 / 100).alias("confidence"))
    return layout.inherited_schema(t.where("k % 2 = 1"), schemas).select("document_id", "page", "table_id", "schema_id", "source_page")


@query(f"""WITH {LEDGER_SQL} SELECT document_id, row_id, last_value(CASE WHEN part % 4 = 0 THEN section END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY row_order ROWS UNBOUNDED PRECEDING) AS heading FROM ledger""")
def carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("printed", F.when(F.col("part") % 4 == 0, F.col("section")))
    return layout.carried(rows, ["document_id"], ["row_order"], "printed", "heading").select("document_id", "row_id", "heading")


def _label_sql(column: str) -> str:
    t = PLAIN_SQL.format(column)
    bar = " OR ".join([f"contains({t}, '{x}')" for x in totals.EXCLUDED] + [f"starts_with({t}, '{x}')" for x in totals.NOT_TOTALS])
    case = " ".join(f"WHEN contains({t}, '{s[0]}') THEN {i}" for i, s in enumerate(totals.LABELS))
    return f"CASE WHEN {bar} THEN NULL ELSE CASE {case} END END"


_SPECS_SQL = "specs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s[1]}', {s[2]}, '{s[4]}')" for i, s in enumerate(totals.LABELS)) + ") x(i, label, priority, scope))"


@query(f"""WITH {LEDGER_SQL}, {TOTALS_SQL}, {_SPECS_SQL}, l AS (SELECT document_id, total_cents AS cents, {_label_sql("label || ' INR'")} AS i FROM printed),
f AS (SELECT l.document_id, s.label, s.priority, l.cents, row_number() OVER (PARTITION BY l.document_id ORDER BY s.priority DESC, abs(l.cents) DESC) AS n FROM l JOIN specs s ON l.i = s.i WHERE s.scope = 'document') SELECT document_id, label, cents, CAST(1 AS INTEGER) AS page FROM f WHERE n = 1""")
def primary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("document_id", "role", "cents")
    printed = printed_totals(spark, sf_dir, rows)
    line = Window.partitionBy("document_id").orderBy("label")
    lines = printed.select("document_id", F.lit(1).alias("page"), F.row_number().over(line).alias("line"), F.concat("label", F.lit(" INR")).alias("text"), F.col("total_cents").alias("cents"), F.lit(0.9).alias("confidence"), F.lit(10.0).alias("top"))
    found = totals.candidates(lines)
    found = found.withColumn("context_kind", totals.context_kind(F.lit("item_ledger"), F.col("local_text"), F.col("scope"))).withColumn("context_id", F.concat_ws(":", "page", "context_kind"))
    return totals.primary(totals.distinct_totals(found))


@query(f"""WITH {LEDGER_SQL}, r AS (SELECT row_id AS id, document_id, page, part % 50 AS issuer, CASE WHEN part % 7 = 0 THEN CAST(part % 70 AS VARCHAR) ELSE '' END AS reference, cents, service_date, {PLAIN_SQL.format('description')} AS d, quantity % 3 = 0 AS rec FROM ledger),
p AS (SELECT a.document_id, least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, CASE WHEN b.rec AND (b.page < a.page OR (b.page = a.page AND b.id < a.id)) THEN b.id ELSE a.id END AS flagged, CASE WHEN a.reference = b.reference AND a.reference <> '' THEN 0 ELSE 1 END AS k FROM r a JOIN r b ON a.document_id = b.document_id AND a.issuer = b.issuer AND a.id <> b.id
  WHERE a.rec AND ((a.reference = b.reference AND a.reference <> '') OR (a.cents = b.cents AND a.service_date = b.service_date AND a.d = b.d AND abs(a.page - b.page) <= 1)))
SELECT document_id, left_id, right_id, min(flagged) AS flagged, CASE WHEN min(k) = 0 THEN 'exact_reference' ELSE 'dated_grounded_charge' END AS basis FROM p GROUP BY document_id, left_id, right_id""")
def receipt_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir).select("document_id", "row_id", "page", "cents", "service_date", "description", (F.col("quantity") % 3 == 0).alias("is_receipt"), (F.col("part") % 50).cast("string").alias("issuer"), F.when(F.col("part") % 7 == 0, (F.col("part") % 70).cast("string")).otherwise("").alias("reference"))
    return L.receipt_duplicates(r)


@query(f"""WITH {LEDGER_SQL}, m AS (SELECT *, row_number() OVER (ORDER BY document_id, page, row_order, row_id) - 1 AS i, count(*) OVER () AS total FROM ledger WHERE contains(lower(description), 'brand#1') OR contains(lower(section), 'tin'))
SELECT document_id, row_id, total, CAST(40 AS BIGINT) AS "offset", 60 < total AS has_more FROM m WHERE i >= 40 AND i < 60""")
def ledger_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = ledger(spark, sf_dir).where(review.matches("Brand#1", F.col("description")) | review.matches("TIN", F.col("section")))
    total = hit.count()
    order = [F.col(c) for c in ("document_id", "page", "row_order", "row_id")]
    page = hit.orderBy(*order).offset(40).limit(20)
    return page.select("document_id", "row_id", F.lit(total).cast("long").alias("total"), F.lit(40).cast("long").alias("offset"), F.lit(60 < total).alias("has_more"))


@query(f"""WITH {LEDGER_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, row_order, row_id) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS total FROM ledger),
b AS (SELECT *, max(CASE WHEN row_order = document_id % 5 THEN i // 3 * 3 END) OVER (PARTITION BY document_id) AS o FROM a) SELECT document_id, row_id, total, CAST(o AS BIGINT) AS "offset", o + 3 < total AS has_more FROM b WHERE i >= o AND i < o + 3""")
def anchor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    got = review.page_of(rows, ["document_id"], [F.col("page"), F.col("row_order"), F.col("row_id")], 3, anchor=F.col("row_order") == F.col("document_id") % 5)
    return got.select("document_id", "row_id", "total", "offset", "has_more")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under review: some texts corrected, some rows rejected or accepted, some added."""
    rows = ledger(spark, sf_dir).select("document_id", "page", "row_order", "row_id", "role", "part", "description", F.col("cents"), F.when(F.col("part") % 3 == 0, "accepted").otherwise("pending").alias("disposition"))
    fix = rows.where("part % 11 = 0").select("document_id", "row_id", F.create_map(F.lit("description"), F.concat(F.lit("=corrected "), F.col("description"))).alias("changes"))
    drop = rows.where("part % 13 = 0 and part % 11 <> 0").select("document_id", "row_id", F.create_map(F.lit("disposition"), F.lit("rejected")).alias("changes"))
    more = rows.where("part % 97 = 0").select("document_id", "page", (F.col("row_order") + 1000).alias("row_order"), F.concat(F.lit("added-"), F.col("row_id")).alias("row_id"), F.lit("detail").alias("role"), "part", F.lit("added by hand").alias("description"), F.lit(100).cast("long").alias("cents"), F.lit("accepted").alias("disposition"))
    return review.overlay(rows, fix.unionByName(drop), more, ["description", "cents", "disposition"])


_REVIEW_SQL = f"""{LEDGER_SQL}, reviewed AS (SELECT document_id, page, row_order, row_id, role, part, CASE WHEN part % 11 = 0 THEN '=corrected ' || description ELSE description END AS description, cents,
  CASE WHEN part % 13 = 0 AND part % 11 <> 0 THEN 'rejected' WHEN part % 3 = 0 THEN 'accepted' ELSE 'pending' END AS disposition, 'machine' AS source, part % 11 = 0 OR part % 13 = 0 AS modified FROM ledger
  UNION ALL SELECT document_id, page, row_order + 1000, 'added-' || row_id, 'detail', part, 'added by hand', 100, 'accepted', 'reviewer', true FROM ledger WHERE part % 97 = 0)"""


@query(f"WITH {_REVIEW_SQL} SELECT document_id, page, row_order, row_id, description, cents, disposition, source, modified FROM reviewed")
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("document_id", "page", "row_order", "row_id", "description", "cents", "disposition", "source", "modified")


@query(f"WITH {_REVIEW_SQL} SELECT document_id, count(*) AS total, count(*) FILTER (disposition <> 'rejected') AS active, count(*) FILTER (modified) AS modified, count(*) FILTER (disposition = 'pending') AS pending FROM reviewed GROUP BY document_id")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(_reviewed(spark, sf_dir))


@query(f"""WITH {_REVIEW_SQL}, a AS (SELECT document_id, bool_or(role IN ('detail', 'refund', 'category_rollup')) AS it, bool_or(disposition <> 'accepted') AS pe, bool_or(role IN ('detail', 'refund', 'category_rollup') AND part % 23 = 0) AS ev FROM reviewed WHERE disposition <> 'rejected' GROUP BY document_id),
d AS (SELECT DISTINCT document_id FROM reviewed) SELECT document_id, array_to_string(list_filter([CASE WHEN ev THEN 'missing_field_evidence' END, CASE WHEN NOT coalesce(it, false) THEN 'no_active_rows' END, CASE WHEN pe THEN 'pending_rows' END], lambda x: x IS NOT NULL), ',') AS blockers FROM d LEFT JOIN a USING (document_id)""")
def approval_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("part") % 23 == 0, F.array(F.lit("description"))).otherwise(F.array(F.lit("description"), F.lit("amount")))
    return review.blockers(_reviewed(spark, sf_dir).withColumn("evidence", evidence))


@query(f"WITH {_REVIEW_SQL} SELECT document_id, row_id, CASE WHEN regexp_matches(ltrim(description), '^[=+\\-@]') THEN '''' || description ELSE description END AS description, cents FROM reviewed WHERE disposition = 'accepted'")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.export_rows(_reviewed(spark, sf_dir), ["description"], ["cents"])


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT document_id, CASE WHEN part % 6 = 0 THEN 'unlinked' WHEN part % 7 = 0 THEN 'invalid' WHEN part % 5 = 0 THEN 'fillable' WHEN part % 2 = 0 THEN 'unchanged' ELSE 'conflicting' END AS k FROM ledger)
SELECT document_id, count(*) FILTER (k = 'unlinked') AS unlinked, count(*) FILTER (k = 'invalid') AS invalid, count(*) FILTER (k = 'fillable') AS fillable, count(*) FILTER (k = 'unchanged') AS unchanged, count(*) FILTER (k = 'conflicting') AS conflicting FROM c GROUP BY document_id""")
def alias_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    cells = rows.select("document_id", F.concat(F.lit("c-"), "row_id").alias("cell_id"), F.when(F.col("part") % 6 != 0, F.col("row_id")).alias("row_id"), F.when(F.col("part") % 7 != 0, F.col("quantity").cast("string")).alias("parsed"))
    current = F.when(F.col("part") % 5 == 0, F.lit(None)).when(F.col("part") % 2 == 0, F.col("quantity").cast("string")).otherwise("other")
    return review.classification_counts(review.alias_preview(cells, rows.select("document_id", "row_id", current.alias("current"))))


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT document_id, page, row_id, CASE WHEN part % 2 = 0 THEN row_id END AS token, cents, quantity, section FROM ledger), p AS (SELECT a.document_id, a.row_id AS old_id, 'n-' || b.row_id AS new_id, CASE WHEN a.token = b.token THEN 2 WHEN a.cents = b.cents AND (a.section = b.section OR a.quantity = b.quantity) THEN 1 ELSE 0 END AS tier, CAST(a.token IS NOT DISTINCT FROM b.token AND a.token IS NOT NULL AS INTEGER) AS shared, CAST(a.section = b.section AS INTEGER) AS same FROM o a JOIN o b ON a.document_id = b.document_id AND a.page = b.page),
r AS (SELECT *, rank() OVER (PARTITION BY document_id, old_id ORDER BY tier DESC, shared DESC, same DESC) AS k FROM p WHERE tier > 0) SELECT document_id, old_id, CASE WHEN count(*) = 1 THEN min(new_id) END AS new_id FROM r WHERE k = 1 GROUP BY document_id, old_id""")
def review_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_compact(F.array(F.when(F.col("part") % 2 == 0, F.col("row_id"))))
    old = ledger(spark, sf_dir).select("document_id", "page", "row_id", tokens.alias("tokens"), "cents", "quantity", F.col("section").alias("text"))
    return review.migrated(old, old.withColumn("row_id", F.concat(F.lit("n-"), "row_id")))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, row_order + 1 AS "row", description, quantity, round(abs(cents) / 100.0, 2) AS amount FROM ledger""")
def markup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("document_id", "row_order", "description", F.col("quantity").cast("string").alias("q"), decimal(F.abs("cents")).cast("string").alias("a"))
    written = otsl.markup(rows, ["document_id"], "row_order", [("Service Name", "description"), ("Qty", "q"), ("Total Amount", "a")])
    found = otsl.candidate_rows(otsl.cells(written), ["document_id"])
    return found.select("document_id", "row", "description", F.col("quantity").cast("long").alias("quantity"), F.col("amount").cast("double").alias("amount"))


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, row_id, (['Refund of ', 'Advance Received ', 'Grand Total ', 'Sub Total ', ''])[1 + part % 5] || description AS d FROM ledger), n AS (SELECT document_id, row_id, {PLAIN_SQL.format('d')} AS d FROM t)
SELECT document_id, row_id, CASE WHEN contains(d, 'refund') OR contains(d, 'credit note') OR contains(d, 'return') THEN 'refund' WHEN contains(d, 'advance received') THEN 'payment' WHEN contains(d, 'deposit') THEN 'deposit' WHEN contains(d, 'grand total') THEN 'document_total' WHEN d = 'total' OR starts_with(d, 'sub total') THEN 'section_total' ELSE 'detail' END AS role FROM n""")
def row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Refund of ", "Advance Received ", "Grand Total ", "Sub Total ", "")]), (F.col("part") % 5 + 1).cast("int"))
    d = F.concat(lead, F.col("description"))
    return ledger(spark, sf_dir).select("document_id", "row_id", L.row_role(d, d).alias("role"))


@query(f"""WITH {LEDGER_SQL}, r AS (SELECT *, CASE WHEN part % 15 <> 0 THEN abs(cents) // quantity END AS rate, CASE WHEN part % 4 = 0 THEN 5 ELSE 0 END AS off FROM ledger),
p AS (SELECT *, CASE WHEN rate IS NOT NULL THEN quantity * rate - off ELSE abs(cents) + part % 3 - off END AS proof FROM r), q AS (SELECT *, CASE WHEN role = 'refund' AND cents < 0 AND proof >= 0 THEN abs(cents) ELSE cents END AS seen FROM p)
SELECT document_id, row_id, array_to_string(list_filter([CASE WHEN part % 10 = 0 AND cents > 0 AND role = 'detail' THEN 'positive_amount_in_return_section' END, CASE WHEN part % 9 = 0 THEN 'missing_printed_description' END, CASE WHEN part % 21 = 0 THEN 'quantity_derived_from_rate_amount' END, CASE WHEN rate IS NULL THEN 'missing_labeled_unit_price' END, CASE WHEN part % 8 <> 0 AND abs(proof - seen) > 1 THEN 'line_arithmetic_mismatch' END], lambda x: x IS NOT NULL), ',') AS flags FROM q""")
def row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, no = F.col("part"), F.lit(False)
    rate = F.when(part % 15 != 0, F.expr("abs(cents) div quantity"))
    flags = L.row_flags(F.col("role"), F.col("quantity"), rate, F.abs("cents") + part % 3, F.when(part % 4 == 0, 5), F.col("cents"), F.when(part % 9 != 0, F.col("description")), part % 10 == 0, part % 21 == 0, no, F.lit(True), part % 8 == 0)
    return ledger(spark, sf_dir).select("document_id", "row_id", F.array_join(flags, ",").alias("flags"))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, row_id, CASE WHEN abs(cents) % (1 + part % 40) = 0 AND abs(cents) // (1 + part % 40) <= 100000 AND cents <> 0 THEN abs(cents) // (1 + part % 40) END AS units FROM ledger""")
def quantity_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("document_id", "row_id", L.derived_quantity(F.col("cents"), F.lit(0), 1 + F.col("part") % 40).alias("units"))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, row_id, CASE WHEN part % 6 = 5 THEN NULL WHEN part % 6 IN (1, 2) THEN -abs(cents) / 100.0 ELSE abs(cents) / 100.0 END AS amount FROM ledger""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_number(decimal(F.abs("cents")), 2)
    shown = F.element_at(F.array(F.concat(F.lit("₹ "), n), F.concat(F.lit("("), n, F.lit(")")), F.concat(n, F.lit(" CR")), F.concat(F.lit("Rs. "), F.replace(n, F.lit("0"), F.lit("O"))), F.concat(n, F.lit(" DR.")), F.lit("26/06/2026")), (F.col("part") % 6 + 1).cast("int"))
    return ledger(spark, sf_dir).select("document_id", "row_id", money.parse_decimal(shown).cast("double").alias("amount"))


@query(f"""WITH {LEDGER_SQL} SELECT document_id, row_id, CASE WHEN part % 6 = 5 THEN NULL ELSE service_date END AS service_date FROM ledger""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("service_date")
    f = lambda p: F.date_format(d, p)
    shown = F.element_at(F.array(f("yyyy-MM-dd"), f("dd/MM/yyyy"), F.concat(f("dd.MM.yy"), F.lit(" 10:24:02")), f("d-MMM-yyyy"), F.concat(f("dd MMMM yyyy"), F.lit(", 1:05 pm")), F.concat(f("dd/MM/yyyy"), F.lit(" - "), f("dd/MM/yyyy"))), (F.col("part") % 6 + 1).cast("int"))
    return ledger(spark, sf_dir).select("document_id", "row_id", dates.parse_service_date(shown).alias("service_date"))


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL}, p AS (SELECT g.document_id, g.page, g.row_id AS l, a.row_id || '/' || a.copy AS r, CAST(g.section = a.section AS INTEGER) + CAST(g.quantity = a.quantity AS INTEGER) AS s FROM ledger g JOIN predicted a ON g.document_id = a.document_id AND g.page = a.page AND (g.section = a.section OR g.quantity = a.quantity)),
k AS (SELECT *, rank() OVER (PARTITION BY document_id, page, l ORDER BY s DESC) AS lr, rank() OVER (PARTITION BY document_id, page, r ORDER BY s DESC) AS rr FROM p), n AS (SELECT *, count(*) FILTER (lr = 1) OVER (PARTITION BY document_id, page, l) AS nl, count(*) FILTER (rr = 1) OVER (PARTITION BY document_id, page, r) AS nr FROM k)
SELECT document_id, page, l AS left_id, r AS right_id, CASE WHEN lr = 1 AND rr = 1 AND nl = 1 AND nr = 1 THEN 'linked' ELSE 'ambiguous' END AS state FROM n WHERE (lr = 1 AND rr = 1 AND nl = 1 AND nr = 1) OR (lr = 1 AND nl > 1)""")
def mutual_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ledger(spark, sf_dir).select("document_id", "page", F.col("row_id").alias("left_id"), "section", "quantity")
    a = predicted(ledger(spark, sf_dir)).select("document_id", "page", F.concat_ws("/", "row_id", "copy").alias("right_id"), F.col("section").alias("s2"), F.col("quantity").alias("q2"))
    score = (F.col("section") == F.col("s2")).cast("int") + (F.col("quantity") == F.col("q2")).cast("int")
    pairs = g.join(a, ["document_id", "page"]).withColumn("score", score).where("score > 0").select("document_id", "page", "left_id", "right_id", "score")
    return matching.mutual_best(pairs, ["document_id", "page"], "left_id", "right_id", ["score"]).drop("score")


@query(f"""SELECT n AS name, count(DISTINCT owner) AS owners, min(owner) AS first_owner FROM (SELECT {PLAIN_SQL.format('p_name')} AS n, p_brand AS owner FROM part) WHERE n <> '' GROUP BY n HAVING count(DISTINCT owner) > 1""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.identity_conflicts(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("owner")))


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '(^|[^0-9])[0-9]{8,16}([^0-9]|$)') AS has_id,
CAST(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(patient name|patient|uhid|mrn|ipid|ip no|mobile|phone|address|email|dob|date of birth|aadhaar|aadhar|pan no|policy no|claim no)\b(\s*[:=]\s*)[^,;\n]+', '\1\2[value]', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '(^|[^0-9])(?:\+?91[- ]?)?[6-9][0-9]{9}([^0-9]|$)', '\1[phone]\2', 'g'), '(^|[^0-9])[0-9]{8,16}([^0-9]|$)', '\1[id]\2', 'g')) AS BIGINT) AS n FROM documents""")
def redaction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").rlike(fields.EMAIL).alias("has_email"), F.col("text").rlike(fields.LONG_ID).alias("has_id"), F.length(fields.redact(F.col("text"))).cast("long").alias("n"))


@query("""WITH e AS (SELECT p_partkey AS source, p_brand AS a, p_type AS b FROM part), f AS (SELECT p_partkey AS source, p_brand AS a, CASE WHEN p_partkey % 9 = 0 THEN 'changed' ELSE p_type END AS b FROM part WHERE p_partkey % 8 <> 0 UNION ALL SELECT p_partkey, p_brand, p_type FROM part WHERE p_partkey % 10 = 1),
g AS (SELECT source, count(*) AS n, max(a) AS na, max(b) AS nb FROM f GROUP BY source)
SELECT e.source, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN a <> na OR b <> nb THEN 'changed' ELSE 'same' END AS state, CASE WHEN n = 1 AND a = na AND b <> nb THEN 'b' ELSE '' END AS changed FROM e LEFT JOIN g USING (source)""")
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    found = p.where("source % 8 <> 0").withColumn("b", F.when(F.col("source") % 9 == 0, "changed").otherwise(F.col("b"))).unionByName(p.where("source % 10 = 1"))
    return corpus.compare_manifest(p, found, ["a", "b"])


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    evidence = F.array_compact(F.array(F.when(F.col("part") % 6 != 0, F.lit("description")), F.when(F.col("part") % 7 != 0, F.lit("amount"))))
    x = rows.withColumn("evidence", evidence).withColumn("role", F.when(F.col("role") == "metadata", "informational").otherwise(F.col("role"))).withColumn("table_id", F.when(F.col("part") % 31 != 0, F.col("table_id")))
    x = x.withColumn("rate_cents", F.lit(0).cast("long")).withColumn("discount_cents", F.lit(0).cast("long")).withColumn("derived", F.lit(False))
    return rules.row_rules(x).unionByName(rules.duplicate_ids(x))


_ISSUES_SQL = f"""{LEDGER_SQL}, x AS (SELECT document_id, page, CASE WHEN part % 31 <> 0 THEN table_id END AS table_id, row_id, CASE WHEN role = 'metadata' THEN 'informational' ELSE role END AS role, part % 6 <> 0 AS d, part % 7 <> 0 AS a FROM ledger),
issues AS (SELECT document_id, 'canonical_row_anchor_missing' AS code, 'fatal' AS severity, page, table_id, row_id FROM x WHERE table_id IS NULL
 UNION ALL SELECT document_id, 'ungrounded_description', 'blocking', page, table_id, row_id FROM x WHERE NOT d
 UNION ALL SELECT document_id, 'ungrounded_billable_amount', 'blocking', page, table_id, row_id FROM x WHERE NOT a AND role IN ('detail', 'refund', 'category_rollup')
 UNION ALL SELECT document_id, unnest(['informational_row_has_money', 'informational_row_missing_typed_evidence']), 'blocking', page, table_id, row_id FROM x WHERE role = 'informational'
 UNION ALL SELECT document_id, 'duplicate_canonical_row_id', 'fatal', min(page), min(table_id), row_id FROM x GROUP BY document_id, row_id HAVING count(*) > 1)"""


@query(f"WITH {_ISSUES_SQL} SELECT code, severity, count(DISTINCT (document_id, page, table_id, row_id)) AS n FROM issues GROUP BY code, severity")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_issues(spark, sf_dir)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ISSUES_SQL}, w AS (SELECT document_id, max(CASE severity WHEN 'fatal' THEN 3 ELSE 2 END) AS k, count(*) AS issues FROM issues GROUP BY document_id) SELECT d.document_id, coalesce(issues, 0) AS issues, CASE k WHEN 3 THEN 'failed' WHEN 2 THEN 'needs_review' ELSE 'passed' END AS status FROM (SELECT DISTINCT document_id FROM ledger) d LEFT JOIN w USING (document_id)")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.status(ledger(spark, sf_dir), _issues(spark, sf_dir))


@query(f"""WITH {_ISSUES_SQL}, o AS (SELECT * FROM issues WHERE severity = 'blocking'), p AS (SELECT DISTINCT document_id, page FROM o WHERE table_id IS NULL)
SELECT document_id, page, CAST(NULL AS VARCHAR) AS table_id FROM p UNION ALL SELECT DISTINCT document_id, page, table_id FROM o WHERE table_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = o.document_id AND p.page = o.page)""")
def recovery_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recovery_targets(_issues(spark, sf_dir))


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL} SELECT g.document_id, g.row_id AS gold_id, p.row_id AS actual_id, p.copy FROM ledger g JOIN predicted p ON g.document_id = p.document_id AND abs(g.cents - p.cents) <= 1""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ledger(spark, sf_dir).select("document_id", F.col("row_id").alias("gold_id"), F.explode(F.array(F.col("cents") - 1, F.col("cents"), F.col("cents") + 1)).alias("cents"))
    return g.join(predicted(ledger(spark, sf_dir)).select("document_id", F.col("row_id").alias("actual_id"), "copy", "cents"), ["document_id", "cents"]).drop("cents")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 7 AS parent FROM part WHERE p_partkey >= 7), c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child) SELECT child, ancestor, CAST(depth AS INTEGER) AS depth FROM c""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(table(spark, sf_dir, "part").where("p_partkey >= 7").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 7").alias("parent")))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 3 AS b FROM supplier WHERE s_suppkey % 10 < 7 AND s_suppkey + 3 <= (SELECT max(s_suppkey) FROM supplier)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a) SELECT node, min(other) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    edges = s.where("node % 10 < 7").select(F.col("node").alias("a"), (F.col("node") + 3).alias("b")).join(s.withColumnRenamed("node", "b"), "b", "left_semi")
    return graph.components(s, edges)


@query(f"""WITH {LEDGER_SQL}, {PREDICTED_SQL}, a AS (SELECT table_id, cents, count(*) AS n FROM ledger GROUP BY ALL), b AS (SELECT table_id, cents, count(*) AS n FROM predicted GROUP BY ALL), j AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.table_id = b.table_id AND a.cents = b.cents)
SELECT table_id, CAST(sum(least(na, nb)) AS BIGINT) AS shared, CAST(sum(na) AS BIGINT) AS left_n, CAST(sum(nb) AS BIGINT) AS right_n, sum(least(na, nb)) / least(sum(na), sum(nb)) AS share FROM j GROUP BY table_id""")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = ledger(spark, sf_dir)
    return corpus.multiset_overlap(gold, predicted(gold), ["table_id"], "cents")


@query("""SELECT o_orderkey, ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR)), 1, 16))::UBIGINT % 100 < 5 AS sampled FROM orders""")
def shadow_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.sampled(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), 5).alias("sampled"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS i, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND contains(lower(c_name), '00001')) SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, total, 75 < total AS has_more FROM s WHERE i > 50 AND i <= 75""")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    hit = o.join(table(spark, sf_dir, "customer").where(review.matches("00001", F.col("c_name"))).select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    total = hit.count()
    page = hit.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25)
    return page.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.lit(total).cast("long").alias("total"), F.lit(75 < total).alias("has_more"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.05) SELECT l_orderkey FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b)""")
def cohort_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return corpus.containment(i.where("l_quantity > 49"), i.where("l_discount > 0.05"), ["l_orderkey"])


@query(f"""WITH {_EXACT_SQL}, c AS (SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM ledger) AS gold, (SELECT count(*) FROM predicted) AS predicted)
SELECT 'critical_precision' AS measure, 0.95 AS least, round(matched / predicted, 12) AS ratio, matched / predicted >= 0.95 AS passed FROM c UNION ALL SELECT 'critical_recall', 0.5, round(matched / gold, 12), matched / gold >= 0.5 FROM c UNION ALL SELECT 'grand_totals', 1.0, 1.0, false""")
def authority_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, actual, same = _exact_matches(spark, sf_dir)
    c = metrics.document_counts(gold, actual, same).agg(*[F.sum(x).alias(x) for x in ("gold", "predicted", "matched")])
    ratios = c.select(F.explode(F.array(F.struct(F.lit("critical_precision").alias("measure"), F.col("matched").alias("numerator"), F.col("predicted").alias("denominator")), F.struct(F.lit("critical_recall").alias("measure"), F.col("matched").alias("numerator"), F.col("gold").alias("denominator")))).alias("r")).select("r.*")
    return metrics.floors(ratios, {"critical_precision": 0.95, "critical_recall": 0.5, "grand_totals": 1.0})


@query()
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir).groupBy("document_id", "page", "table_id").agg(F.array_join(F.array_sort(F.collect_list("description")), " ").alias("text"), F.count(F.lit(1)).alias("rows"), F.min("part").alias("k"))
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Batch Expiry ", "UHID IP No ", "Bill Summary ", "Payment Mode ", "Test Name Pathology ", "")]), (F.col("k") % 6 + 1).cast("int"))
    kind = classify.table_type(F.concat(lead, F.col("text")), F.lit(""), F.col("rows"), F.lit(False), F.lit(False), F.lit(False))
    return t.select("document_id", "page", "table_id", kind.alias("table_type"), classify.page_type(kind).alias("page_type"))


SQL["table_types"] = f"""WITH {LEDGER_SQL}, t AS (SELECT document_id, page, table_id, min(part) % 6 AS k FROM ledger GROUP BY document_id, page, table_id)
SELECT document_id, page, table_id, (['pharmacy', 'metadata', 'category_summary', 'payment', 'laboratory', 'item_ledger'])[1 + k] AS table_type, (['pharmacy', 'metadata', 'summary', 'payment', 'laboratory', 'itemized_bill'])[1 + k] AS page_type FROM t"""
