"""Queries on keeping the printed and the canonical view alike, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.operators import crossview
from corvata.plans.queries import query
from corvata.plans.queries_core import pick, pick_sql
from corvata.sources.testtables import LEDGER_SQL, ledger, table

_QUANTITIES = ["3 days", "4.", "two", "12", " "]
_AMOUNTS = ["1,250.00", "(75.5)", "n/a"]
_DAYS = ["12/03/2024", "EXP 03/27", "2024-02-30"]


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT row_id, part, description, quantity, cents, service_date, {pick_sql(_QUANTITIES, 'part')} AS q, {pick_sql(_AMOUNTS, 'part')} AS a, {pick_sql(_DAYS, 'part')} AS d FROM ledger)
SELECT row_id, CASE WHEN part % 4 <> 0 THEN upper(description) ELSE description END AS description, CASE WHEN d = '12/03/2024' THEN DATE '2024-03-12' ELSE service_date END AS service_date,
  CAST(CASE q WHEN '3 days' THEN 3 WHEN '4.' THEN 4 WHEN '12' THEN 12 ELSE quantity END AS DOUBLE) AS quantity, CASE WHEN q IN ('two', ' ') THEN 'old' ELSE q END AS quantity_raw,
  CASE WHEN part % 9 = 0 THEN 7.0 WHEN a = '1,250.00' THEN 1250.0 WHEN a = '(75.5)' THEN -75.5 ELSE 0.0 END AS net_amount,
  concat_ws(',', CASE WHEN part % 9 = 0 THEN 'amount:last' WHEN a <> 'n/a' THEN 'amount:new' ELSE 'amount:old' END, CASE WHEN part % 4 <> 0 THEN 'description:new' END, CASE WHEN q NOT IN ('two', ' ') THEN 'quantity:new' END, CASE WHEN d = '12/03/2024' THEN 'service_date:new' END) AS evidence FROM c""")
def synchronized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = ledger(spark, sf_dir), F.col("part")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("decimal(18,4)")
    raws = [none.alias(f"{n}_raw") for n in crossview.NUMBERS if n != "quantity"]
    numbers = [zero.alias(n) for n in crossview.NUMBERS if n != "quantity"]
    rows = r.select(
        "document_id", "row_id", "description", none.alias("service_date_raw"), "service_date", none.alias("request_no"), F.col("quantity").cast("decimal(18,4)").alias("quantity"), F.lit("old").alias("quantity_raw"), *numbers, *raws,
        F.create_map(F.lit("amount"), F.array(F.lit("old"))).alias("evidence"),
    )
    cell = lambda n, field, raw, mark="new": F.struct(F.lit(n).alias("n"), F.lit(field).alias("field"), F.lit("Col").alias("label"), raw.alias("raw"), F.array(F.lit(mark)).alias("evidence"))
    cells = F.array(
        cell(1, "description", F.when(p % 4 != 0, F.upper("description"))), cell(2, "quantity", pick(_QUANTITIES, p)), cell(3, "net_amount", pick(_AMOUNTS, p)), cell(4, "service_date_raw", pick(_DAYS, p)),
        cell(5, "net_amount", F.when(p % 9 == 0, "7.00"), "last"), cell(6, "other", F.lit("x")), cell(7, "discount", F.lit("not a number")),
    )
    done = crossview.synchronized(rows, r.select("document_id", "row_id", F.inline(cells)))
    shown = F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat_ws(":", e["key"], e["value"][0])))
    return done.select("row_id", "description", "service_date", F.col("quantity").cast("double").alias("quantity"), "quantity_raw", F.col("net_amount").cast("double").alias("net_amount"), F.array_join(shown, ",").alias("evidence"))


@query(f"""WITH {LEDGER_SQL}, x AS (SELECT row_id, part, quantity, part % 2 = 0 AND part % 3 <> 0 AND part % 5 <> 0 AND (part % 7 <> 0 OR discount_percent IS NULL OR part % 11 = 0) AS whole FROM ledger)
SELECT row_id, CASE WHEN whole THEN concat_ws(',', 'net_amount:a', CASE WHEN part % 11 <> 0 THEN 'discount:d' END, 'unit_price:r') END AS operands, CASE WHEN whole THEN quantity END AS result, CASE WHEN NOT whole THEN 'q' END AS quantity_raw,
  concat_ws(',', CASE WHEN part % 5 <> 0 THEN 'amount' END, CASE WHEN part % 7 <> 0 THEN 'discount' END, CASE WHEN NOT whole THEN 'quantity' END, 'rate') AS evidence FROM x""")
def derived_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    entry = lambda k, token, when: F.when(when, F.struct(F.lit(k).alias("k"), F.array(F.lit(token)).alias("v")))
    held = F.map_from_entries(F.array_compact(F.array(entry("amount", "a", p % 5 != 0), entry("discount", "d", p % 7 != 0), entry("rate", "r", F.lit(True)), entry("quantity", "q", F.lit(True)))))
    r = ledger(spark, sf_dir).select(
        "row_id", F.when(p % 2 == 0, F.array(F.lit("seen"), F.lit(crossview.DERIVED))).otherwise(F.array(F.lit("seen"))).alias("flags"), "quantity", F.lit("q").alias("quantity_raw"), F.when(p % 3 != 0, F.col("cents")).alias("unit_price"),
        F.col("cents").alias("net_amount"), F.when(p % 11 != 0, F.col("discount_percent")).alias("discount"), held.alias("evidence"),
    )
    shown = F.array_join(F.transform("derived.operands", lambda o: F.concat_ws(":", o["field"], o["token_ids"][0])), ",")
    return crossview.derived_provenance(r).select("row_id", shown.alias("operands"), F.col("derived.result").alias("result"), "quantity_raw", F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence"))


_BESIDE = ["Strip", "12", " box ", "", "rip"]


@query(rf"""WITH {LEDGER_SQL}, x AS (SELECT row_id, part, description AS canon, trim({pick_sql(_BESIDE, 'part')}) AS echo, CASE WHEN part % 3 = 0 THEN description || ' - STRIP' WHEN part % 3 = 1 THEN description || '/12 ' ELSE description || ' box' END AS printed FROM ledger)
SELECT row_id, CASE WHEN echo <> '' AND part % 13 <> 0 AND part % 17 <> 0 AND ((part % 3 = 0 AND echo = 'Strip') OR (part % 3 = 1 AND echo = '12') OR (part % 3 = 2 AND echo = 'box')) THEN canon END AS trimmed FROM x""")
def echoed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = F.col("part"), F.col("description")
    printed = F.when(p % 3 == 0, F.concat(d, F.lit(" - STRIP"))).when(p % 3 == 1, F.concat(d, F.lit("/12 "))).otherwise(F.concat(d, F.lit(" box")))
    ids = F.when(p % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t1")))
    on = F.when(p % 17 == 0, F.array(F.lit("t2"))).otherwise(F.array(F.lit("t1"), F.lit("t2")))
    return ledger(spark, sf_dir).select("row_id", crossview.without_echo(printed, pick(_BESIDE, p), F.upper(d), ids, on).alias("trimmed"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN 0.70 + p_size % 10 / 100.0 END AS lab, CASE WHEN p_partkey % 5 = 0 THEN []::DOUBLE[] WHEN p_partkey % 5 = 1 THEN [0.2, 0.71] ELSE [0.3, 0.5, 0.86] END AS st, CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 0.7 END AS head, p_partkey % 2 = 0 AS proven FROM part)
SELECT p_partkey, CASE WHEN len(st) = 0 THEN lab WHEN lab IS NULL THEN st[-1] WHEN abs(st[-1] - lab) <= 0.06 THEN st[-1] WHEN st[-1] > lab AND lab >= head - 0.015 AND st[-1] - lab <= 0.15 AND proven THEN st[-1] ELSE lab END AS amount_lane FROM p""")
def amount_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    listed = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<double>")
    stable = F.when(k % 5 == 0, listed()).when(k % 5 == 1, listed(0.2, 0.71)).otherwise(listed(0.3, 0.5, 0.86))
    found = crossview.snapped_amount(F.when(k % 6 != 0, F.lit(0.70) + s % 10 / 100.0), stable, F.when(s % 3 == 0, listed(0.1, 0.9)).otherwise(listed(0.1, 0.7)), k % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("amount_lane"))


_VERSIONS = ["offline_accuracy_spine_v5", "offline_accuracy_spine_v6", "v4", None]


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, {pick_sql(_VERSIONS, 'o_orderkey // 2')} AS v, CASE WHEN o_custkey % 9 < 7 THEN o_custkey % 9 END AS rev, o_custkey % 2 = 0 AS rec, o_orderkey % 5 = 0 AS fatal FROM orders WHERE o_orderkey % 11 <> 0),
a AS (SELECT o_orderkey AS job_id FROM orders), w AS (SELECT a.job_id, CASE WHEN j.job_id IS NULL THEN 'job_not_found' WHEN v IS NULL OR v = 'v4' THEN 'unsupported_output_version' WHEN rev = 2 AND rec THEN 'revision_2_recovery_audit_incomplete'
  WHEN rev IS NULL OR (v LIKE '%v5' AND rev NOT IN (2, 3, 4, 5)) OR (v LIKE '%v6' AND rev <> 6) THEN 'unsupported_contract_revision' WHEN fatal THEN 'fatal_validation_failure' END AS reason FROM a LEFT JOIN j ON a.job_id = j.job_id)
SELECT job_id, CASE WHEN reason IS NULL THEN 'eligible' WHEN reason = 'revision_2_recovery_audit_incomplete' THEN 'reprocess_required' ELSE 'ineligible' END AS eligibility, reason FROM w""")
def recertification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    jobs = o.where(k % 11 != 0).select(k.alias("job_id"), pick(_VERSIONS, F.expr("o_orderkey div 2")).alias("output_version"), F.when(c % 9 < 7, c % 9).alias("contract_revision"), (c % 2 == 0).alias("recovery_attempted"), (k % 5 == 0).alias("fatal"))
    return crossview.recertification(jobs, o.select(k.alias("job_id")))


@query("""WITH t AS (SELECT o_orderkey AS source, o_custkey % 3 AS page FROM orders), w AS (SELECT o_orderkey AS source, o_orderkey * 10 + n AS workspace_id FROM orders, range(1, 3) x(n) WHERE o_orderkey % 7 <> 0 AND (n = 1 OR o_orderkey % 5 = 0)),
r AS (SELECT workspace_id, 1 AS page, 1 AS n, CASE WHEN source % 3 = 0 THEN 'held' ELSE 'valid' END AS status, CASE WHEN source % 2 = 0 THEN 'low_gain' END AS reason FROM w UNION ALL SELECT workspace_id, 2, 1, 'valid', NULL FROM w WHERE source % 11 <> 0 UNION ALL SELECT workspace_id, 2, 2, 'valid', 'again' FROM w WHERE source % 13 = 0),
c AS (SELECT source, count(*) AS n, min(workspace_id) AS workspace_id FROM w GROUP BY source), d AS (SELECT workspace_id, page, count(*) AS n, arg_min(status, n) AS status, min_by(coalesce(reason, ''), n) AS reason FROM r GROUP BY workspace_id, page)
SELECT * FROM (SELECT t.source, t.page, CASE WHEN c.n IS NULL THEN 'candidate_workspace_missing' WHEN c.n > 1 THEN 'multiple_candidate_workspaces' WHEN d.n IS NULL THEN 'uvdoc_shadow_run_missing' WHEN d.n > 1 OR d.status <> 'valid' THEN coalesce(nullif(d.reason, ''), 'uvdoc_shadow_invalid') END AS reason
  FROM t LEFT JOIN c USING (source) LEFT JOIN d ON d.workspace_id = c.workspace_id AND d.page = t.page) WHERE reason IS NOT NULL""")
def shadow_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n, s = F.col("n"), F.col("source")
    w = o.where(k % 7 != 0).select(k.alias("source"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where((n == 1) | (s % 5 == 0)).select("source", (s * 10 + n).alias("workspace_id"))
    none = F.lit(None).cast("string")
    run = lambda page, at, status, reason: F.struct(F.lit(page).cast("long").alias("page"), F.lit(at).alias("n"), status.alias("status"), reason.alias("reason"))
    ok = F.lit("valid")
    made = F.array_compact(F.array(run(1, 1, F.when(s % 3 == 0, "held").otherwise(ok), F.when(s % 2 == 0, "low_gain")), F.when(s % 11 != 0, run(2, 1, ok, none)), F.when(s % 13 == 0, run(2, 2, ok, F.lit("again")))))
    runs = w.select("workspace_id", F.inline(made))
    return crossview.shadow_failures(o.select(k.alias("source"), (F.col("o_custkey") % 3).alias("page")), w, runs)
