"""The star-schema tables seen as ledgers: an order is a bill, its items are ledger rows.

Amounts are whole cents until the end, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def money(c: Column) -> Column:
    """Cents as DECIMAL(18,2)."""
    return (c.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, page, table_id, row_order, row_id, description, section, quantity, cents, discount_cents, service_date, role, part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    rows = items.join(parts, items.l_partkey == parts.p_partkey)
    refund = F.col("l_returnflag") == "R"
    amount = cents(F.col("l_extendedprice"))
    return rows.select(
        F.col("l_orderkey").alias("document_id"), F.expr("cast((l_linenumber - 1) div 3 + 1 as int)").alias("page"), F.col("l_suppkey").cast("string").alias("table_id"), (F.row_number().over(order) - 1).alias("row_order"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(order) - 1).alias("row_id"), F.concat_ws(" ", "p_name", "p_brand").alias("description"), F.col("p_type").alias("section"),
        F.col("l_quantity").cast("long").alias("quantity"), F.when(refund, -amount).otherwise(amount).alias("cents"), F.round(F.col("l_discount") * 100).cast("long").alias("discount_percent"),
        F.col("l_shipdate").cast("date").alias("service_date"), F.when(refund, "refund").when(F.col("l_quantity") >= 45, "category_rollup").when(F.col("l_quantity") <= 2, "metadata").otherwise("detail").alias("role"), F.col("l_partkey").alias("part"),
    )


#: The same view for another SQL engine, as a CTE named ledger.
LEDGER_SQL = """ledger AS (
  SELECT document_id, page, table_id, row_order, row_key || '-' || row_order AS row_id, description, section, quantity, cents, discount_percent, service_date, role, part FROM (
  SELECT l_orderkey AS document_id, CAST((l_linenumber - 1) // 3 + 1 AS INTEGER) AS page, CAST(l_suppkey AS VARCHAR) AS table_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) - 1 AS INTEGER) AS row_order,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key, p_name || ' ' || p_brand AS description, p_type AS section,
    CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_returnflag = 'R' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents,
    CAST(round(l_discount * 100) AS BIGINT) AS discount_percent, CAST(l_shipdate AS DATE) AS service_date,
    CASE WHEN l_returnflag = 'R' THEN 'refund' WHEN l_quantity >= 45 THEN 'category_rollup' WHEN l_quantity <= 2 THEN 'metadata' ELSE 'detail' END AS role, l_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def predicted(gold: DataFrame) -> DataFrame:
    """What an extractor might have read: some rows lost, some doubled, amounts and words changed, by arithmetic on keys."""
    kept = gold.where((F.col("document_id") * 31 + F.col("part")) % 17 != 0)
    kept = kept.withColumn("cents", F.when(F.col("part") % 13 == 0, F.col("cents") + 100).otherwise(F.col("cents")))
    kept = kept.withColumn("description", F.when(F.col("part") % 11 == 0, F.concat(F.lit("copy of "), F.col("description"))).otherwise(F.col("description")))
    copies = F.when(F.col("part") % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.withColumn("copy", F.explode(copies))


PREDICTED_SQL = """predicted AS (
  SELECT document_id, page, table_id, row_order, row_id, CASE WHEN part % 11 = 0 THEN 'copy of ' || description ELSE description END AS description, section, quantity,
    CASE WHEN part % 13 = 0 THEN cents + 100 ELSE cents END AS cents, discount_percent, service_date, role, part, CAST(copy AS INTEGER) AS copy
  FROM (SELECT *, unnest(CASE WHEN part % 19 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ledger WHERE (document_id * 31 + part) % 17 <> 0))"""


def printed_totals(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """document_id, total_cents, label: o_totalprice, but for every third order the exact sum of its items; every seventh prints none, every eleventh two."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sums = rows.where(F.col("role").isin("detail", "refund", "category_rollup")).groupBy("document_id").agg(F.sum("cents").alias("items"))
    both = orders.join(sums, orders.o_orderkey == sums.document_id, "left")
    total = F.when(F.col("o_orderkey") % 3 == 0, F.coalesce("items", F.lit(0))).otherwise(cents(F.col("o_totalprice")))
    rest = both.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("document_id"), total.alias("total_cents"))
    labels = F.when(F.col("document_id") % 11 == 0, F.array(F.lit("Net Bill Amount"), F.lit("Grand Total"))).otherwise(F.array(F.lit("Net Bill Amount")))
    return rest.withColumn("label", F.explode(labels)).withColumn("total_cents", F.col("total_cents") + F.when(F.col("label") == "Grand Total", 500).otherwise(0))


TOTALS_SQL = """item_sums AS (SELECT document_id, sum(cents) AS items FROM ledger WHERE role IN ('detail', 'refund', 'category_rollup') GROUP BY document_id),
one_total AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(items, 0) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS total_cents FROM orders LEFT JOIN item_sums ON o_orderkey = document_id WHERE o_orderkey % 7 <> 0),
printed AS (SELECT document_id, total_cents + CASE WHEN label = 'Grand Total' THEN 500 ELSE 0 END AS total_cents, label
  FROM (SELECT *, unnest(CASE WHEN document_id % 11 = 0 THEN ['Net Bill Amount', 'Grand Total'] ELSE ['Net Bill Amount'] END) AS label FROM one_total))"""
