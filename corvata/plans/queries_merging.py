"""Queries on merging recovered readings, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.operators import merging
from corvata.plans.queries import query
from corvata.plans.queries_core import _box, pick, pick_sql
from corvata.sources.testtables import LEDGER_SQL, ledger

# Tokens: one for each ledger row; the second reading is a little displaced and lacks some, the third reads two regions anew.


def _tokens(r: DataFrame, prefix: str, shift: Column) -> DataFrame:
    return r.select("document_id", "page", F.concat(F.lit(prefix), F.col("row_id")).alias("token_id"), _box(F.col("part") % 90 * 10 + shift, F.col("row_order") * 25, F.lit(60), F.lit(20)).alias("box"))


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    r = ledger(spark, sf_dir)
    first, recovered = _tokens(r, "", F.lit(0)), _tokens(r.where("part % 3 <> 0"), "recovery:", F.col("part") % 50)
    number = F.explode(F.array(F.lit(0), F.lit(1)))
    regions = r.select("document_id", "page").distinct().select("document_id", "page", number.alias("n")).select("document_id", "page", _box(F.col("n") * 500, F.lit(0), F.lit(150), F.lit(80)).alias("box"))
    return first, recovered, _tokens(r, "target:", F.lit(5)).where("box.l < 300"), regions


_READ_SQL = f"""{LEDGER_SQL}, tok AS (SELECT document_id, page, row_id, part, part % 90 * 10 AS l, row_order * 25 AS t FROM ledger),
rec AS (SELECT document_id, page, 'recovery:' || row_id AS row_id, l + part % 50 AS l, t FROM tok WHERE part % 3 <> 0),
target AS (SELECT document_id, page, 'target:' || row_id AS row_id FROM tok WHERE l + 5 < 300),
kept AS (SELECT * FROM tok WHERE NOT (t + 10 <= 80 AND (l + 30 <= 150 OR (l + 30 >= 500 AND l + 30 <= 650)))),
more AS (SELECT * FROM rec WHERE NOT (t + 10 <= 80 AND (l + 30 <= 150 OR (l + 30 >= 500 AND l + 30 <= 650)))),
extra AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.document_id = m.document_id AND k.page = m.page AND greatest(0, 60 - abs(k.l - m.l)) * greatest(0, 20 - abs(k.t - m.t)) >= 0.5 * 1200))"""


@query(f"""WITH {_READ_SQL} SELECT document_id, page, row_id AS token_id FROM kept UNION ALL SELECT document_id, page, row_id FROM extra UNION ALL SELECT document_id, page, row_id FROM target""")
def merged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged_tokens(*_readings(spark, sf_dir)).select("document_id", "page", "token_id")


@query(f"""WITH {_READ_SQL} SELECT document_id, page, row_id AS token_id FROM kept UNION ALL SELECT document_id, page, row_id FROM target""")
def replaced_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, _, targeted, regions = _readings(spark, sf_dir)
    return merging.replaced_tokens(first, targeted, regions).select("document_id", "page", "token_id")


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT row_id, part % 90 * 10 AS l, row_order * 25 AS t, part % 7 * 20 AS cl, page * 10 AS ct, 400 + part % 300 AS cw, 200 + part % 11 AS ch, 300 + part % 5 AS w, 150 AS h FROM ledger)
SELECT row_id, round(cl + l * cw / w, 6) AS l, round(ct + (t + 20) * ch / h, 6) AS b,
  greatest(0, least(w, CAST(round_even((l - cl) * CAST(w AS DOUBLE) / cw, 0) AS BIGINT))) AS pixel_l, greatest(0, least(w, CAST(round_even((l + 60 - cl) * CAST(w AS DOUBLE) / cw, 0) AS BIGINT))) AS pixel_r,
  greatest(0, least(h, CAST(round_even((t - ct) * CAST(h AS DOUBLE) / ch, 0) AS BIGINT))) AS pixel_t FROM c""")
def crop_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    box, crop = _box(p % 90 * 10, F.col("row_order") * 25, F.lit(60), F.lit(20)), _box(p % 7 * 20, F.col("page") * 10, 400 + p % 300, 200 + p % 11)
    r = ledger(spark, sf_dir).select("row_id", box.alias("box"), crop.alias("crop"), (300 + p % 5).alias("w"), F.lit(150).alias("h"))
    x = r.select("row_id", merging.crop_to_page(F.col("box"), F.col("crop"), F.col("w"), F.col("h")).alias("p"), merging.page_to_crop(F.col("box"), F.col("crop"), F.col("w"), F.col("h")).alias("c"))
    return x.select("row_id", F.round("p.l", 6).alias("l"), F.round("p.b", 6).alias("b"), F.col("c.l").alias("pixel_l"), F.col("c.r").alias("pixel_r"), F.col("c.t").alias("pixel_t"))


# Units: a row of a ledger belongs to a table, or every fourth to the page's rest; the recovery read pages of two documents in three.


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    unit = F.when(F.col("part") % 4 != 0, F.col("table_id")).alias("table_id")
    r = ledger(spark, sf_dir).select("document_id", "page", unit, "row_id", "part")
    first, recovered = r.select("*", F.lit("first").alias("reading")), r.where("document_id % 3 <> 0 and part % 5 <> 0").select("*", F.lit("recovered").alias("reading"))
    targets = r.where("part % 2 = 0 or part % 7 = 0").select("document_id", "page", "table_id")
    return first, recovered, merging.replaceable(targets, recovered, recovered.select("document_id", "page").distinct())


_UNIT_SQL = f"""{LEDGER_SQL}, u AS (SELECT document_id, page, CASE WHEN part % 4 <> 0 THEN table_id END AS table_id, row_id, part FROM ledger),
rec AS (SELECT * FROM u WHERE document_id % 3 <> 0 AND part % 5 <> 0),
aim AS (SELECT DISTINCT document_id, page, table_id FROM u WHERE part % 2 = 0 OR part % 7 = 0),
unit AS (SELECT * FROM aim a WHERE EXISTS (SELECT 1 FROM rec r WHERE r.document_id = a.document_id AND r.page = a.page AND (a.table_id IS NULL OR r.table_id = a.table_id)))"""


@query(f"""WITH {_UNIT_SQL} SELECT row_id, table_id, 'first' AS reading FROM u WHERE NOT EXISTS (SELECT 1 FROM unit x WHERE x.document_id = u.document_id AND x.page = u.page AND x.table_id IS NOT DISTINCT FROM u.table_id)
UNION ALL SELECT row_id, table_id, 'recovered' FROM rec WHERE EXISTS (SELECT 1 FROM unit x WHERE x.document_id = rec.document_id AND x.page = rec.page AND x.table_id IS NOT DISTINCT FROM rec.table_id)""")
def merged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, recovered, units = _units(spark, sf_dir)
    return merging.merged_units(first, recovered, units).select("row_id", "table_id", "reading")


def _owned(rows: DataFrame) -> DataFrame:
    owners = F.array_compact(F.array("table_id", F.when(F.col("part") % 6 == 1, F.lit("shared"))))
    return rows.select("document_id", "page", F.col("row_id").alias("token_id"), owners.alias("owners"), "reading")


@query(f"""WITH {_UNIT_SQL}, own AS (SELECT *, list_filter([table_id, CASE WHEN part % 6 = 1 THEN 'shared' END], lambda x: x IS NOT NULL) AS owners FROM u),
kept AS (SELECT document_id, page, row_id FROM own o WHERE NOT EXISTS (SELECT 1 FROM unit x WHERE x.document_id = o.document_id AND x.page = o.page AND ((len(o.owners) = 1 AND x.table_id = o.owners[1]) OR (len(o.owners) = 0 AND x.table_id IS NULL)))),
new AS (SELECT row_id FROM own o WHERE document_id % 3 <> 0 AND part % 5 <> 0 AND EXISTS (SELECT 1 FROM unit x WHERE x.document_id = o.document_id AND x.page = o.page AND (list_contains(o.owners, x.table_id) OR (len(o.owners) = 0 AND x.table_id IS NULL))))
SELECT row_id AS token_id, 'first' AS reading FROM kept UNION ALL SELECT row_id, 'recovered' FROM new WHERE row_id NOT IN (SELECT row_id FROM kept)""")
def merged_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, recovered, units = _units(spark, sf_dir)
    return merging.merged_manifest(_owned(first), _owned(recovered), units).select("token_id", "reading")


_TYPES = ["pharmacy", "category_summary", "payment", "item_ledger"]


@query(f"""WITH {LEDGER_SQL}, p AS (SELECT *, section AS profile_key, CASE WHEN section NOT LIKE '%TIN' THEN {pick_sql(_TYPES, 'length(section)')} END AS t, CASE WHEN section NOT LIKE '%TIN' THEN length(section) % 2 = 0 END AS lacks FROM ledger)
SELECT row_id, CASE WHEN t IS NULL THEN role WHEN t = 'category_summary' THEN 'category_rollup' WHEN t = 'payment' THEN 'payment' WHEN cents < 0 THEN 'refund' WHEN role = 'category_rollup' THEN 'detail' ELSE role END AS role,
  coalesce(t, 'unknown') AS table_type, CASE WHEN t IS NOT NULL THEN greatest(part % 10 / 10.0, 0.65) ELSE part % 10 / 10.0 END AS confidence, CASE WHEN lacks IS NOT TRUE THEN quantity END AS quantity, CASE WHEN lacks THEN 'amount' ELSE 'amount,quantity' END AS evidence FROM p""")
def profile_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.create_map(F.lit("amount"), F.array("row_id"), F.lit("quantity"), F.array("row_id"))
    r = ledger(spark, sf_dir)
    rows = r.select("row_id", F.col("section").alias("profile_key"), "role", F.lit("unknown").alias("table_type"), F.col("cents").alias("amount"), (F.col("part") % 10 / 10.0).alias("confidence"), seen.alias("evidence"), "quantity")
    size = F.length("profile_key")
    profiles = r.select(F.col("section").alias("profile_key")).distinct().where("profile_key not like '%TIN'")
    profiles = profiles.select("profile_key", pick(_TYPES, size).alias("table_type"), F.lit(0.65).alias("threshold"), F.when(size % 2 == 0, F.array(F.lit("quantity"), F.lit("rate"))).alias("unsupported"))
    return merging.constrained(rows, profiles).select("row_id", "role", "table_type", "confidence", "quantity", F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence"))


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT document_id, page, CASE WHEN part % 9 <> 0 THEN upper(description) || '.' END AS description, CASE WHEN part % 31 = 0 THEN cents + 1 WHEN part % 7 <> 0 THEN cents END AS cents FROM ledger WHERE document_id % 5 <> 0),
a AS (SELECT document_id, page, list_sort(list_distinct(list(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) || '|' || cents))) AS s FROM ledger GROUP BY document_id, page),
b AS (SELECT document_id, page, list_sort(list_distinct(list(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) || '|' || cents))) AS s FROM o WHERE description IS NOT NULL AND cents IS NOT NULL GROUP BY document_id, page)
SELECT a.document_id, a.page, b.s IS NOT NULL AND a.s <> b.s AS disagrees FROM a LEFT JOIN b ON a.document_id = b.document_id AND a.page = b.page""")
def reading_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger(spark, sf_dir)
    p = F.col("part")
    other = r.where("document_id % 5 <> 0").select("document_id", "page", F.when(p % 9 != 0, F.concat(F.upper("description"), F.lit("."))).alias("description"), F.when(p % 31 == 0, F.col("cents") + 1).when(p % 7 != 0, F.col("cents")).alias("amount"))
    return merging.disagreements(r.select("document_id", "page", "description", F.col("cents").alias("amount")), other, ["document_id", "page"])


@query(f"""WITH {LEDGER_SQL}, x AS (SELECT document_id, page, row_id, part, unnest(range(0, 4)) AS c FROM ledger),
cell AS (SELECT *, CASE WHEN (part + c) % 11 = 0 THEN 0.0 ELSE 10.0 + (part * (c + 3)) % 23 END AS h, c * 200 + part % 60 AS l FROM x WHERE (part + c) % 13 <> 0),
med AS (SELECT a.row_id, a.c, median(b.h) AS m, count(b.h) AS n FROM cell a LEFT JOIN cell b ON a.row_id = b.row_id AND a.c <> b.c AND b.h > 0 GROUP BY a.row_id, a.c)
SELECT cell.row_id, cell.c AS column_id, coalesce(n >= 2 AND (h > 3 * m OR (h > 2 * m AND abs(l + 50 - (c * 200 + 40)) > 680 * 0.08)), false) AS oversized FROM cell JOIN med USING (row_id, c)""")
def oversized_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("part"), F.col("column_id")
    r = ledger(spark, sf_dir).select("document_id", "page", F.lit("t").alias("table_id"), "row_id", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("column_id"))
    height = F.when((p + c) % 11 == 0, 0.0).otherwise(10.0 + (p * (c + 3)) % 23)
    left = c * 200 + p % 60
    cells = r.where("(part + column_id) % 13 <> 0").select("document_id", "page", "table_id", "row_id", "column_id", F.array(height).alias("heights"), left.cast("double").alias("l"), (left + 100).cast("double").alias("r"))
    columns = r.select("document_id", "page", "table_id", "column_id").distinct().select("*", (c * 200).cast("double").alias("l"), (c * 200 + 80).cast("double").alias("r"))
    return merging.oversized_overlays(cells, columns).select("row_id", "column_id", "oversized")
