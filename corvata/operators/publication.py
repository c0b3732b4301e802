"""What leaves the ledger: canonical rows, printed tables, populated columns, public states, service dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.fields import digest
from corvata.operators.classify import page_type
from corvata.operators.ledger import publishable

# Fields that are published only with evidence of their own, and columns that are shown only where filled.
OPTIONAL = ("quantity", "rate", "gross_amount", "discount", "service_date", "request_no", "service_code", "hsn_code")
POPULATED = ("section", "request_no", "service_code", "hsn_code", "discount")


def canonical(rows: DataFrame, start: int = 0) -> DataFrame:
    """The publishable rows of each table in order, optional fields only where evidence (MAP field -> tokens) has them.

    Adds page_type, row_order from start within (document_id, page, table_id), token_ids (all evidence,
    fields in sorted order, each token once) and canonical_id, a digest of place and evidence.
    """
    grounded = F.map_filter("evidence", lambda k, v: F.size(v) > 0)
    kept = rows.withColumn("evidence", grounded).where(publishable(F.col("role"), F.col("evidence"), F.col("description"), F.col("amount")) & F.col("box").isNotNull())
    for c in [c for c in OPTIONAL if c in rows.columns]:
        kept = kept.withColumn(c, F.when(F.map_contains_key("evidence", F.lit(c)), F.col(c)))
    tokens = F.array_distinct(F.flatten(F.transform(F.array_sort(F.map_keys("evidence")), lambda k: F.element_at("evidence", k))))
    kept = kept.withColumn("token_ids", tokens).withColumn("page_type", page_type(F.col("table_type")))
    kept = kept.withColumn("canonical_id", F.substring(digest(*[F.col(c) for c in ("document_id", "page", "table_id", "source_row", "token_ids")]), 1, 24))
    order = Window.partitionBy("document_id", "page", "table_id").orderBy("source_row")
    return kept.withColumn("row_order", (F.row_number().over(order) - 1 + start).cast("int"))


def populated(rows: DataFrame, keys: list[str], fields: tuple[str, ...] = POPULATED) -> DataFrame:
    """By key, the fields that some row fills, in the order given."""
    some = {c: F.max((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")) for c in fields}
    found = rows.groupBy(*keys).agg(*[v.alias(f"_{c}") for c, v in some.items()])
    return found.select(*keys, F.array_compact(F.array(*[F.when(F.col(f"_{c}") == 1, c) for c in fields])).alias("populated"))


def remapped(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Printed columns (document_id, table_id, column_id, canonical_field) with what a reviewer mapped them to instead."""
    m = mappings.select("document_id", "table_id", "column_id", F.col("canonical_field").alias("_mapped"))
    return columns.join(m, ["document_id", "table_id", "column_id"], "left").withColumn("canonical_field", F.coalesce("_mapped", "canonical_field")).drop("_mapped")


def printed_rows(rows: DataFrame, needle: str = "", page: int | None = None, offset: int = 0, limit: int = 200, anchor: Column | None = None) -> DataFrame:
    """A window of the printed rows of each document, by table: document_id, table_id, rows (ordinal, row_id), total.

    rows: document_id, page, table_order, table_id, row_order, row_id, cells ARRAY<STRING>. A needle
    must stand in a cell; ordinals count the rows found from 1; an anchor row moves the window to the
    page of rows that holds it, and a document without it gives nothing.
    """
    found = rows if page is None else rows.where(F.col("page") == page)
    if needle.strip():
        low = needle.strip().lower()
        found = found.where(F.exists("cells", lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low))))
    whole = Window.partitionBy("document_id")
    found = found.withColumn("ordinal", F.row_number().over(whole.orderBy("table_order", "row_order", "row_id"))).withColumn("total", F.count(F.lit(1)).over(whole))
    first = F.lit(offset)
    if anchor is not None:
        first = F.expr(f"(min(case when _anchor then ordinal end) over (partition by document_id) - 1) div {limit} * {limit}")
        found = found.withColumn("_anchor", anchor)
    found = found.withColumn("_first", first).where((F.col("ordinal") > F.col("_first")) & (F.col("ordinal") <= F.col("_first") + limit))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "row_id"))), lambda x: x)
    return found.groupBy("document_id", "table_order", "table_id").agg(shown.alias("rows"), F.first("total").alias("total"))


# States whose validation is shown only if it is certified.
DONE = ("complete", "needs_review")


def public_states(jobs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Jobs as shown outside: uncertified validation is hidden, old results are marked, a reviewer's hospital wins.

    jobs: job_id, status, hospital_name, validation_status, issue_count, evidence_contract, certified,
    certification; overrides: job_id, name.
    """
    o = overrides.select("job_id", F.nullif("name", F.lit("")).alias("_name"))
    done = F.col("status").isin(*DONE)
    certified = F.coalesce("certified", F.lit(False))
    hidden = done & ~certified
    legacy = done & F.col("evidence_contract").isNull()
    name = F.when(done & F.col("_name").isNotNull(), F.col("_name"))
    return jobs.join(o, "job_id", "left").select(
        "job_id", "status", F.coalesce(name, "hospital_name").alias("hospital_name"),
        F.when(name.isNotNull(), "reviewer").when(F.coalesce("hospital_name", F.lit("")) != "", "machine").alias("hospital_source"),
        F.when(~hidden, F.col("validation_status")).alias("validation_status"), F.when(~hidden, F.col("issue_count")).alias("issue_count"),
        F.when(legacy, "legacy_v5").otherwise(F.col("evidence_contract")).alias("evidence_contract"), legacy.alias("reprocess"),
        F.when(certified, F.col("validation_status")).when(done, F.coalesce("certification", F.lit("legacy_uncertified"))).alias("certification"),
    )


def with_service_date(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the dates found for them: an empty date is filled, its evidence is added once, and the row says so.

    rows: row_id, service_date, date_evidence ARRAY, flags ARRAY; found: row_id, date, evidence ARRAY.
    """
    f = found.select("row_id", F.col("date").alias("_date"), F.col("evidence").alias("_more"))
    fill = F.col("service_date").isNull() & F.col("_date").isNotNull()
    both = F.array_distinct(F.concat("date_evidence", F.coalesce("_more", F.array().cast("array<string>"))))
    out = rows.join(f, "row_id", "left").withColumn("date_evidence", F.when(fill, both).otherwise(F.col("date_evidence")))
    out = out.withColumn("flags", F.when(fill, F.array_distinct(F.array_append("flags", F.lit("service_date_recovered")))).otherwise(F.col("flags")))
    return out.withColumn("service_date", F.when(fill, F.col("_date")).otherwise(F.col("service_date"))).drop("_date", "_more")
