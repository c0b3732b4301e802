"""Evaluation against authoritative cells: outcomes by cell, counts, ratios and their averages.

Levels are joined one after another: tables, then columns and rows of matched tables, then cells where
a matched row and column meet. Every level is an equi-join on the level above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvata.plans.metrics import shown_ratio

# Ratios as (name, numerator, denominator).
RATIOS = (
    ("precision", "exact_cells", "actual_asserted_cells"), ("recall", "exact_cells", "gold_asserted_cells"),
    ("table_precision", "matched_tables", "actual_tables"), ("table_recall", "matched_tables", "gold_tables"), ("column_precision", "matched_columns", "actual_columns"), ("column_recall", "matched_columns", "gold_columns"),
    ("row_precision", "matched_rows", "actual_rows"), ("row_recall", "matched_rows", "gold_rows"), ("cell_structure_precision", "aligned_cells", "actual_cells"), ("cell_structure_recall", "aligned_cells", "gold_cells"),
    ("readable_cell_precision", "exact_readable_cells", "actual_readable_cells"), ("readable_cell_recall", "exact_readable_cells", "gold_readable_cells"),
    ("unreadable_precision", "correct_unreadable_cells", "actual_unreadable_cells"), ("unreadable_recall", "correct_unreadable_cells", "gold_unreadable_cells"), ("correct_column_assignment", "correctly_assigned_cells", "gold_cells"),
)


def cell_outcomes(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer join of cells (document_id, table_id, row_key, column_key, role, value, readable) with an outcome.

    Priority: missing, extra, both unreadable, readability differs, wrong column (the value stands in
    another column of the row), wrong role, exact, wrong value.
    """
    keys = ["document_id", "table_id", "row_key", "column_key"]
    g = gold.select(*keys, F.col("role").alias("g_role"), F.col("value").alias("g"), F.col("readable").alias("g_read"))
    a = actual.select(*keys, F.col("role").alias("a_role"), F.col("value").alias("a"), F.col("readable").alias("a_read"))
    rows = actual.where("readable and value is not null").groupBy("document_id", "table_id", "row_key").agg(F.collect_set("value").alias("_values"))
    x = g.join(a, keys, "full_outer").join(rows, keys[:3], "left")
    lost, more = F.col("a_read").isNull(), F.col("g_read").isNull()
    same = F.coalesce(F.col("g") == F.col("a"), F.lit(False))
    outcome = (
        F.when(lost, "missing").when(more, "extra").when(~F.col("g_read") & ~F.col("a_read"), "unreadable").when(F.col("g_read") != F.col("a_read"), "readability_mismatch")
        .when(~same & F.coalesce(F.array_contains("_values", F.col("g")), F.lit(False)), "wrong_column").when(same & (F.col("g_role") != F.col("a_role")), "wrong_role").when(same, "exact").otherwise("wrong_value")
    )
    return x.select(*keys, "g_role", "a_role", "g_read", "a_read", outcome.alias("outcome"))


def cell_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Integer counts by group. Cells that both sides can't read count as exact but not as asserted, so a ratio may pass 1; see over_one."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    o = F.col("outcome")
    gold, actual = F.col("g_read").isNotNull(), F.col("a_read").isNotNull()
    return outcomes.groupBy(*keys).agg(
        n(gold).alias("gold_cells"), n(actual).alias("actual_cells"), n(gold & actual).alias("aligned_cells"), n(gold & actual & (F.col("g_role") == F.col("a_role"))).alias("correctly_assigned_cells"),
        n(o.isin("exact", "unreadable")).alias("exact_cells"), n(F.col("g_read")).alias("gold_asserted_cells"), n(F.col("a_read")).alias("actual_asserted_cells"), n(F.col("g_read")).alias("gold_readable_cells"), n(F.col("a_read")).alias("actual_readable_cells"),
        n(o == "exact").alias("exact_readable_cells"), n(gold & ~F.col("g_read")).alias("gold_unreadable_cells"), n(actual & ~F.col("a_read")).alias("actual_unreadable_cells"), n(o == "unreadable").alias("correct_unreadable_cells"),
    )


def structure_counts(gold: DataFrame, actual: DataFrame, keys: list[str], thing: list[str], name: str) -> DataFrame:
    """gold_, actual_ and matched_ counts of distinct things by group."""
    g, a = gold.select(*keys, *thing).distinct().withColumn("_g", F.lit(1)), actual.select(*keys, *thing).distinct().withColumn("_a", F.lit(1))
    x = g.join(a, [*keys, *thing], "full_outer")
    return x.groupBy(*keys).agg(F.count("_g").alias(f"gold_{name}"), F.count("_a").alias(f"actual_{name}"), F.count_if(F.col("_g").isNotNull() & F.col("_a").isNotNull()).alias(f"matched_{name}"))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add those ratios whose counts are there, 12 places, 1 on an empty denominator, and the harmonic mean of precision and recall."""
    out = counts
    for name, a, b in RATIOS:
        if a in counts.columns and b in counts.columns:
            out = out.withColumn(name, shown_ratio(F.col(a), F.col(b)))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 12)).otherwise(0.0))


def micro_average(counts: DataFrame) -> DataFrame:
    """Counts summed over documents, then ratios; header accuracy is the mean of documents by their gold columns."""
    numbers = [c for c, t in counts.dtypes if t in ("bigint", "int")  and c != "document_id"]
    total = counts.agg(*[F.sum(c).alias(c) for c in numbers], F.count(F.lit(1)).alias("document_count"))
    return with_ratios(total)


def over_one(ratios: DataFrame, names: list[str]) -> DataFrame:
    """Groups whose ratios pass 1, with the names of those that do."""
    bad: Column = F.array_compact(F.array(*[F.when(F.col(n) > 1, n) for n in names]))
    return ratios.withColumn("over_one", bad).where(F.size("over_one") > 0)
