"""Corpus management: group-safe splits, leakage, identity conflicts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.text import plain


def grouped_splits(groups: DataFrame, group: str, seed: str) -> DataFrame:
    """(group, split): groups in order of a seeded digest, 60 % train, 20 % validation, the rest holdout; each split gets one if there are three groups.

    Groups are few beside documents, so they are ranked as a whole.
    """
    one = groups.select(F.col(group).cast("string").alias("g")).distinct()
    w = Window.partitionBy(F.lit(0))
    x = one.withColumn("_i", F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "g"), 256))) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    train = F.bround(F.col("_n") * 0.6).cast("int")
    held = F.bround(F.col("_n") * 0.2).cast("int")
    many = F.col("_n") >= 3
    train = F.when(many, F.least(F.greatest(train, F.lit(1)), F.col("_n") - 2)).otherwise(train)
    held = F.when(many, F.greatest(held, F.lit(1))).otherwise(held)
    held = F.when(many, F.least(held, F.col("_n") - train - 1)).otherwise(held)
    return x.select(F.col("g").alias(group), F.when(F.col("_i") < train, "train").when(F.col("_i") < train + held, "validation").otherwise("holdout").alias("split"))


def leakage(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in several splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def identity_conflicts(names: DataFrame) -> DataFrame:
    """Normalised names with several owners, from (name, owner) of all registries."""
    return names.select(plain(F.col("name")).alias("name"), "owner").where("name <> ''").groupBy("name").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("first_owner")).where("owners > 1")


def compare_manifest(expected: DataFrame, found: DataFrame, prints: list[str]) -> DataFrame:
    """Each expected source (key source) against exactly one found: missing, ambiguous, changed with the names of changed fingerprints, or same."""
    n = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.max(p).alias(f"new_{p}") for p in prints])
    both = expected.join(n, "source", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"new_{p}")), p) for p in prints]))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select("source", state.alias("state"), F.when(F.col("n") == 1, F.array_join(changed, ",")).otherwise("").alias("changed"))


def containment(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Members of a cohort that the enclosing one lacks; empty if it is nested."""
    return small.select(*keys).distinct().join(large.select(*keys), keys, "left_anti")


def multiset_overlap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key, how many values two multisets share, and the share of the smaller."""
    x = a.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("nb"))
    both = x.join(y, [*keys, value], "full_outer").na.fill(0, ["na", "nb"])
    out = both.groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("shared"), F.sum("na").alias("left_n"), F.sum("nb").alias("right_n"))
    return out.withColumn("share", F.try_divide(F.col("shared"), F.least("left_n", "right_n")))
