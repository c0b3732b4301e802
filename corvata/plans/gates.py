"""Scores between gold and read structure, cohort pairs, intake, promotion, and the gates of releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvata.functions.geometry import area, iou
from corvata.functions.text import plain


def _near(a: Column, b: Column) -> Column:
    """1 for one place in order, falling by fifths."""
    return F.greatest(F.lit(0.0), 1 - F.least(F.abs(a - b), F.lit(5)) / 5.0)


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either box is null or has no area."""
    return F.when((area(a) > 0) & (area(b) > 0), iou(a, b)).otherwise(0.0)


def _apart(a: Column, b: Column) -> Column:
    """Distance of centres in sides of the longer box, at most 1."""
    d = F.hypot((a["l"] + a["r"] - b["l"] - b["r"]) / 2, (a["t"] + a["b"] - b["t"] - b["b"]) / 2)
    side = F.greatest(a["r"] - a["l"], a["b"] - a["t"], b["r"] - b["l"], b["b"] - b["t"], F.lit(1.0))
    return F.least(F.lit(1.0), d / side)


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((F.coalesce(a, F.lit("")) != "") & (a == b), F.lit(False))


def _points(where: Column, points: float) -> Column:
    return F.when(where, points).otherwise(0.0)


def table_score(g: Column, a: Column) -> Column:
    """Of two structs (page, box, thing_id, n, kind), how well a read table fits a gold one; null if it can't."""
    placed = g["box"].isNotNull() & a["box"].isNotNull()
    both = _overlap(g["box"], a["box"])
    named = _same(g["thing_id"], a["thing_id"])
    paged = F.coalesce(g["page"] == a["page"], F.lit(False))
    where = F.when(placed, 0.45 * both + 0.10 * (1 - _apart(g["box"], a["box"]))).when(named, 0.65).otherwise(0.55 * _near(g["n"], a["n"]))
    score = F.when(paged, 0.45).otherwise(0.20) + where + _points(named, 0.08) + _points(plain(g["kind"]) == plain(a["kind"]), 0.04)
    return F.when(~(F.coalesce(g["page"] != a["page"], F.lit(False)) | (placed & (both < 0.01))), score)


def column_score(g: Column, a: Column) -> Column:
    """Of two structs (role, box, n); a column in the right place with the wrong role still fits a little."""
    placed = g["box"].isNotNull() & a["box"].isNotNull()
    known = (F.coalesce(g["role"], F.lit("")) != "") & (F.coalesce(a["role"], F.lit("")) != "")
    same = _same(g["role"], a["role"])
    where = F.when(placed, 0.27 * _overlap(g["box"], a["box"]) + 0.08 * (1 - _apart(g["box"], a["box"]))).otherwise(0.27 * _near(g["n"], a["n"]))
    score = F.when(same, 0.65).when(known, 0.04).otherwise(0.0) + where + _points(g["n"] == a["n"], 0.08)
    return F.when((score >= 0.18) | F.coalesce(g["role"], F.lit("")).eqNullSafe(F.coalesce(a["role"], F.lit(""))), score)


def row_score(g: Column, a: Column) -> Column:
    """Of two structs (thing_id, role, continues, box, n); rows that share nothing of structure don't fit."""
    placed = g["box"].isNotNull() & a["box"].isNotNull()
    both = _overlap(g["box"], a["box"])
    known = (F.coalesce(g["role"], F.lit("")) != "") & (F.coalesce(a["role"], F.lit("")) != "")
    some = (F.coalesce(g["continues"], F.lit("")) != "") | (F.coalesce(a["continues"], F.lit("")) != "")
    score = (
        _points(_same(g["thing_id"], a["thing_id"]), 0.45) + F.when(_same(g["role"], a["role"]), 0.18).when(known, 0.02).otherwise(0.0)
        + F.when(_same(g["continues"], a["continues"]), 0.12).when(some, 0.01).otherwise(0.0)
        + F.when(placed, 0.35 * both + 0.15 * (1 - _apart(g["box"], a["box"]))).otherwise(0.35 * _near(g["n"], a["n"])) + _points(g["n"] == a["n"], 0.08)
    )
    return F.when((score >= 0.20) & ~(placed & (both < 0.005)), score)


def total_score(g: Column, a: Column) -> Column:
    """Of two structs (kind, scope, label, n)."""
    same = lambda c: _same(plain(g[c]), plain(a[c]))
    score = _points(same("kind"), 0.42) + _points(same("scope"), 0.18) + _points(same("label"), 0.20) + 0.20 * _near(g["n"], a["n"])
    return F.when(score >= 0.35, score)


def cohort_pairs(gold: DataFrame, actual: DataFrame, ordered: bool = True) -> DataFrame:
    """By identity the two sides of a cohort, and what forbids to pair them: duplicates, a missing side, another order.

    gold and actual: identity, n (place, used where ordered).
    """
    side = lambda x, c: x.groupBy("identity").agg(F.count(F.lit(1)).alias(f"{c}_rows"), F.min("n").alias(f"{c}_n"))
    both = side(gold, "gold").join(side(actual, "actual"), "identity", "full_outer")
    fault = F.when(F.col("gold_rows") > 1, "gold_duplicate").when(F.col("actual_rows") > 1, "actual_duplicate").when(F.col("gold_rows").isNull(), "missing_in_gold").when(F.col("actual_rows").isNull(), "missing_in_actual")
    if ordered:
        fault = F.coalesce(fault, F.when(F.col("gold_n") != F.col("actual_n"), "order_differs"))
    return both.select("identity", "gold_n", "actual_n", fault.alias("fault"))


def resolved_failures(failures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Failures (document_id, failure_id, as ``level:id`` or a bare id) with the first outcome that has the id on either side.

    outcomes: document_id, level, n, gold_id, actual_id, status. Bare ids look in cells, rows, totals
    and tables, in that order; an id with a prefix only in that level. One equi-join on document and id.
    """
    prefix = F.regexp_extract("failure_id", r"^(cell|row|table|total):", 1)
    f = failures.withColumn("_level", prefix).withColumn("_id", F.explode(F.array_distinct(F.array("failure_id", F.regexp_replace("failure_id", r"^(cell|row|table|total):", "")))))
    rank = F.when(F.col("level") == "cell", 0).when(F.col("level") == "row", 1).when(F.col("level") == "total", 2).otherwise(3)
    o = outcomes.withColumn("_id", F.explode(F.array_distinct(F.array_compact(F.array("gold_id", "actual_id"))))).withColumn("_rank", rank)
    hit = f.join(o, ["document_id", "_id"]).where((F.col("_level") == "") | (F.col("_level") == F.col("level")))
    best = hit.groupBy("document_id", "failure_id").agg(F.min(F.struct("_rank", "n", "status")).alias("_b"), F.min_by("level", F.struct("_rank", "n", "status")).alias("level"))
    return failures.join(best.select("document_id", "failure_id", "level", F.col("_b.status").alias("status")), ["document_id", "failure_id"], "left")


# Words that accept a source.
ACCEPTED = ("eligible", "accepted", "include")


def eligibility(eligible: Column, status: Column, synthetic: Column, duplicate: Column, duplicate_of: Column, names_duplicate: Column) -> Column:
    """Why a source may not enter, or null: every decision has to be there in words."""
    return (
        F.when(eligible.isNull(), "eligible_missing").when(~eligible, "not_eligible").when(status.isNotNull() & ~F.lower(status).isin(*ACCEPTED), "status_not_accepted")
        .when(synthetic.isNull(), "synthetic_missing").when(synthetic, "synthetic").when(duplicate.isNull() & ~names_duplicate, "duplicate_missing")
        .when(duplicate_of.isNotNull() & ~F.regexp_replace(duplicate_of, "^sha256:", "").rlike("^[0-9a-f]{64}$"), "duplicate_of_invalid").when(duplicate | duplicate_of.isNotNull(), "duplicate")
    )


def promotion(passed: Column, challenger_f1: Column, local_f1: Column, unseen: list[Column], ungrounded: Column, privacy: Column) -> Column:
    """Whether a challenger replaces the local model; anything unknown says no."""
    ok = passed & (challenger_f1 > local_f1) & (challenger_f1 >= 0.9) & (F.least(*unseen) >= 0.85) & (ungrounded == 0) & (F.coalesce(privacy, F.lit(0)) == 0)
    known = challenger_f1.isNotNull() & local_f1.isNotNull()
    for u in unseen:
        known = known & u.isNotNull()
    return F.coalesce(known & ok, F.lit(False))


def snapshot(rows: DataFrame, keys: list[str], sections: dict[str, list[str]], order: list[str]) -> DataFrame:
    """By key a SHA-256 for each section, of its columns in all rows: 128-bit digests of rows added up, so that order plays no part and no key is held in one task.

    order: columns that tell equal rows apart; rows that are the same all count.
    """
    sums = []
    for name, columns in sections.items():
        text = F.to_json(F.struct(*[F.col(c) for c in columns], *[F.col(c).alias(f"_{c}") for c in order]), {"ignoreNullFields": "false"})
        for part in (1, 17):
            sums.append(F.sum(F.conv(F.substring(F.sha2(text, 256), part, 12), 16, 10).cast("decimal(38,0)")).alias(f"_{name}{part}"))
    added = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return added.select(*keys, "rows", *[F.sha2(F.concat_ws(":", f"_{n}1", f"_{n}17", F.col("rows").cast("string")), 256).alias(f"{n}_sha256") for n in sections])


def same_or_better(baseline: DataFrame, challenger: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Measures (measure, value) of both sides, and whether each is no worse; a measure that one side lacks fails."""
    x = baseline.select("measure", F.col("value").alias("before")).join(challenger.select("measure", F.col("value").alias("after")), "measure", "full_outer")
    falls = F.col("measure").isin(*lower_is_better) if lower_is_better else F.lit(False)
    return x.withColumn("passed", F.coalesce(F.when(falls, F.col("after") <= F.col("before")).otherwise(F.col("after") >= F.col("before")), F.lit(False)))


def sealed(files: DataFrame) -> DataFrame:
    """A workspace's inventory (path, size, sha256) with names of what forbids sealing: no digest, twice listed, empty."""
    n = files.groupBy("path").agg(F.count(F.lit(1)).alias("listed"), F.max("size").alias("size"), F.count_distinct("sha256").alias("digests"), F.min("sha256").alias("sha256"))
    fault = F.when(F.col("digests") == 0, "no_digest").when(F.col("digests") > 1, "digests_differ").when(F.col("size") <= 0, "empty").when(F.col("listed") > 1, "listed_twice")
    return n.select("path", "size", "sha256", fault.alias("fault"))
