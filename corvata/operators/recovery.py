"""When to read a table again, and whether the new reading may replace the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvata.operators.grouped import by_group
from corvata.operators.ledger import DEFECTS, GAPS

# Stages of recovery, in order; kinds of tables that hold no charges.
STAGES = ("high_resolution", "photometric", "crop_ocr", "local_vlm")
TERMINAL = ("metadata", "payment")


def low_yield(rows: Column, lines: Column) -> Column:
    return rows.between(1, 2) & (lines >= 12) & (rows / lines < 0.2)


def _flag_names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def routing(tables: DataFrame, hosted: bool = False) -> DataFrame:
    """(document_id, table_id, route, reasons, stages) from rows, lines, table_type, has_schema, flags ARRAY, truncated, profile_key, profile_selected."""
    terminal = F.col("table_type").isin(*TERMINAL)
    known = F.col("profile_key").isNotNull()
    bad = F.arrays_overlap("flags", _flag_names(DEFECTS + GAPS))
    names = F.when(terminal, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(F.col("rows") == 0, "zero_yield").when(low_yield(F.col("rows"), F.col("lines")), "low_yield"), F.when(bad, "validation_failure"), F.when(~F.col("has_schema"), "no_schema"),
        F.when(F.col("table_type") == "unknown", "unknown_table"), F.when(F.col("truncated"), "vlm_truncated"), F.when(known & ~F.col("profile_selected"), "profile_ambiguous"),
    )))
    x = tables.withColumn("reasons", names)
    some = F.size("reasons") > 0
    plan = _flag_names(STAGES + (("hosted_model",) if hosted else ()) + ("review",))
    fast = F.coalesce(known & F.col("profile_selected"), F.lit(False))
    route = F.when(some & (~fast | F.array_contains("reasons", "validation_failure")), "local_recovery").when(fast, "profile_fast").otherwise("local_ocr")
    return x.select("document_id", "table_id", route.alias("route"), F.array_join("reasons", ",").alias("reasons"), F.array_join(F.when(some, plan).otherwise(F.array().cast("array<string>")), ",").alias("stages"))


def quality_tuple(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By reading, its quality as a struct that compares field by field: fewer mismatches, more rows, fewer gaps, more mapped fields, more cells, more grounded rows, more printed rows.

    rows: keys, publishable, grounded, flags ARRAY, mapped, cells INT.
    """
    count = lambda names: F.size(F.filter("flags", lambda f: f.isin(*names)))
    ok = F.col("publishable")
    g = rows.groupBy(*keys).agg(F.sum(count(DEFECTS)).alias("mismatch"), F.count_if(ok).alias("published"), F.sum(count(GAPS)).alias("gaps"), F.sum(F.when(ok, F.col("mapped")).otherwise(0)).alias("mapped"), F.sum("cells").alias("cells"), F.count_if(ok & F.col("grounded")).alias("grounded"), F.count(F.lit(1)).alias("printed"))
    return g.select(*keys, F.struct((-F.col("mismatch")).alias("a"), F.col("published").alias("b"), (-F.col("gaps")).alias("c"), F.col("mapped").alias("d"), F.col("cells").alias("e"), F.col("grounded").alias("f"), F.col("printed").alias("g")).alias("quality"))


def unique_mapping(scores: list[list[tuple | None]]) -> list[int] | None:
    """Places of all rows in order among the candidates, with the greatest summed score; None if there is none, or several of that score."""
    n, m = len(scores), len(scores[0]) if scores else 0
    if n == 0:
        return []
    best: list[list[tuple | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    best[n] = [((), 1, ())] * (m + 1)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            top = best[i][j + 1]
            s, rest = scores[i][j], best[i + 1][j + 1]
            if s is not None and rest is not None:
                total = tuple(a + b for a, b in zip(s, rest[0] or (0,) * len(s), strict=True))
                if top is None or total > top[0]:
                    top = (total, rest[1], (j, *rest[2]))
                elif total == top[0]:
                    top = (total, min(2, top[1] + rest[1]), (j, *rest[2]))
            best[i][j] = top
    found = best[0][0]
    return list(found[2]) if found is not None and found[1] == 1 else None


def mapped_rows(pairs: DataFrame) -> DataFrame:
    """Old rows with their new rows, for tables whose every old row maps in order and in one way only.

    pairs: document_id, table_id, old, new, n_old, n_new and the score's parts s0, s1, ... as integers.
    """
    parts = sorted(c for c in pairs.columns if c[0] == "s" and c[1:].isdigit())

    def table(rows: list) -> list[tuple]:
        n, m = rows[0].n_old, rows[0].n_new
        scores: list[list[tuple | None]] = [[None] * m for _ in range(n)]
        for r in rows:
            scores[r.old][r.new] = tuple(getattr(r, p) for p in parts)
        got = unique_mapping(scores) if n <= m else None
        return [(rows[0].document_id, rows[0].table_id, i, j) for i, j in enumerate(got or [])]

    return by_group(pairs, ["document_id", "table_id"], ["old", "new"], table, "document_id long, table_id string, old int, new int")


def safe_improvement(old: DataFrame, new: DataFrame, matched: DataFrame) -> DataFrame:
    """By table whether the new reading may replace the old: same type, as many rows, all mapped, no new defects, coverage kept, quality up.

    old and new: document_id, table_id, table_type, published, mapped, quality; matched: document_id,
    table_id, pairs, worse (pairs with a new defect or a lost value), stray (new rows with a defect).
    """
    keys = ["document_id", "table_id"]
    o, n = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("table_type", "published", "mapped", "quality")]), new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("table_type", "published", "mapped", "quality")])
    x = o.join(n, keys).join(matched, keys, "left")
    same = ~F.col("n_table_type").isin(*TERMINAL) & ((F.col("o_table_type") == "unknown") | (F.col("o_table_type") == F.col("n_table_type")))
    whole = (F.col("n_published") >= F.col("o_published")) & (F.coalesce("pairs", F.lit(0)) == F.col("o_published"))
    clean = (F.coalesce("worse", F.lit(0)) == 0) & (F.coalesce("stray", F.lit(0)) == 0)
    return x.select(*keys, (same & whole & clean & (F.col("n_mapped") >= F.col("o_mapped")) & (F.col("n_quality") > F.col("o_quality"))).alias("safe"))


def grounded(answers: DataFrame, tokens: DataFrame, allowed: tuple[str, ...], tolerance: float = 0.1) -> DataFrame:
    """Each answered field with the reason it is refused, or null.

    answers: document_id, row_order, field, raw_value, token_ids ARRAY, box, crop_width, crop_height,
    centre (of the field's column, or null); tokens: document_id, token_id, text, box. The first reason
    in order counts: unknown field, unknown token, out of crop, polygon off its tokens, column off, value
    that no token shows.
    """
    keys = ["document_id", "row_order", "field"]
    found = answers.select(*keys, F.explode_outer("token_ids").alias("token_id"), F.col("box").alias("_box"), "raw_value").join(tokens.select("document_id", "token_id", "text", F.col("box").alias("_token")), ["document_id", "token_id"], "left")
    touch = (F.least("_box.r", "_token.r") > F.greatest("_box.l", "_token.l")) & (F.least("_box.b", "_token.b") > F.greatest("_box.t", "_token.t"))
    shows = F.contains(F.lower("text"), F.lower("raw_value"))
    seen = found.groupBy(*keys).agg(F.bool_or(F.col("token_id").isNotNull() & F.col("text").isNull()).alias("unknown"), F.bool_or(F.coalesce(touch, F.lit(False))).alias("touch"), F.bool_or(F.coalesce(shows, F.lit(False))).alias("shows"))
    out = (F.col("box.l") < 0) | (F.col("box.t") < 0) | (F.col("box.r") > F.col("crop_width")) | (F.col("box.b") > F.col("crop_height"))
    off = F.abs((F.col("box.l") + F.col("box.r")) / 2 / F.greatest(F.lit(1), F.col("crop_width")) - F.col("centre")) > tolerance
    reason = F.when(~F.col("field").isin(*allowed), "unknown_field").when(F.col("unknown"), "unknown_token").when(out, "out_of_crop").when(~F.col("touch"), "polygon_token_mismatch").when(off, "column_mismatch").when(~F.col("shows"), "unsupported_value")
    return answers.join(seen, keys).select(*keys, reason.alias("reason"))


def unlike(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two readings has, as (side, columns): a multiset difference both ways."""
    a, b = old.select(*columns), new.select(*columns)
    return a.exceptAll(b).select(F.lit("old").alias("side"), *columns).unionByName(b.exceptAll(a).select(F.lit("new").alias("side"), *columns))
