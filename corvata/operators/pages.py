"""Pages without tables, what a page's picture says of it, anchors by place, and dense distortion grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.dates import FRAGMENT
from corvata.functions.money import parse_decimal

# Words of forms that ask for, prove or return money.
LABELS = ("amount", "bill no", "date", "invoice no", "payment", "receipt no", "receipt book", "reservation receipt", "distribution receipt", "charges towards", "payment received")
RECEIPTS = ("receipt", "amount received", "charges towards", "payment received", "bill no", "invoice no")
BILLABLE = ("charge", "charges towards", "invoice", "bill amount")
NOT_BILLABLE = ("advance received", "deposit received", "amount refunded", "refund issued", "settlement")
EVIDENCE = ("amount", "bill", "charge", "date", "deposit", "invoice", "payment", "receipt", "reference", "settlement")
CURRENCY = r"(?:₹|\brs\.?\s*)\d|\d[\d,]*\.\d{2}\b"
REFERENCE = r"\b(?:receipt|invoice|bill|reference|ref)\s*(?:no|number|#)"


def _one_of(t: Column, words: tuple[str, ...]) -> Column:
    hit = F.contains(t, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(t, F.lit(w))
    return hit


def form_text(c: Column) -> Column:
    """Lower case, with letters, digits and the signs of money, dates and references."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9₹./:-]+", " "))


def needs_recovery(text: Column) -> Column:
    """Whether a page without tables reads like a form with money; of form_text."""
    return _one_of(text, LABELS) & text.rlike("[0-9]")


def page_tokens(tokens: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """By page: text of all tokens in order, and the ids of those that classify a form."""
    low = F.lower(F.col("text"))
    tells = (F.trim("text") != "") & (parse_decimal(F.col("text")).isNotNull() | _one_of(low, EVIDENCE))
    rank = F.struct(*order, "token_id", "text", tells.alias("tells"))
    g = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(rank)).alias("_t"))
    return g.select(*keys, form_text(F.array_join(F.transform("_t", lambda x: x["text"]), " ")).alias("text"), F.transform(F.filter("_t", lambda x: x["tells"]), lambda x: x["token_id"]).alias("evidence"))


def no_table_page(text: Column, stddev: Column, foreground: Column, lines: Column) -> Column:
    """STRUCT(blank, suspected, classification, signals) of a page's form_text and three numbers of its picture; a picture that can't be read has none."""
    unreadable = stddev.isNull()
    blank = ~text.rlike("[a-z0-9]") & (stddev < 2) & (foreground < 0.001)
    money = text.rlike(CURRENCY)
    drawn = (lines >= 3) & (foreground >= 0.002)
    signals = F.array_compact(F.array(F.when(needs_recovery(text), "financial_ocr_text"), F.when(money, "currency_geometry"), F.when(_one_of(text, RECEIPTS), "financial_form_language"), F.when(drawn, "form_line_structure")))
    suspected = ~blank & ((money & ((F.size(signals) > 0) | text.rlike(REFERENCE) | text.rlike(FRAGMENT))) | drawn)
    kind = F.when(blank, "blank").when(suspected & _one_of(text, NOT_BILLABLE) & ~_one_of(text, BILLABLE), "recognized_nonbillable").when(suspected, "unresolved").otherwise("nonfinancial")
    return F.struct(
        (~unreadable & blank).alias("blank"), F.when(unreadable, needs_recovery(text)).otherwise(suspected).alias("suspected"),
        F.when(unreadable, "unresolved").otherwise(kind).alias("classification"), F.when(unreadable, F.array(F.lit("image_unreadable"))).otherwise(signals).alias("signals"),
    )


def quality_flags(mean: Column, contrast: Column, laplacian: Column, edges: Column, skew: Column) -> Column:
    """Names of what is wrong with a page's picture, in order of report."""
    return F.array_compact(F.array(
        F.lit("orientation_unverified"), F.when(laplacian < 50, "blur"), F.when(contrast < 25, "low_contrast"), F.when(mean < 40, "underexposed"),
        F.when(mean > 245, "overexposed"), F.when(edges < 0.005, "low_edge_density"), F.when(F.abs(skew) > 0.5, "skewed"),
    ))


def anchors(things: DataFrame, keys: list[str]) -> DataFrame:
    """Number things from 0 down each page by the left, top, right and bottom of their box; one without a box counts as at the origin."""
    at = [F.coalesce(F.col(f"box.{c}"), F.lit(0.0)) for c in "ltrb"]
    return things.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*keys).orderBy(*at, "thing_id")) - 1).cast("int"))


def grid_diagnostics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of dense grids (keys, i, j, x, y: where cell i, j is mapped to): mean, largest and 95th percentile displacement, and Jacobian determinants.

    Derivatives are differences to the next cell; the last row and column have none. Windows run along
    rows and columns of a grid, so no grid is held in one task.
    """
    moved = F.hypot(F.col("x") - F.col("j"), F.col("y") - F.col("i"))
    right, down = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")
    d = lambda c, w: F.lead(c).over(w) - F.col(c)
    state = points.select(*keys, moved.alias("moved"), (d("x", right) * d("y", down) - d("x", down) * d("y", right)).alias("jacobian"))
    return state.groupBy(*keys).agg(
        F.avg("moved").alias("mean_shift"), F.max("moved").alias("largest_shift"), F.percentile("moved", F.lit(0.95)).alias("p95_shift"),
        F.min("jacobian").alias("least_jacobian"), F.percentile("jacobian", F.lit(0.05)).alias("p5_jacobian"), F.count_if(F.col("jacobian") <= 0).alias("folded"),
    )
