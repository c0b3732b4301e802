"""Printed document totals: labelled lines, contexts, and the one primary total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.text import plain

# Labels of totals as (term, label, priority, kind, scope, needs a summary around it). The first that a line holds counts.
LABELS = (
    ("total bill amount", "Total Bill Amount", 100, "bill_total", "document", False),
    ("net bill amount", "Net Bill Amount", 98, "bill_total", "document", False),
    ("net medical amount", "Net Medical Amount", 97, "bill_total", "document", False),
    ("final bill amount", "Final Bill Amount", 96, "bill_total", "document", False),
    ("total gross bill value", "Total Gross Bill Value", 94, "bill_total", "document", False),
    ("net amount incl tax", "Net Amount (Incl. Tax)", 90, "bill_total", "document", True),
    ("net amount ind tax", "Net Amount (Incl. Tax)", 90, "bill_total", "document", True),
    ("grand total", "Grand Total", 86, "bill_total", "document", False),
    ("total payable amount", "Total Payable Amount", 76, "payable_total", "settlement", True),
    ("net patient payable amount", "Net Patient Payable Amount", 74, "payable_total", "settlement", True),
    ("net patient payable amt", "Net Patient Payable Amount", 74, "payable_total", "settlement", True),
    ("net payable", "Net Payable", 72, "payable_total", "settlement", True),
    ("total amount", "Total Amount", 66, "bill_total", "document", True),
    ("gross amount", "Gross Amount", 64, "gross_total", "document", True),
    ("net amount", "Net Amount", 62, "bill_total", "document", True),
    ("amount to be received", "Amount To Be Received", 40, "settlement_total", "payment", True),
    ("amount to be recelved", "Amount To Be Received", 40, "settlement_total", "payment", True),
    ("amount to be receive", "Amount To Be Received", 40, "settlement_total", "payment", True),
)
# Words that rule a line out, that make a summary, and that name a context.
EXCLUDED = ("discount", "rounding", "cgst", "sgst", "igst", "tax amount", "advance", "deposit", "amount paid", "amount refunded", "balance due", "receipt", "refund")
NOT_TOTALS = ("total for", "sub total", "subtotal", "patient grand total", "company grand total", "payer grand total")
SUMMARY = ("gross amount", "net amount", "total amount", "total payable", "net payable", "amount to be received", "amount to be recelved", "advance amount", "paid amount", "balance amount", "roundoff amount", "round off amount")
PHARMACY = ("pharmacy", "medicine", "drug", "batch", "expiry", "mrp")
RECEIPT = ("receipt", "charges towards", "collection")
CATEGORY = ("category summary", "package summary", "charge summary")
SETTLEMENT = ("settlement", "claim approved", "tpa amount")


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def label(text: Column) -> Column:
    """Struct (label, priority, kind, scope, needs_summary) of a line's text, or null."""
    t = plain(text)
    out = None
    for term, shown, priority, kind, scope, needs in LABELS:
        spec = F.struct(F.lit(shown).alias("label"), F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), F.lit(needs).alias("needs_summary"))
        out = F.when(t.contains(term), spec) if out is None else out.when(t.contains(term), spec)
    barred = any_of(t, EXCLUDED)
    for p in NOT_TOTALS:
        barred = barred | t.startswith(p)
    return F.when(~barred, out)


def has_summary(window_text: Column) -> Column:
    """At least two summary terms stand around."""
    t = plain(window_text)
    return sum((t.contains(s).cast("int") for s in SUMMARY[1:]), t.contains(SUMMARY[0]).cast("int")) >= 2


def context_kind(table_type: Column, local_text: Column, scope: Column) -> Column:
    t = plain(local_text)
    return (
        F.when(table_type == "payment", "payment").when((table_type == "pharmacy") | any_of(t, PHARMACY), "pharmacy").when(any_of(t, RECEIPT), "receipt")
        .when(table_type.isin("category_summary", "package_summary") | any_of(t, CATEGORY), "category").when((scope == "settlement") | any_of(t, SETTLEMENT), "settlement").when(scope == "payment", "payment").otherwise("document_final")
    )


def candidates(lines: DataFrame) -> DataFrame:
    """Totals from lines (document_id, page, line, text, cents of the rightmost amount or null, confidence, top): one by labelled line with an amount of its own or on the next line.

    Columns: document_id, page, line, label, priority, kind, scope, cents, confidence, top, local_text.
    """
    w = Window.partitionBy("document_id", "page").orderBy("line")
    x = lines.withColumn("spec", label(F.col("text"))).withColumn("local_text", F.array_join(F.collect_list("text").over(w.rowsBetween(-5, 3)), " ")).withColumn("around", F.array_join(F.collect_list("text").over(w.rowsBetween(-5, 5)), " "))
    bare = ~F.lead("text").over(w).rlike("[A-Za-z]") & F.lead("spec").over(w).isNull()
    x = x.withColumn("amount", F.coalesce("cents", F.when(bare, F.lead("cents").over(w))))
    x = x.where("spec is not null and amount is not null").where(~F.col("spec.needs_summary") | has_summary(F.col("around")))
    return x.select("document_id", "page", "line", "spec.label", "spec.priority", "spec.kind", "spec.scope", F.col("amount").alias("cents"), "confidence", "top", "local_text")


def primary(found: DataFrame) -> DataFrame:
    """By document with exactly one final context: its best total by priority, amount, confidence, page and place."""
    final = found.where("scope = 'document' and context_kind = 'document_final' and context_id is not null")
    rank = F.struct("priority", F.abs("cents").alias("size"), "confidence", "page", "top", "line", "cents", "label")
    best = final.groupBy("document_id").agg(F.count_distinct("context_id").alias("n"), F.max(rank).alias("best")).where("n = 1")
    return best.select("document_id", "best.label", "best.cents", "best.page")


def distinct_totals(found: DataFrame) -> DataFrame:
    """The first of each (page, label, amount, kind, scope) of a document, from top to bottom."""
    w = Window.partitionBy("document_id", "page", "label", "cents", "kind", "scope").orderBy("top", F.desc("priority"), "line")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
