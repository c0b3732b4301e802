"""Ledger operators: roles, flags, policy, dedupe, order, reconciliation.

Rows have document_id, page, table_id, row_order, row_id, description, section, role and amounts in
cents, as far as an operator names them. All are narrow, or shuffle once on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.text import plain

# Roles that count into a bill's items.
ITEM_ROLES = ("detail", "refund", "category_rollup")
#: Signs in a row's text, in order of precedence.
ROLE_SIGNS = (
    ("refund", ("refund", "credit note", "return")),
    ("payment", ("advance received", "payment mode", "receipt ref")),
    ("deposit", ("deposit", "advance deposit")),
    ("document_total", ("grand total", "net bill amount", "total bill amount")),
)


def row_role(text: Column, description: Column) -> Column:
    """Role of a printed row: refund, payment, deposit, document total, section total, else detail."""
    t, d = plain(text), plain(description)
    out = None
    for role, signs in ROLE_SIGNS:
        hit = F.lit(False)
        for s in signs:
            hit = hit | t.contains(s)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    total = d.isin("discount", "discounts", "total") | d.startswith("sub total") | d.startswith("subtotal")
    return out.when(total, "section_total").otherwise("detail")


def charge_policy(rows: DataFrame) -> DataFrame:
    """Keep the finest charges: a category rollup goes if it is zero, its section has items, or an item equals it in text and amount.

    Anti joins on the document and the section, or text and amount; null amounts equal null amounts.
    """
    key = plain(F.col("description"))
    items = rows.where(F.col("role").isin("detail", "refund"))
    sections = items.where("section is not null and section <> ''").select(F.col("document_id").alias("_d"), F.col("section").alias("_s")).distinct()
    equal = items.select(F.col("document_id").alias("_d"), key.alias("_k"), F.col("cents").alias("_c")).distinct()
    rollup = rows.where(F.col("role") == "category_rollup")
    kept = rollup.where("cents is null or cents <> 0")
    kept = kept.join(sections, (F.col("document_id") == F.col("_d")) & (F.col("section") == F.col("_s")), "left_anti")
    kept = kept.join(equal, (F.col("document_id") == F.col("_d")) & (key == F.col("_k")) & F.col("cents").eqNullSafe(F.col("_c")), "left_anti")
    both = rows.where("role is null or role <> 'category_rollup'").unionByName(kept)
    order = Window.partitionBy("document_id").orderBy("row_order", "row_id")
    return both.withColumn("row_order", (F.row_number().over(order) - 1).cast("int"))


def occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the repeats of a key from 0 in input order, as occurrence."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def best_rows(rows: DataFrame, keys: list[str], better: list[Column], order: list[str]) -> DataFrame:
    """One row by key: the best by the columns given, the first in input order among equals."""
    w = Window.partitionBy(*keys).orderBy(*better, *order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


# Flags that make a table worth reading again.
DEFECTS = ("line_arithmetic_mismatch", "positive_amount_in_return_section")
GAPS = ("missing_labeled_quantity", "missing_labeled_unit_price")


def row_flags(role: Column, quantity: Column, rate: Column, gross: Column, discount: Column, amount: Column, description: Column, in_return_section: Column, derived: Column, has_quantity: Column, has_rate: Column, has_tax: Column) -> Column:
    """Names of what is wrong with a row, in order of report; amounts in cents.

    quantity times rate proves the amount if both are known, else the gross amount does, each less the
    discount; a refund is proved by its size. Tables with tax columns are not held to arithmetic.
    """
    off = F.coalesce(discount, F.lit(0))
    proof = F.when(quantity.isNotNull() & rate.isNotNull(), quantity * rate - off).when(gross.isNotNull(), gross - off)
    seen = F.when((role == "refund") & (amount < 0) & (proof >= 0), F.abs(amount)).otherwise(amount)
    return F.array_compact(F.array(
        F.when(in_return_section & (amount > 0) & (role == "detail"), "positive_amount_in_return_section"), F.when(F.trim(F.coalesce(description, F.lit(""))) == "", "missing_printed_description"),
        F.when(derived, "quantity_derived_from_rate_amount"), F.when(has_quantity & quantity.isNull(), "missing_labeled_quantity"), F.when(has_rate & rate.isNull(), "missing_labeled_unit_price"),
        F.when(~has_tax & (F.abs(proof - seen) > 1), "line_arithmetic_mismatch"),
    ))


# What an amount line calls a payment.
PAYMENTS = ("advance", "ip advance", "deposit")
PAYMENT_SIGNS = ("advance received", "amount received", "amount refunded", "payment mode", "receipt ref")


def charge_role(description: Column, is_metadata: Column, table_type: Column, amount: Column) -> Column:
    """Role of a read charge: unresolved, payment, rollup in summaries, refund if negative, else detail."""
    d = plain(description)
    paid = d.isin(*PAYMENTS) | (table_type == "payment")
    for s in PAYMENT_SIGNS:
        paid = paid | d.contains(s)
    return F.when(is_metadata, "unresolved").when(paid, "payment").when(table_type == "metadata", "unresolved").when(table_type.isin("category_summary", "package_summary"), "category_rollup").when(amount < 0, "refund").otherwise("detail")


def derived_quantity(amount: Column, discount: Column, rate: Column, most: int = 100_000) -> Column:
    """The whole number of units that explains an amount exactly, or null."""
    total = F.abs(amount) + F.coalesce(discount, F.lit(0))
    return F.when((rate > 0) & (total > 0) & (total % rate == 0) & (total / rate <= most), (total / rate).cast("long"))


def publishable(role: Column, evidence: Column, description: Column, amount: Column) -> Column:
    """Whether a row may be published: described with evidence, and an amount (or for informational rows a typed field) with evidence."""
    has = lambda k: F.coalesce(F.map_contains_key(evidence, F.lit(k)), F.lit(False))
    typed = has("service_date") | has("request_no") | has("service_code") | has("hsn_code")
    described = (F.trim(F.coalesce(description, F.lit(""))) != "") & has("description")
    return described & F.when(role == "informational", typed).otherwise(role.isin(*ITEM_ROLES) & amount.isNotNull() & has("amount"))


def reconcile(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """By document: item total against printed totals, and how they compare.

    rows: document_id, role, cents, rejected (optional); printed: document_id, total_cents. Columns:
    items_cents, missing, bill_cents, difference_cents, comparison. Rows that lack an amount make the
    comparison partial; no printed total, or several different ones, are states of their own. Where
    only rollups are left and one of them equals the bill, the bill is the total.
    """
    live = rows.where(F.col("role").isin(*ITEM_ROLES))
    if "rejected" in rows.columns:
        live = live.where(~F.col("rejected"))
    totals = printed.groupBy("document_id").agg(F.count_distinct("total_cents").alias("n_totals"), F.min("total_cents").alias("bill_cents"))
    rollups = F.array_distinct(F.collect_list(F.when(F.col("role") == "category_rollup", F.col("cents"))))
    sums = live.groupBy("document_id").agg(
        F.coalesce(F.sum("cents"), F.lit(0)).alias("items_cents"), F.sum(F.when(F.col("cents").isNull(), 1).otherwise(0)).alias("missing"),
        F.max((F.col("role") != "category_rollup").cast("int")).alias("fine"), rollups.alias("rollups"),
    )
    both = sums.join(totals, "document_id", "full_outer")
    package = (F.col("fine") == 0) & F.array_contains("rollups", F.col("bill_cents"))
    items = F.when(package, F.col("bill_cents")).otherwise(F.coalesce("items_cents", F.lit(0)))
    missing = F.when(package, 0).otherwise(F.coalesce("missing", F.lit(0)))
    difference = F.when((missing == 0) & (F.col("n_totals") == 1), items - F.col("bill_cents"))
    comparison = F.when(missing > 0, "items_partial").when(F.col("bill_cents").isNull(), "bill_total_missing").when(F.col("n_totals") > 1, "multiple_printed_totals").when(F.abs(difference) <= 1, "match").otherwise("mismatch")
    return both.select("document_id", items.alias("items_cents"), missing.cast("long").alias("missing"), "bill_cents", difference.alias("difference_cents"), comparison.alias("comparison"))


def receipt_duplicates(rows: DataFrame) -> DataFrame:
    """Pairs of a receipt row and a row of equal issuer that may be one charge: equal reference, or equal dated amount and text within a page.

    rows: document_id, row_id, page, is_receipt, issuer, reference, cents, service_date, description.
    Each unordered pair comes once, with its basis, the reference if both hold. Of a pair of receipts
    only the first in input order is flagged; ``flagged`` names it. Equi-joins on the blocking keys.
    """
    r, o = rows.where("is_receipt").alias("r"), rows.alias("o")
    same = [F.col("r.document_id") == F.col("o.document_id"), F.col("r.issuer") == F.col("o.issuer"), F.col("r.row_id") != F.col("o.row_id"), F.col("r.issuer") != ""]
    by_ref = r.join(o, [*same, F.col("r.reference") == F.col("o.reference"), F.col("r.reference") != ""])
    near = (F.abs(F.col("r.page") - F.col("o.page")) <= 1) & (plain(F.col("r.description")) == plain(F.col("o.description")))
    by_amount = r.join(o, [*same, F.col("r.cents") == F.col("o.cents"), F.col("r.service_date") == F.col("o.service_date"), near])
    pick = lambda x, basis: x.select(F.col("r.document_id").alias("document_id"), F.least("r.row_id", "o.row_id").alias("left_id"), F.greatest("r.row_id", "o.row_id").alias("right_id"), F.when(F.col("o.is_receipt") & ((F.col("o.page") < F.col("r.page")) | ((F.col("o.page") == F.col("r.page")) & (F.col("o.row_id") < F.col("r.row_id")))), F.col("o.row_id")).otherwise(F.col("r.row_id")).alias("flagged"), F.lit(basis).alias("rank"))
    pairs = pick(by_ref, 0).unionByName(pick(by_amount, 1)).groupBy("document_id", "left_id", "right_id").agg(F.min("rank").alias("rank"), F.min("flagged").alias("flagged"))
    return pairs.select("document_id", "left_id", "right_id", "flagged", F.when(F.col("rank") == 0, "exact_reference").otherwise("dated_grounded_charge").alias("basis"))
