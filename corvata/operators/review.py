"""Review: overlay of corrections, search and pages, blockers, exports, alias preview, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.fields import safe_cell
from corvata.operators.ledger import ITEM_ROLES


def overlay(machine: DataFrame, overrides: DataFrame, added: DataFrame, fields: list[str]) -> DataFrame:
    """Machine rows with each field replaced where an override names it, and rows that reviewers added.

    overrides: document_id, row_id, changes MAP<STRING,STRING>; a key that is present overrides, even with
    null. source tells machine from reviewer, modified what changed. Sort by (page, row_order, row_id).
    """
    o = overrides.select("document_id", "row_id", "changes")
    both = machine.join(o, ["document_id", "row_id"], "left")
    has = lambda f: F.coalesce(F.map_contains_key("changes", F.lit(f)), F.lit(False))
    types = dict(machine.dtypes)
    new = [F.when(has(f), F.try_element_at("changes", F.lit(f)).cast(types[f])).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [c for c in machine.columns if c not in fields]
    shown = both.select(*rest, *new, F.lit("machine").alias("source"), F.col("changes").isNotNull().alias("modified"))
    return shown.unionByName(added.select(*rest, *fields, F.lit("reviewer").alias("source"), F.lit(True).alias("modified")))


def latest(events: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Current state of append-only events: the last by revision."""
    w = Window.partitionBy(*keys).orderBy(F.desc(revision))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def matches(needle: str, *columns: Column) -> Column:
    """Substring in any column, without regard to case; never a pattern."""
    n = needle.lower().strip()
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n))
    return out


def page_of(rows: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0, anchor: Column | None = None) -> DataFrame:
    """A page of each key's rows with total, offset and has_more; an anchor row moves the page to where it stands."""
    w = Window.partitionBy(*keys)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    at = F.lit(offset) if anchor is None else F.max(F.when(anchor, F.expr(f"_i div {limit} * {limit}"))).over(w)
    x = x.withColumn("offset", at.cast("long"))
    return x.where((F.col("_i") >= F.col("offset")) & (F.col("_i") < F.col("offset") + limit)).withColumn("has_more", F.col("offset") + limit < F.col("total")).drop("_i")


def summary(rows: DataFrame) -> DataFrame:
    """By document: total, active, modified and pending rows."""
    count = lambda c: F.count_if(c)
    active = F.col("disposition") != "rejected"
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), count(active).alias("active"), count(F.col("modified")).alias("modified"), count(active & (F.col("disposition") == "pending")).alias("pending"))


def blockers(rows: DataFrame) -> DataFrame:
    """By document, the sorted names of what keeps it from approval, as far as its rows tell.

    rows: document_id, role, disposition, description, cents, evidence ARRAY<STRING> of field names.
    """
    live = rows.where("disposition <> 'rejected'")
    item = F.col("role").isin(*ITEM_ROLES)
    info = F.col("role") == "informational"
    blank = F.coalesce(F.col("description"), F.lit("")) == ""
    lacks = lambda *names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.col("evidence"))) > 0
    typed = F.arrays_overlap("evidence", F.array(*[F.lit(x) for x in ("service_date", "request_no", "service_code", "hsn_code")]))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = live.groupBy("document_id").agg(
        some(item).alias("items"), some(F.col("disposition") != "accepted").alias("pending"), some(item & (blank | F.col("cents").isNull())).alias("values"),
        some(item & lacks("description", "amount")).alias("evidence"), some(info & (blank | lacks("description") | ~typed)).alias("informational"),
    )
    documents = rows.select("document_id").distinct().join(found, "document_id", "left")
    names = F.array_compact(F.array(
        F.when(~F.coalesce("items", F.lit(False)), "no_active_rows"), F.when(F.col("pending"), "pending_rows"), F.when(F.col("values"), "missing_required_values"),
        F.when(F.col("evidence"), "missing_field_evidence"), F.when(F.col("informational"), "missing_informational_evidence"),
    ))
    return documents.select("document_id", F.array_join(F.array_sort(names), ",").alias("blockers"))


def export_rows(rows: DataFrame, text_fields: list[str], number_fields: list[str]) -> DataFrame:
    """Accepted rows for a spreadsheet: texts made safe, numbers as they are."""
    return rows.where("disposition = 'accepted'").select("document_id", "row_id", *[safe_cell(F.col(f)).alias(f) for f in text_fields], *number_fields)


def alias_preview(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Each printed cell under a new alias, classified: unlinked, invalid, fillable, unchanged or conflicting.

    cells: document_id, cell_id, row_id or null, parsed or null; rows: document_id, row_id, current or null.
    """
    both = cells.join(rows.select("document_id", "row_id", "current"), ["document_id", "row_id"], "left")
    known = F.col("row_id").isNotNull()
    kind = F.when(~known, "unlinked").when(F.col("parsed").isNull(), "invalid").when(F.col("current").isNull() | (F.col("current") == ""), "fillable").when(F.col("current") == F.col("parsed"), "unchanged").otherwise("conflicting")
    return both.select("document_id", "cell_id", kind.alias("classification"))


def classification_counts(preview: DataFrame) -> DataFrame:
    """By document, how many of each class, zeros filled in."""
    kinds = ["unlinked", "invalid", "fillable", "unchanged", "conflicting"]
    return preview.groupBy("document_id").agg(*[F.count_if(F.col("classification") == k).alias(k) for k in kinds])


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each reviewed old row with its new row: evidence overlap outranks an equal amount; a tie for best maps nothing.

    Both: document_id, page, row_id, tokens ARRAY<STRING>, cents, quantity, text (normalised). An equal
    amount counts with an equal text or an equal quantity.
    """
    o, n = old.alias("o"), new.alias("n")
    pairs = o.join(n, (F.col("o.document_id") == F.col("n.document_id")) & (F.col("o.page") == F.col("n.page")))
    shared = F.size(F.array_intersect("o.tokens", "n.tokens"))
    same = F.col("o.cents").eqNullSafe(F.col("n.cents")) & ((F.col("o.text") == F.col("n.text")) | F.col("o.quantity").eqNullSafe(F.col("n.quantity")))
    tier = F.when(shared > 0, 2).when(same, 1).otherwise(0)
    pairs = pairs.select(F.col("o.document_id").alias("document_id"), F.col("o.row_id").alias("old_id"), F.col("n.row_id").alias("new_id"), tier.alias("tier"), shared.alias("shared"), (F.col("o.text") == F.col("n.text")).cast("int").alias("same_text")).where("tier > 0")
    best = Window.partitionBy("document_id", "old_id").orderBy(F.desc("tier"), F.desc("shared"), F.desc("same_text"))
    top = pairs.withColumn("_r", F.rank().over(best)).where("_r = 1")
    return top.groupBy("document_id", "old_id").agg(F.count(F.lit(1)).alias("n"), F.min("new_id").alias("new_id")).select("document_id", "old_id", F.when(F.col("n") == 1, F.col("new_id")).alias("new_id"))
