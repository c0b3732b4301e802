"""Data-quality rules over a ledger: each yields issues, their union is the report.

An issue is (document_id, code, severity, page, table_id, row_id). Severities: fatal fails a document,
blocking sends it to review, a warning passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvata.functions.money import parse_decimal, parse_quantity
from corvata.functions.text import fold
from corvata.operators.ledger import ITEM_ROLES

# Fields that hold amounts, a number as it may stand in a token, and what may stand beside it.
AMOUNTS = ("amount", "net_amount", "gross_amount", "discount", "rate", "unit_price", "quantity")
NUMBER = r"[-+]?(?:\(\s*)?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*\))?"
CURRENCY = r"₹|\brs\.?\b|\binr\b|\s"

#: Full-width signs and the spaces that are not ASCII, and what they stand for.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u3000", "".join(map(chr, range(0x21, 0x7F))) + "  "

RANK = {"fatal": 3, "blocking": 2, "warning": 1}


def _issue(rows: DataFrame, code: str, severity: str, where: Column) -> DataFrame:
    return rows.where(where).select("document_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "page", "table_id", "row_id")


def row_rules(rows: DataFrame) -> DataFrame:
    """Rules on single rows, in one pass: an array of issues by row, exploded.

    rows: document_id, page, table_id, row_id, role, description, cents, evidence ARRAY<STRING>,
    quantity, rate_cents, discount_cents, derived BOOLEAN.
    """
    item, info = F.col("role").isin(*ITEM_ROLES), F.col("role") == "informational"
    has = lambda n: F.array_contains("evidence", n)
    typed = F.arrays_overlap("evidence", F.array(*[F.lit(x) for x in ("service_date", "request_no", "service_code", "hsn_code")]))
    proof = F.col("quantity") * F.col("rate_cents") - F.coalesce("discount_cents", F.lit(0))
    rules = [
        ("canonical_row_contract_invalid", "fatal", F.col("role").isNull() | F.col("page").isNull() | (F.col("page") < 1)),
        ("canonical_row_anchor_missing", "fatal", F.col("table_id").isNull()),
        ("ungrounded_description", "blocking", (F.coalesce(F.col("description"), F.lit("")) != "") & ~has("description")),
        ("ungrounded_billable_amount", "blocking", item & F.col("cents").isNotNull() & ~has("amount")),
        ("informational_row_has_money", "blocking", info & F.col("cents").isNotNull()),
        ("informational_row_missing_typed_evidence", "blocking", info & ~typed),
        ("derived_quantity_provenance_invalid", "blocking", F.col("derived") & (F.abs(proof - F.abs("cents")) > 1)),
        ("unexpected_derived_quantity_provenance", "fatal", F.col("derived") & F.col("quantity").isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(w, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, w in rules]))
    return rows.select("document_id", "page", "table_id", "row_id", F.explode(found).alias("i")).select("document_id", "i.code", "i.severity", "page", "table_id", "row_id")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Each id that stands twice in a document, once."""
    twice = rows.groupBy("document_id", "row_id").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"), F.min("table_id").alias("table_id")).where("n > 1")
    return _issue(twice, "duplicate_canonical_row_id", "fatal", F.lit(True))


def link_rules(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Links of printed rows (document_id, page, table_id, row_id, linked_id, has_money) to canonical rows."""
    known = rows.select("document_id", F.col("row_id").alias("linked_id"))
    links = printed.where("linked_id is not null")
    unknown = _issue(links.join(known, ["document_id", "linked_id"], "left_anti"), "unknown_canonical_source_link", "fatal", F.lit(True))
    loose = _issue(printed, "unlinked_financial_source_row", "blocking", F.col("linked_id").isNull() & F.col("has_money"))
    double = links.groupBy("document_id", "linked_id").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"), F.min("table_id").alias("table_id"), F.min("row_id").alias("row_id")).where("n > 1")
    missing = rows.join(links.select("document_id", F.col("linked_id").alias("row_id")), ["document_id", "row_id"], "left_anti")
    return unknown.unionByName(loose).unionByName(_issue(double, "duplicate_canonical_source_link", "blocking", F.lit(True))).unionByName(_issue(missing, "canonical_source_link_missing", "blocking", F.lit(True)))


def supports(field: Column, value: Column, texts: Column) -> Column:
    """Whether the tokens named as evidence say the value: exactly one, of equal text, or for an amount of one number and currency signs alone.

    An empty value needs no evidence. Dates need equal text. Case, white space and full-width forms don't count.
    """
    told = lambda c: F.trim(F.regexp_replace(F.translate(fold(c), WIDE, NARROW), r"\s+", " "))
    want, seen = told(value), told(F.get(texts, F.lit(0)))
    numbers = F.regexp_extract_all(seen, F.lit(NUMBER), F.lit(0))
    one = F.get(numbers, F.lit(0))
    rest = F.regexp_replace(F.replace(seen, one, F.lit("")), CURRENCY, "")
    read = lambda c: F.when(field == "quantity", parse_quantity(c)).otherwise(parse_decimal(c))
    amount = field.isin(*AMOUNTS) & (F.size(numbers) == 1) & (rest == "") & (read(one) == read(value))
    return F.when(want == "", True).when(F.size(texts) != 1, False).otherwise((want == seen) | F.coalesce(amount, F.lit(False)))


def evidence_rules(evidence: DataFrame, tokens: DataFrame) -> DataFrame:
    """Evidence (document_id, page, table_id, row_id, field, value, token_id; a row for each token) that names no token, or tokens that don't say the value."""
    both = evidence.join(tokens.select("document_id", "token_id", F.col("text").alias("_text"), F.lit(True).alias("_known")), ["document_id", "token_id"], "left")
    missing = _issue(both, "evidence_token_missing", "fatal", F.col("_known").isNull())
    said = both.groupBy("document_id", "page", "table_id", "row_id", "field", "value").agg(F.collect_list(F.coalesce("_text", F.lit(""))).alias("_texts"), F.count("_known").alias("_n"))
    wrong = _issue(said, "canonical_evidence_value_mismatch", "blocking", (F.col("_n") == F.size("_texts")) & ~supports(F.col("field"), F.col("value"), F.col("_texts")))
    return missing.unionByName(wrong)


def _blank(rows: DataFrame) -> DataFrame:
    """Add the places that an issue about a whole document or page lacks."""
    kinds = {"page": "int", "table_id": "string", "row_id": "string"}
    return rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in rows.columns])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def total_rules(state: DataFrame) -> DataFrame:
    """Rules on a document's totals, from reconcile's result."""
    base = _blank(state.select("document_id", "comparison"))
    return _all([_issue(base, "document_total_unavailable", "warning", F.col("comparison") == "bill_total_missing"), _issue(base, "ambiguous_primary_total", "blocking", F.col("comparison") == "multiple_printed_totals"), _issue(base, "document_total_mismatch", "blocking", F.col("comparison") == "mismatch")])


def primary_total_rules(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """The chosen total of each document against its candidates.

    chosen: document_id, cents, label, scope, context_id; found: document_id, cents, label, scope,
    context_kind, context_id.
    """
    final = found.where("scope = 'document' and context_kind = 'document_final' and context_id is not null")
    contexts = final.groupBy("document_id").agg(F.count_distinct("context_id").alias("n"))
    known = found.select("document_id", "cents", "label").distinct()
    absent = _blank(chosen.join(known, ["document_id", "cents", "label"], "left_anti").select("document_id"))
    both = _blank(contexts.join(chosen.select("document_id", "scope"), "document_id", "full_outer"))
    mixed = _blank(found.where("context_id is not null").groupBy("document_id", "context_id").agg(F.count_distinct("scope").alias("s"), F.count_distinct("context_kind").alias("k")).where("s > 1 or k > 1").select("document_id").distinct())
    got = F.col("scope").isNotNull()
    return _all([
        _issue(absent, "primary_total_not_in_candidates", "blocking", F.lit(True)), _issue(both, "invalid_primary_total_scope", "blocking", F.col("scope") != "document"), _issue(both, "primary_total_missing_for_unique_context", "blocking", ~got & (F.col("n") == 1)),
        _issue(both, "ambiguous_primary_total", "blocking", ~got & (F.col("n") > 1)), _issue(both, "primary_total_requires_unique_context", "blocking", got & (F.coalesce("n", F.lit(0)) != 1)), _issue(mixed, "inconsistent_document_total_context", "blocking", F.lit(True)),
    ])


def inventory_rules(documents: DataFrame, pages: DataFrame, tables: DataFrame, rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Whether pages, printed tables, printed rows and diagnostics are there, once each.

    documents: document_id, page_count; pages: document_id, page; tables: document_id, page, table_id;
    rows: document_id, page, table_id, row_id; diagnostics: document_id, page, table_id (null for a page's).
    """
    want = documents.where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    lost = _blank(want.join(pages.select("document_id", "page"), ["document_id", "page"], "left_anti"))
    counted = _blank(documents.join(pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("page_count")).select("document_id"))
    twice = _blank(tables.groupBy("document_id", "table_id").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page")).where("n > 1"))
    again = rows.groupBy("document_id", "row_id").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"), F.min("table_id").alias("table_id")).where("n > 1")
    none = _blank(documents.select("document_id").join(tables.select("document_id").distinct(), "document_id", "left_anti"))
    undiagnosed = _blank(pages.select("document_id", "page").join(diagnostics.where("table_id is null").select("document_id", "page"), ["document_id", "page"], "left_anti"))
    orphan = _blank(diagnostics.where("table_id is not null").select("document_id", "page", "table_id").join(tables.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti"))
    untold = _blank(tables.select("document_id", "page", "table_id").join(diagnostics.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti"))
    yes = F.lit(True)
    return _all([
        _issue(lost, "page_inventory_incomplete", "fatal", yes), _issue(counted, "page_count_mismatch", "fatal", yes), _issue(twice, "duplicate_source_table_id", "fatal", yes), _issue(again, "duplicate_source_row_id", "fatal", yes), _issue(none, "source_tables_missing", "fatal", yes),
        _issue(undiagnosed, "page_diagnostic_inventory_incomplete", "fatal", yes), _issue(untold, "table_diagnostic_inventory_incomplete", "fatal", yes), _issue(orphan, "orphan_table_diagnostic", "fatal", yes), _issue(rows, "source_row_anchor_missing", "fatal", F.col("table_id").isNull() | F.col("page").isNull()),
    ])


def token_rules(tokens: DataFrame) -> DataFrame:
    """Tokens (document_id, page, token_id, text, box, page_width, page_height): ids once, inside their page, with text."""
    placed = _blank(tokens.withColumn("row_id", F.col("token_id")))
    twice = _blank(tokens.groupBy("document_id", "token_id").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page")).where("n > 1").withColumn("row_id", F.col("token_id")))
    box = F.col("box")
    out = (box["l"] < 0) | (box["t"] < 0) | (box["r"] > F.col("page_width")) | (box["b"] > F.col("page_height")) | (box["r"] < box["l"]) | (box["b"] < box["t"])
    return _all([_issue(twice, "duplicate_token_manifest_id", "fatal", F.lit(True)), _issue(placed, "token_bounds_invalid", "fatal", F.coalesce(out, F.lit(True))), _issue(placed, "token_manifest_entry_invalid", "fatal", F.coalesce(F.trim("text"), F.lit("")) == "")])


def linked_value_rules(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Printed cells against the canonical values of the rows they are linked to.

    cells: document_id, page, table_id, row_id, field, value; values: document_id, row_id, field, value;
    values that compare are normalised already.
    """
    both = cells.withColumnRenamed("value", "printed").join(values.withColumnRenamed("value", "canonical"), ["document_id", "row_id", "field"], "full_outer")
    p, c = F.col("printed").isNotNull(), F.col("canonical").isNotNull()
    return _all([_issue(both, "printed_value_missing_canonical", "blocking", p & ~c), _issue(both, "canonical_value_missing_printed", "blocking", c & ~p), _issue(both, "mapped_cell_value_mismatch", "blocking", F.col("printed") != F.col("canonical"))])


def usage_rules(usage: DataFrame) -> DataFrame:
    """Model calls and costs (document_id, initial_calls, recovery_calls, total_calls, initial_cost, recovery_cost, total_cost, hosted_recovery_calls): parts add up, and no hosted model recovers."""
    u = _blank(usage)
    off = (F.col("initial_calls") + F.col("recovery_calls") != F.col("total_calls")) | (F.abs(F.col("initial_cost") + F.col("recovery_cost") - F.col("total_cost")) > 1e-9)
    bad = F.least("initial_calls", "recovery_calls", "total_calls") < 0
    return _all([_issue(u, "provider_usage_aggregate_mismatch", "fatal", F.coalesce(off, F.lit(True))), _issue(u, "provider_usage_contract_invalid", "fatal", F.coalesce(bad, F.lit(True))), _issue(u, "recovery_hosted_model_invoked", "fatal", F.coalesce("hosted_recovery_calls", F.lit(0)) > 0)])


def receipt_rules(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Receipt pairs (document_id, left_id, right_id, flagged): both rows known and different; each flagged row blocks."""
    known = rows.select("document_id", "row_id")
    ids = pairs.select("document_id", F.explode(F.array("left_id", "right_id")).alias("row_id"))
    wrong = ids.join(known, ["document_id", "row_id"], "left_anti").unionByName(pairs.where("left_id = right_id").select("document_id", F.col("left_id").alias("row_id"))).distinct()
    flagged = pairs.select("document_id", F.col("flagged").alias("row_id")).distinct()
    return _all([_issue(_blank(wrong), "receipt_duplicate_pair_invalid", "fatal", F.lit(True)), _issue(_blank(flagged), "possible_duplicate_supporting_charge", "blocking", F.lit(True))])


def report(issues: DataFrame) -> DataFrame:
    """Distinct issues with an id, and by document the status: failed, needs_review or passed."""
    keyed = issues.withColumn("issue_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "code", "page", "table_id", "row_id")]), 256))
    return keyed.dropDuplicates(["issue_id"])


def status(documents: DataFrame, issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "fatal", 3).when(F.col("severity") == "blocking", 2).otherwise(1)
    worst = issues.groupBy("document_id").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("issues"))
    worst_of = F.coalesce("worst", F.lit(0))
    return documents.select("document_id").distinct().join(worst, "document_id", "left").select("document_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.when(worst_of == 3, "failed").when(worst_of == 2, "needs_review").otherwise("passed").alias("status"))


def recovery_targets(issues: DataFrame) -> DataFrame:
    """Pages and tables to read again for blocking issues; a page named as a whole takes its tables' place."""
    open_ = issues.where("severity = 'blocking' and page is not null")
    pages = open_.where("table_id is null").select("document_id", "page").distinct()
    tables = open_.where("table_id is not null").select("document_id", "page", "table_id").distinct().join(pages, ["document_id", "page"], "left_anti")
    return pages.withColumn("table_id", F.lit(None).cast("string")).unionByName(tables)
