"""Choosing between readings of a table or page: proposal matching, variants, and safe improvement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions import geometry
from corvata.functions.text import jaccard
from corvata.operators import graph

# Limits of matching.
ACCEPT, MARGIN, AGREE = 0.60, 0.10, 0.65
PAGE = ["document_id", "page"]


def match_score(a: str, b: str) -> Column:
    """Likeness of two proposals on a page (columns box, reading_order, table_type, words, page_width, page_height): overlap .45, centre .15, order .10, type .10, header .20; 6 places."""
    c = lambda side, name: F.col(f"{side}.{name}")
    kind_a, kind_b = F.lower(F.coalesce(c(a, "table_type"), F.lit(""))), F.lower(F.coalesce(c(b, "table_type"), F.lit("")))
    unsure = kind_a.isin("", "unknown") | kind_b.isin("", "unknown")
    kind = F.when(unsure, 0.5).when(kind_a == kind_b, 1.0).otherwise(0.0)
    order = 1.0 / (1.0 + F.abs(c(a, "reading_order") - c(b, "reading_order")))
    centre = geometry.centre_proximity(c(a, "box"), c(b, "box"), c(a, "page_width"), c(a, "page_height"))
    return F.round(0.45 * geometry.iou(c(a, "box"), c(b, "box")) + 0.15 * centre + 0.10 * order + 0.10 * kind + 0.20 * jaccard(c(a, "words"), c(b, "words"), F.lit(0.0)), 6)


def proposal_edges(proposals: DataFrame, anchor_variant: str) -> DataFrame:
    """Every pair of an anchor and a proposal of another variant on its page, with score and reason.

    Pairs from .60 are eligible; one is ambiguous if another eligible pair at either end comes within .10
    of it or above. Of two eligible pairs with a common end at most one can be .10 above the other, so
    the pairs that are not ambiguous have no end in common, and the one-to-one assignment of greatest
    total weight takes them all: no search is needed. Proposals move once, to their page; the windows
    at both ends work there. Columns: document_id, page, variant, anchor_id, candidate_id, score, reason.
    """
    a, b = proposals.where(F.col("variant") == anchor_variant).alias("a"), proposals.where(F.col("variant") != anchor_variant).alias("b")
    pairs = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page") == F.col("b.page")))
    edges = pairs.select("b.document_id", "b.page", "b.variant", F.col("a.proposal_id").alias("anchor_id"), F.col("b.proposal_id").alias("candidate_id"), match_score("a", "b").alias("score"))
    for end in ("anchor_id", "candidate_id"):
        w = Window.partitionBy(*PAGE, "variant", end).orderBy(F.desc("score"))
        rival = F.when(F.row_number().over(w) == 1, F.lead("score").over(w)).otherwise(F.first("score").over(w))
        edges = edges.withColumn(f"_{end}", F.when(rival >= ACCEPT, rival).otherwise(0.0))
    ambiguous = F.col("score") - F.greatest(F.coalesce("_anchor_id", F.lit(0.0)), F.coalesce("_candidate_id", F.lit(0.0))) < MARGIN
    reason = F.when(F.col("score") < ACCEPT, "rejected_below_threshold").when(ambiguous, "abstained_ambiguous").otherwise("accepted_maximum_weight")
    return edges.select(*PAGE, "variant", "anchor_id", "candidate_id", "score", reason.alias("reason"))


def derived_tables(proposals: DataFrame, edges: DataFrame, anchor_variant: str) -> DataFrame:
    """Tables that no anchor has: components of unmatched proposals that overlap across variants with like headers, of two variants or with a grounded member. Columns: document_id, page, component, members, variants."""
    matched = edges.where("reason = 'accepted_maximum_weight'").select(*PAGE, F.col("candidate_id").alias("proposal_id"))
    free = proposals.where(F.col("variant") != anchor_variant).join(matched, [*PAGE, "proposal_id"], "left_anti")
    free = free.withColumn("node", F.concat_ws("|", *PAGE, "proposal_id"))
    a, b = free.alias("a"), free.alias("b")
    near = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.variant") != F.col("b.variant"))
    like = F.coalesce(jaccard(F.col("a.words"), F.col("b.words")) >= 0.5, F.lit(True))
    links = a.join(b, near).where((geometry.iou(F.col("a.box"), F.col("b.box")) >= AGREE) & like).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    named = graph.components(free.select("node"), links)
    g = free.join(named, "node").groupBy(*PAGE, "component").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("variant").alias("variants"), F.bool_or("grounded").alias("grounded"))
    return g.where("variants >= 2 or grounded").drop("grounded")


def best_variants(candidates: DataFrame, keys: list[str], better: list[str], worse: list[str], keep: int, preference: str = "preference") -> DataFrame:
    """The best candidates of each group: better columns high, worse ones low, in turn; the less changed variant and the greater id among equals."""
    order = [F.desc(c) for c in better] + [F.asc(c) for c in worse] + [F.asc(preference), F.desc("proposal_id")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def page_variant(pages: DataFrame) -> DataFrame:
    """By page the variant to use: a changed one only if it keeps text (90 %), confidence (-.03), money, tables and score, and improves one of them; else the raw one.

    Columns: document_id, page, variant, preference (0 is raw), tokens, confidence, financial, tables, score.
    """
    raw = pages.where("preference = 0").select(*PAGE, *[F.col(c).alias(f"raw_{c}") for c in ("variant", "tokens", "confidence", "financial", "tables", "score")])
    x = pages.join(raw, PAGE)
    keeps = ((F.col("raw_tokens") < 10) | (F.col("tokens") >= F.greatest(F.lit(1), F.bround(F.col("raw_tokens") * 0.9)))) & (F.col("confidence") >= F.col("raw_confidence") - 0.03) & (F.col("financial") >= F.col("raw_financial")) & (F.col("tables") >= F.col("raw_tables")) & (F.col("score") >= F.col("raw_score"))
    gains = (F.col("score") > F.col("raw_score")) | (F.col("tables") > F.col("raw_tables")) | (F.col("financial") > F.col("raw_financial")) | (F.col("tokens") >= F.col("raw_tokens") + F.greatest(F.lit(3), F.bround(F.col("raw_tokens") * 0.1))) | (F.col("confidence") >= F.col("raw_confidence") + 0.05)
    safe = (F.col("preference") > 0) & keeps & gains
    w = Window.partitionBy(*PAGE).orderBy(F.desc(safe.cast("int")), F.desc("score"), F.desc("tables"), F.desc("financial"), F.desc("tokens"), F.desc("confidence"), "preference")
    best = x.where(safe | (F.col("preference") == 0)).withColumn("safe", safe).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(*PAGE, "variant", F.when(F.col("safe"), "selected_safe_structural_improvement").otherwise("selected_raw_no_safe_improvement").alias("reason"))
