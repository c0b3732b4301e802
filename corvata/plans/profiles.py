"""Layout profiles: construction, scoring and selection, gates, life cycle, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.text import jaccard

# Transitions that a profile may make.
#: Observations that are sent to every task, and tasks that share a block where there are more.
FEW, PARTS = 20_000, 32
TRANSITIONS = (
    ("candidate", "shadow"), ("candidate", "archived"), ("shadow", "active"), ("shadow", "archived"),
    ("active", "drifted"), ("active", "archived"), ("drifted", "shadow"), ("drifted", "archived"),
)


def at_least_share(n: Column, share: float) -> Column:
    """How many of n observations make a share, ceiling-like."""
    return F.greatest(F.lit(1), F.bround(n * share + 0.499999).cast("int"))


def column_lanes(observed: DataFrame, key: str) -> DataFrame:
    """From (key, document_id, role, centre): by role that all documents of a key show, the median centre and a tolerance.

    Tolerance: twice the largest deviation plus .01, at least .04 for amounts and .06 else, within .02 and .2.
    """
    all_docs = observed.groupBy(key).agg(F.count_distinct("document_id").alias("_all"))
    middle = observed.groupBy(key, "role").agg(F.count_distinct("document_id").alias("_n"), F.median("centre").alias("centre"))
    lanes = middle.join(all_docs, key).where("_n = _all").select(F.col(key), "role", F.col("centre").alias("middle"))
    far = observed.join(lanes, [key, "role"]).groupBy(key, "role", "middle").agg(F.max(F.abs(F.col("centre") - F.col("middle"))).alias("far"))
    least = F.when(F.col("role") == "amount", 0.04).otherwise(0.06)
    return far.select(key, "role", F.col("middle").alias("centre"), F.least(F.lit(0.2), F.greatest(F.lit(0.02), least, F.col("far") * 2 + 0.01)).alias("tolerance"))


def common_words(observed: DataFrame, key: str, share: float) -> DataFrame:
    """From (key, document_id, word): words that at least a share of a key's documents show."""
    n = observed.groupBy(key).agg(F.count_distinct("document_id").alias("_all"))
    return observed.groupBy(key, "word").agg(F.count_distinct("document_id").alias("n")).join(n, key).where(F.col("n") >= at_least_share(F.col("_all"), share)).select(key, "word", "n")


def geometry_score(aspect_a: Column, aspect_b: Column, box_a: Column, box_b: Column) -> Column:
    """Closeness of page shape and table box; boxes are arrays of four."""
    off = F.abs(aspect_a - aspect_b) / F.greatest(aspect_a, aspect_b)
    shift = sum((F.abs(box_a[i] - box_b[i]) for i in range(1, 4)), F.abs(box_a[0] - box_b[0])) / 4
    return F.greatest(F.lit(0.0), 1 - off * 2 - shift * 2)


def column_score(centres_a: Column, tolerances: Column, centres_b: Column, keys_a: Column, keys_b: Column) -> Column:
    """Mean closeness over the roles that both know; null without any. keys are the maps' roles."""
    common = F.array_intersect(keys_a, keys_b)
    one = lambda s, r: s + F.greatest(F.lit(0.0), 1 - F.abs(centres_a[r] - centres_b[r]) / F.greatest(F.lit(0.02), F.coalesce(F.try_element_at(tolerances, r), F.lit(0.06))))
    return F.aggregate(common, F.lit(0.0), one) / F.nullif(F.size(common), F.lit(0))


def profile_score(p: str, o: str) -> Column:
    """Score of profile columns (prefix p) against observation columns (prefix o): identity .2, types .15, geometry .1, headers .3 and columns .25 where known, renormalised.

    A profile of another hospital scores 0.
    """
    c = lambda side, name: F.col(f"{side}{name}")
    identity = F.when(c(p, "hospital_id").isNotNull() & (c(p, "hospital_id") != "") & c(p, "hospital_id").eqNullSafe(c(o, "hospital_id")), 1.0).otherwise(0.5)
    types = F.when(c(p, "page_type") == c(o, "page_type"), 0.4).otherwise(0.0) + F.when(c(p, "table_type") == c(o, "table_type"), 0.6).otherwise(0.0)
    geometry = geometry_score(c(p, "aspect"), c(o, "aspect"), c(p, "box"), c(o, "box"))
    header = jaccard(c(p, "word_ids"), c(o, "word_ids"))
    columns = column_score(c(p, "centres"), c(p, "tolerances"), c(o, "centres"), c(p, "roles"), c(o, "roles"))
    total = identity * 0.2 + types * 0.15 + geometry * 0.1 + F.coalesce(header * 0.3, F.lit(0.0)) + F.coalesce(columns * 0.25, F.lit(0.0))
    weight = F.lit(0.45) + F.when(header.isNotNull(), 0.3).otherwise(0.0) + F.when(columns.isNotNull(), 0.25).otherwise(0.0)
    other = c(p, "hospital_id").isNotNull() & (c(p, "hospital_id") != "") & ~c(p, "hospital_id").eqNullSafe(c(o, "hospital_id"))
    return F.when(other, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight)))


def select_profiles(profiles: DataFrame, observations: DataFrame, block: list[str]) -> DataFrame:
    """By observation_id: best profile, score, margin over the second, and whether both reach the profile's limits.

    Candidates meet observations on the blocking columns, for exact results those that a nonzero
    margin needs; an observation without candidates comes back unselected.
    """
    ids = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))  # whole numbers meet faster than words
    p = profiles.where("lifecycle = 'active'").select(F.map_keys("centres").alias("p_roles"), ids.alias("p_word_ids"), *[F.col(x).alias(f"p_{x}") for x in profiles.columns])
    o = observations.select(F.map_keys("centres").alias("o_roles"), ids.alias("o_word_ids"), *[F.col(x).alias(f"o_{x}") for x in observations.columns])
    on = [F.col(f"p_{b}").eqNullSafe(F.col(f"o_{b}")) for b in block]
    if observations.limit(FEW + 1).count() <= FEW:  # a checked size: each task scores its profiles against all observations
        met = p.join(F.broadcast(o), on)
    else:  # a block's observations are dealt to PARTS tasks, each of which meets all of the block's profiles
        salted = o.withColumn("_salt", F.pmod(F.xxhash64("o_observation_id"), F.lit(PARTS)).cast("int"))
        met = salted.join(p.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, F.col("_salt") == F.col("_part")])
    scored = met.withColumn("score", profile_score("p_", "o_"))
    w = Window.partitionBy("o_observation_id").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("p_version"), F.desc_nulls_last("p_profile_key"))
    two = scored.select("o_observation_id", "p_profile_key", "p_version", "p_threshold", "p_margin", "score").withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    best = F.max(F.when(F.col("_r") == 1, F.struct("p_profile_key", "p_threshold", "p_margin", "score")))
    top = two.groupBy("o_observation_id").agg(best.alias("b"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    margin = F.greatest(F.lit(0.0), F.col("b.score") - F.col("second"))
    chosen = F.coalesce((F.col("b.score") >= F.col("b.p_threshold")) & (margin >= F.col("b.p_margin")), F.lit(False))
    top = observations.select(F.col("observation_id").alias("o_observation_id")).join(top, "o_observation_id", "left")
    return top.select(F.col("o_observation_id").alias("observation_id"), F.col("b.p_profile_key").alias("profile_key"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce(margin, F.lit(0.0)).alias("margin"), chosen.alias("selected"))


def drift(observations: DataFrame, keys: list[str], order: list[str], window: int = 20, rate: float = 0.25) -> DataFrame:
    """By key: drifted, immediate, breached, reason; from (escalated, disagreed, hard) in order of arrival.

    A hard incompatibility among the last window observations decides at once; else both of the last
    two windows must fail at the rate. Fewer than two windows decide nothing.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = observations.withColumn("_r", F.row_number().over(newest)).withColumn("_w", F.expr(f"(_r - 1) div {window}"))
    failed = (F.col("escalated") | F.col("disagreed")).cast("int")
    g = last.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_w") == 0, F.col("hard").cast("int"))).alias("hard"),
        F.sum(F.when(F.col("_w") == 0, failed).otherwise(0)).alias("new"), F.sum(F.when(F.col("_w") == 1, failed).otherwise(0)).alias("old"),
    )
    enough, hard = F.col("n") >= 2 * window, F.col("hard") == 1
    breached = (F.col("new") / window >= rate).cast("int") + (F.col("old") / window >= rate).cast("int")
    return g.select(
        *keys, (hard | (enough & (breached == 2))).alias("drifted"), hard.alias("immediate"), F.when(hard, 1).when(enough, breached).otherwise(0).cast("int").alias("breached"),
        F.when(hard, "hard_incompatibility").when(~enough, "insufficient_window").when(breached == 2, "two_consecutive_drift_windows").alias("reason"),
    )


# The gates of activation, in order of report.
def activation_failures(m: Column, flags: Column, construction: Column, holdout: Column, calibration: Column, supported: Column) -> Column:
    """Names of failed gates of a profile with metrics m (a struct; null fails alone)."""
    low = lambda *names: F.least(*[F.coalesce(m[n], F.lit(float("-inf"))) for n in names])  # noqa: E731  a metric that is not known fails
    gates = F.array_compact(F.array(
        F.when(F.coalesce(m["holdout_bills"] < 10, F.lit(True)), "holdout_bills_below_10"), F.when(F.coalesce(m["holdout_rows"] < 200, F.lit(True)), "holdout_rows_below_200"), F.when(F.coalesce(low("precision", "recall", "f1") < 0.95, F.lit(True)), "row_metrics_below_95_percent"),
        F.when(F.coalesce(low("precision_low", "recall_low", "f1_low") <= 0.85, F.lit(True)), "confidence_lower_bound_not_above_85_percent"), F.when(F.coalesce(m["amount_accuracy"] < 0.95, F.lit(True)), "amount_accuracy_below_95_percent"), F.when(F.coalesce(m["negative_recall"] < 1, F.lit(True)), "negative_recall_below_100_percent"),
        F.when(F.coalesce(m["ungrounded"] > 0, F.lit(True)), "accepted_ungrounded_rows"), F.when(F.coalesce(m["incomplete_pages"] > 0, F.lit(True)), "incomplete_pages"), F.when(F.coalesce(m["identity_ambiguities"] > 0, F.lit(True)), "identity_ambiguities"), F.when(F.coalesce(m["unsafe_numeric"] > 0, F.lit(True)), "unsafe_numeric_failures"),
        F.when(F.coalesce(m["field_failures"] > 0, F.lit(True)), "supported_field_gate_failures"), F.when(F.array_contains(flags, "mixed_capture") & (m["capture_conditions"] < 2), "mixed_capture_conditions_below_2"),
        F.when((F.size(construction) <= 0) | (F.size(holdout) <= 0), "missing_dataset_provenance"), F.when(F.arrays_overlap(construction, holdout), "construction_holdout_leakage"),
        F.when(F.coalesce(calibration, F.lit("")) == "", "missing_calibration_artifact"), F.when(F.size(F.array_except(F.array(F.lit("description"), F.lit("amount")), supported)) > 0, "missing_core_supported_fields"),
    ))
    return F.when(m.isNull(), F.array(F.lit("missing_metrics"))).otherwise(gates)


def transitions(events: DataFrame) -> DataFrame:
    """Events (profile_key, version, from_state, to_state) with allowed, by the table of transitions."""
    allowed = events.sparkSession.createDataFrame(list(TRANSITIONS), "from_state string, to_state string").withColumn("allowed", F.lit(True))
    return events.join(F.broadcast(allowed), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))  # eight fixed rows


def rollback(profiles: DataFrame) -> DataFrame:
    """By profile_key with an active version: it, and the highest other archived or drifted version that passed; no row without both."""
    newest = Window.partitionBy("profile_key").orderBy(F.desc("version"))
    active = profiles.where("lifecycle = 'active'").withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("profile_key", F.col("version").alias("archive_version"))
    back = profiles.where("lifecycle in ('archived', 'drifted') and passed").withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("profile_key", F.col("version").alias("activate_version"))
    return active.join(back, "profile_key")
