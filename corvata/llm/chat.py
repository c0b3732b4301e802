"""Chat formatting by multi-party perspective rotation. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as
``assistant``, every other speaker as ``user`` with a name, and system turns as ``system``. The mask
is the list of spans, in code points, of what the assistant says with its end mark.

A dialogue is one row by participant: its rows and the rendering stand in one task, which takes some
ten times the dialogue's text. Where single conversations are larger than that allows, ``segment``
renders them in pieces: of turns n*segment to n*segment+segment-1 and, where turns repeat, of at most
segment rows (pages). Pieces in order of (segment, page), laid end to end, are the whole rendering;
``at`` says where a piece starts in it, and spans count from the start of the whole.

Defined results: turns are ordered by (turn, role, text), a null turn last; a null role speaks as
``unknown``; a null text is empty; white space in a name becomes ``_``; ``<|`` in a text gets a
zero-width space after ``<`` so that no text can forge a mark. A conversation of system turns only
has no participant and gives no row. Rows with a null conversation id are conversations of one row
each. Repeated rows are repeated turns. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _spans(pieces: Column) -> Column:
    """[start, end) of the pieces that are targets, without their header."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["piece"])
        own = F.when(p["head"] >= 0, F.array(F.struct((acc["at"] + p["head"]).alias("start"), (end - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: tuple[str, ...] = ("system",), segment: int | None = None) -> DataFrame:
    """Columns: conv_id, participant, n_turns, n_targets, text, spans; with segment also segment, page and at."""
    name = F.regexp_replace(F.coalesce(F.col(role).cast("string"), F.lit("unknown")), r"\s", "_")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), name.alias("role"),
        F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("<\u200b|")).alias("text"),
        *([F.coalesce(F.floor(F.col(turn) / segment), F.lit(2**62)).cast("long").alias("segment")] if segment else []),
    )
    keys, said = ["conv_id"], F.struct("last", "turn", "role", "text")
    spoken = ~F.col("role").isin(*system)
    known, alone = rows.where("conv_id is not null"), rows.where("conv_id is null").where(spoken).withColumn("turns", F.array(said)).withColumn("participant", F.col("role"))
    if segment:
        known = known.withColumn("page", F.expr(f"cast((row_number() over (partition by conv_id, segment order by last, turn, role, text) - 1) div {segment} as bigint)"))
        alone = alone.withColumn("page", F.lit(0).cast("long"))
        keys = ["conv_id", "segment", "page"]
    grouped = known.groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    who = known.where(spoken).select("conv_id", F.col("role").alias("participant")).distinct()
    both = grouped.join(who, "conv_id").unionByName(alone.select(*keys, "turns", "participant"))

    def piece(t: Column) -> Column:
        own = t["role"] == F.col("participant")
        head = F.when(own, F.lit(f"{START}assistant\n")).when(t["role"].isin(*system), F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["role"], F.lit("\n")))
        return F.struct(F.concat(head, t["text"], F.lit(END)).alias("piece"), F.when(own, F.length(head)).otherwise(-1).alias("head"))

    both = both.withColumn("pieces", F.transform("turns", piece))
    shown = both.select(
        *keys, "participant", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["head"] >= 0)).cast("long").alias("n_targets"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), _spans(F.col("pieces")).alias("spans"),
    )
    if not segment:
        return shown
    whole = Window.partitionBy("conv_id", "participant").orderBy("segment", "page").rowsBetween(Window.unboundedPreceding, -1)
    starts = shown.select(*keys, "participant", F.length("text").cast("long").alias("length")).where("conv_id is not null")
    starts = starts.withColumn("at", F.coalesce(F.sum("length").over(whole), F.lit(0))).drop("length")
    placed = shown.where("conv_id is not null").join(starts, [*keys, "participant"]).unionByName(shown.where("conv_id is null").withColumn("at", F.lit(0).cast("long")))
    return placed.withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))))
