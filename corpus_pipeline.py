"""The corpus pipeline: five stages over documents, each of them one operator of corvata.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Columns that documents have besides pass through; one that is named like a column that the
mixture adds gets ``_of_document`` at its end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.llm import decontaminate, mixing, neardup, quality, suffixes
from corvata.llm.queries import MIX_WEIGHTS
from corvata.llm.spool import discard, scratch, spool

#: The shortest repeated string that goes, in bytes: about 50 subword tokens, the usual threshold of substring deduplication;
#: any passage of over 50 words reaches it where words average three letters and a space or more.
REPEAT_BYTES = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learned from all labels does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of REPEAT_BYTES that occur more than once."""
    done = suffixes.dedup(docs, length=REPEAT_BYTES, as_text=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for every document and epoch taken, its text cut where its leaf's budget ends."""
    chosen = mixing.with_text(mixing.mix(docs, mixing.domain_of_source(F.col("source")), MIX_WEIGHTS), docs)
    added = ("domain", "epoch", "n_tokens", "take_tokens")
    plain = [F.col(f"row.`{c}`").alias(f"{c}_of_document" if c in added else c) for c in docs.columns if c not in ("text", "n_chars")]
    return chosen.select(*plain, "text", F.length("text").cast("long").alias("n_chars"), *added)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
]

#: Learned scores and digests of bytes have no SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs, path = spool(stage(spark, docs, sf_dir), f"stage{i}")
            keep.append(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
