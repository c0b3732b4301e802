"""Drift as a stream: the last observations of each profile in order of arrival, and an inbox of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "profile_key long, seq long, drifted boolean, immediate boolean, breached int"
STATE = "failed array<boolean>, hard array<boolean>"


def decide(failed: list[bool], hard: list[bool], window: int = 20, rate: float = 0.25) -> tuple[bool, bool, int]:
    """(drifted, immediate, breached windows) of the observations so far."""
    if any(hard[-window:]):
        return True, True, 1
    if len(failed) < 2 * window:
        return False, False, 0
    breached = sum(sum(part) / window >= rate for part in (failed[-2 * window : -window], failed[-window:]))
    return breached == 2, False, breached


def drift_stream(observations: DataFrame, window: int = 20, rate: float = 0.25) -> DataFrame:
    """A decision after every observation (profile_key, seq, escalated, disagreed, hard); state keeps two windows a profile."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, hard = (list(map(bool, x)) for x in state.get) if state.exists else ([], [])
        out = []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            failed = [*failed, bool(row.escalated or row.disagreed)][-2 * window :]
            hard = [*hard, bool(row.hard)][-2 * window :]
            out.append((key[0], row.seq, *decide(failed, hard, window, rate)))
        state.update((failed, hard))
        yield pd.DataFrame(out, columns=["profile_key", "seq", "drifted", "immediate", "breached"])

    return observations.groupBy("profile_key").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def inbox(jobs: DataFrame, done_path: str, work) -> object:
    """Start a stream that works off queued jobs; a batch that is run again after a crash writes the same place again."""

    def batch(df: DataFrame, n: int) -> None:
        work(df.where("status = 'queued'").orderBy("created_at")).write.mode("overwrite").parquet(f"{done_path}/batch={n}")

    return jobs.writeStream.foreachBatch(batch).trigger(availableNow=True)


def expired(jobs: DataFrame, reviews: DataFrame, now, days: int) -> DataFrame:
    """Jobs whose last activity, of job or review, is older than so many days."""
    both = jobs.join(reviews.groupBy("job_id").agg(F.max("reviewed_at").alias("reviewed_at")), "job_id", "left")
    last = F.greatest("updated_at", F.coalesce("reviewed_at", "updated_at"))
    return both.where(last < F.lit(now) - F.expr(f"interval {days} days")).select("job_id", last.alias("last_activity"))
