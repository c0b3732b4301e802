"""Joins on a key that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys of most rows, up to SHARE of them and of about LEAST rows or more, are hot: their rows are dealt to PARTS tasks each.
#: No key beyond the first SHARE has more than one row in SHARE. One row in SAMPLED is looked at to find them.
SHARE, LEAST, PARTS, SAMPLED = 128, 512, 64, 8


def hot_join(rows: DataFrame, table: DataFrame, key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """rows join table on key (and the columns also), where table has one row for each key.

    The rows of hot keys are salted by their content and met by PARTS copies of the key's one row. Which
    keys are hot is told from a sample by hash; results don't hang on it, and the driver sees at most
    SHARE keys. Null keys meet nothing.
    """
    content = F.xxhash64(*[F.col(c) for c in rows.columns])
    seen = rows.where(F.pmod(content, F.lit(SAMPLED)) == 0).groupBy(key).count().where(F.col("count") >= LEAST // SAMPLED)
    hot = [r[0] for r in seen.orderBy(F.desc("count")).limit(SHARE).collect() if r[0] is not None]
    if not hot:
        return rows.join(table, [key, *also])
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.shiftright(content, 8), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_salt", salt).join(table.withColumn("_salt", F.explode(salts)), [key, *also, "_salt"]).drop("_salt")
