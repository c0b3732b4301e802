"""Service dates that rows take from themselves or from date-only rows beside them. Windows on tables, arrays of a document's dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.text import words

#: Days that a date may lie from a trusted one, and that support one another in a column.
TRUST_DAYS, SUPPORT_DAYS = 120, 45


def believed(rows: DataFrame) -> DataFrame:
    """Keep own_date where it may be one of service, else null.

    rows: document_id, table_id, row_order, own_date, explicit (its column is a date column), lane. Dates
    of explicit columns are trusted. A date must lie within 120 days of some trusted date of its document,
    if there is any; outside explicit columns its column must hold two dates, itself counted, within 45 days.
    """
    trusted = F.collect_set(F.when(F.col("explicit"), F.col("own_date"))).over(Window.partitionBy("document_id"))
    column = F.collect_list("own_date").over(Window.partitionBy("document_id", "table_id", "lane"))
    x = rows.withColumn("_trusted", trusted).withColumn("_column", column)
    near = (F.size("_trusted") == 0) | F.exists("_trusted", lambda d: F.abs(F.datediff(d, F.col("own_date"))) <= TRUST_DAYS)
    backed = F.col("explicit") | (F.size(F.filter("_column", lambda d: F.abs(F.datediff(d, F.col("own_date"))) <= SUPPORT_DAYS)) >= 2)
    return x.withColumn("own_date", F.when(near & backed, F.col("own_date"))).drop("_trusted", "_column")


def recovered(rows: DataFrame) -> DataFrame:
    """Charges with service_date and how it came: own, attached, carried or following; null without any.

    rows: document_id, table_id, row_order, kind (charge, date_only or other), own_date, lane_value (what
    the row prints in the date's column), description. A date-only row belongs to the charge above it if
    that one prints a reference with digits in the column or shares a word with it, and then holds for the
    charges below until one prints something there; else it holds for the next charge alone.
    """
    w = Window.partitionBy("document_id", "table_id").orderBy("row_order")
    date_only = (F.col("kind") == "date_only") & F.col("own_date").isNotNull()
    above = F.lag("kind").over(w) == "charge"
    shares = F.arrays_overlap(words(F.lag("description").over(w), 3), words(F.col("description"), 3))
    backs = F.coalesce(above & (F.coalesce(F.lag("lane_value").over(w), F.lit("")).rlike("[0-9]") | shares), F.lit(False))
    x = rows.withColumn("_day", F.when(date_only, F.col("own_date"))).withColumn("_back", F.coalesce(F.col("_day").isNotNull() & backs, F.lit(False)))
    filled = F.coalesce("lane_value", F.lit("")) != ""
    x = x.withColumn("_part", F.sum((F.col("_back") | filled | F.col("_day").isNotNull()).cast("int")).over(w))
    part = Window.partitionBy("document_id", "table_id", "_part").orderBy("row_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_held", F.first(F.when(F.col("_back"), F.col("_day"))).over(part))
    x = x.withColumn("_below", F.when(F.lead("_back").over(w), F.lead("_day").over(w))).withColumn("_before", F.when(~F.lag("_back").over(w), F.lag("_day").over(w)))
    own = F.when(F.col("own_date").isNotNull(), "own").when(F.col("_below").isNotNull(), "attached").when(F.col("_held").isNotNull(), "carried").when(F.col("_before").isNotNull(), "following")
    day = F.coalesce("own_date", "_below", "_held", "_before")
    return x.withColumn("service_date", day).withColumn("how", own).where("kind = 'charge'").select(*rows.columns, "service_date", "how")
