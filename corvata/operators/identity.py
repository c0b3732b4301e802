"""Who issued a bill, and what on it is private: hospital names in headers, and sensitive tokens with their values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.functions.money import let
from corvata.functions.text import plain

# Words that make an organisation, that rule a line out, that end a name, and slogans.
ORGANISATION = ("hospital", "hospitals", "medical centre", "medical center", "medical college", "cancer centre", "cancer center", "research institute", "healthcare centre", "healthcare center", "nursing home", "clinic")
REJECT = (
    "details of insured person", "hospitalized", "hospitalization", "claim form", "patient name", "invoice no", "invoice date", "bill no", "bill date", "credit invoice", "final bill",
    "address", "phone", "mobile", "email", "e mail", "website", "gst", "uhid", "ip no", "date of admission",
)
STOP = (" final bill", " credit invoice", " bill of supply", " address :", " address:", " phone no", " phone :", " phone:", " gstin", " gst no", " patient name", " invoice no")
SLOGANS = ("clinical excellence", "your health is our responsibility", "redefining health")
SENSITIVE = r"(?i)\b(patient|patient name|uhid|mrn|ipid|ip no|mobile|phone|address|email|dob|date of birth|aadhaar|aadhar|pan no|policy no|claim no)\b"
EMAIL, PHONE, LONG_ID = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", r"(?<![0-9])(?:\+?91[- ]?)?[6-9][0-9]{9}(?![0-9])", r"(?<![0-9])[0-9]{8,16}(?![0-9])"


def clean_name(c: Column) -> Column:
    """A header line cut down to a name: run dates, accreditation, slogans and what follows the name go; capitals become title case."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*run\s*date\s*:\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s*[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s*", "")
    x = F.regexp_replace(x, r"(?i)\bNABH\b", "")
    x = let(x, lambda t: F.when(t.rlike(r"(?i)\bhospital"), F.regexp_replace(t, r"(?i)^.*?\b(?:clinical\s+)?excellence\b\s*", "")).otherwise(t))
    x = F.regexp_replace(x, r"^[0-9]{1,3}\s+(?=[A-Z]{3})", "")
    x = F.regexp_replace(x, "(?i)(?:" + "|".join(STOP) + ").*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*\(?\s*a\s+unit\s+of\s+", ""), r"(?i)\bredefining\b.*$", "")
    x = F.regexp_replace(x, r"(?i)^(\w+)(?:\s+\1)+\s+", "$1 ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "), F.lit(" -|(),"))
    x = let(x, lambda t: F.when((t == F.upper(t)) & t.rlike("[A-Z]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.initcap(t), r"\bOf\b", "of"), r"\bAnd\b", "and"), r"\bThe\b", "the")).otherwise(t))
    return F.trim(F.substring(x, 1, 180))


def name_score(name: Column, confidence: Column, top: Column, height: Column) -> Column:
    """How likely a cleaned header line names the hospital; -1 rules it out."""
    t = plain(name)
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    longest = F.greatest(*[F.when(padded.contains(f" {m} "), len(m)).otherwise(0) for m in ORGANISATION])
    out = (longest == 0) | reduce(or_, [t.contains(m) for m in REJECT]) | (F.length(F.regexp_replace(t, "[^a-z]", "")) < 8) | (F.length(F.regexp_replace(name, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(name)) > 0.2)
    slogan = F.when(reduce(or_, [t.contains(m) for m in SLOGANS]), 1.25).otherwise(0.0)
    long = F.greatest(F.lit(0), F.length(name) - 30) * 0.005
    return F.when(out, -1.0).otherwise(4.0 + longest / 20 + confidence + F.greatest(F.lit(0.0), 1.0 - top / (height * 0.35)) - slogan - long)


def hospitals(lines: DataFrame) -> DataFrame:
    """By document the best name among its first page's header lines and their neighbours, with a confidence.

    lines: document_id, line, text, confidence, top, centre, page_height; only those in the upper 34 % and
    sure by .35. A line joins the one before or after it within 6 % of the page.
    """
    x = lines.where((F.col("top") <= F.col("page_height") * 0.34) & (F.col("confidence") >= 0.35) & (F.trim("text") != ""))
    w = Window.partitionBy("document_id").orderBy("line")
    near = F.col("page_height") * 0.06
    before, after = F.lag("centre").over(w), F.lead("centre").over(w)
    span = lambda t, c, y: F.struct(t.alias("text"), c.alias("confidence"), y.alias("top"))
    own = span(F.col("text"), F.col("confidence"), F.col("top"))
    up = F.when(F.col("centre") - before <= near, span(F.concat_ws(" ", F.lag("text").over(w), "text"), (F.lag("confidence").over(w) + F.col("confidence")) / 2, F.least(F.lag("top").over(w), F.col("top"))))
    down = F.when(after - F.col("centre") <= near, span(F.concat_ws(" ", "text", F.lead("text").over(w)), (F.lead("confidence").over(w) + F.col("confidence")) / 2, F.least(F.lead("top").over(w), F.col("top"))))
    joined = x.select("document_id", "page_height", own.alias("own"), up.alias("up"), down.alias("down"))
    spans = joined.select("document_id", "page_height", F.explode(F.array_compact(F.array("own", "up", "down"))).alias("s"))
    named = spans.withColumn("name", clean_name(F.col("s.text"))).withColumn("score", name_score(F.col("name"), F.col("s.confidence"), F.col("s.top"), F.col("page_height"))).where("score >= 0")
    best = named.groupBy("document_id").agg(F.max(F.struct("score", F.length("name").alias("n"), "name")).alias("b"))
    return best.select("document_id", F.col("b.name").alias("name"), F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), (F.col("b.score") - 3.5) / 3.5)), 4).alias("confidence"))


def sensitive_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens (document_id, page, token_id, text, box, page_width) with masked: private by themselves, or standing to the right of or just under a private label.

    Labels are few, so the self-join is by page from labels to tokens.
    """
    page = Window.partitionBy("document_id", "page")
    line = F.greatest(F.lit(6.0), F.median(F.col("box.b") - F.col("box.t")).over(page) * 0.75)
    x = tokens.withColumn("_tol", line).withColumn("_label", F.col("text").rlike(SENSITIVE)).withColumn("_y", (F.col("box.t") + F.col("box.b")) / 2)
    x = x.withColumn("_own", F.col("_label") | F.col("text").rlike(EMAIL) | F.col("text").rlike(PHONE) | F.col("text").rlike(LONG_ID))
    a, b = x.where("_label").alias("a"), x.alias("b")
    left, dy = F.col("b.box.l"), F.col("b._y") - F.col("a._y")
    beside = (F.abs(dy) <= F.col("a._tol")) | ((dy > 0) & (dy <= F.col("a._tol") * 2.5) & (left >= F.col("a.box.l") - F.col("a.page_width") * 0.05))
    reach = (left >= F.col("a.box.l")) & (left <= F.col("a.box.r") + F.col("a.page_width") * 0.45)
    near = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.token_id") != F.col("b.token_id")) & beside & reach)
    hit = near.select("b.document_id", "b.page", "b.token_id").distinct().withColumn("_near", F.lit(True))
    out = x.join(hit, ["document_id", "page", "token_id"], "left")
    return out.withColumn("masked", F.col("_own") | F.coalesce("_near", F.lit(False))).select(*tokens.columns, "masked")
