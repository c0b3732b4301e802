"""Readers and writers of the ledger's files: gold and prediction JSON, token arrays, catalogs, caches and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.functions.fields import hospital_id, safe_cell

GOLD = (
    "bill_file string, document_total decimal(18,4), rows array<struct<page_number:int,table_id:string,row_order:int,section:string,service_date:string,request_no:string,description:string,"
    "service_code:string,hsn_code:string,rate:decimal(18,4),quantity:decimal(18,4),gross_amount:decimal(18,4),discount:decimal(18,4),amount:decimal(18,4),source_note:string>>"
)
ACTUAL = "rows array<struct<page_number:int,page:int,table_id:string,row_order:int,description:string,raw_text:string,request_no:string,amount:string,net_amount:string,gross_amount:string>>"


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of gold files, one JSON object a file, with file and input order."""
    files = spark.read.schema(GOLD).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return files.select("file", "bill_file", "document_total", F.posexplode("rows").alias("input", "r")).select("file", "bill_file", "document_total", "input", "r.*")


def loose_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of predictions with the first amount, page and text that they have; a row without an order has its place."""
    files = spark.read.schema(ACTUAL).json(path, multiLine=True).withColumn("file", F.input_file_name())
    r = files.select("file", F.posexplode("rows").alias("input", "r"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    amount = F.coalesce("r.amount", "r.net_amount", "r.gross_amount").try_cast("decimal(18,4)")
    return r.select("file", "input", F.coalesce("r.page_number", "r.page", F.lit(0)).alias("page"), blank("r.table_id").alias("table_id"), F.coalesce("r.row_order", "input").alias("row_order"), F.coalesce(blank("r.description"), blank("r.raw_text"), F.lit("")).alias("description"), blank("r.request_no").alias("request_no"), amount.alias("amount"))


def catalog(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below a path with digest, size, and the hospital in their name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), hospital_id(name).alias("hospital_id"))


def duplicates(files: DataFrame) -> DataFrame:
    """Digests that several files share."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("path")).alias("paths")).where("files > 1")


def ocr_tokens(pages: DataFrame) -> DataFrame:
    """Recogniser arrays (texts, scores, boxes ARRAY<ARRAY<DOUBLE>>) with a crop's origin and scale as tokens on the page; blank texts are left out."""
    one = pages.select("document_id", "page", "origin_x", "origin_y", "scale", F.posexplode(F.arrays_zip("texts", "scores", "boxes")).alias("n", "t"))
    at = lambda i, o: F.col(o) + F.element_at("t.boxes", i) * F.col("scale")
    box = F.struct(at(1, "origin_x").alias("l"), at(2, "origin_y").alias("t"), at(3, "origin_x").alias("r"), at(4, "origin_y").alias("b"))
    return one.where(F.trim("t.texts") != "").select("document_id", "page", F.concat_ws("-", "document_id", "page", "n").alias("token_id"), F.col("t.texts").alias("text"), F.col("t.scores").alias("confidence"), box.alias("box"))


def layout_boxes(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """Table boxes that a layout model is sure enough of."""
    kept = F.filter("boxes", lambda b: (b["label"] == "table") & (b["score"] >= least))
    return pages.select("document_id", "page", F.posexplode(kept).alias("n", "b")).select("document_id", "page", "n", "b.*")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def cached(requests: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(all results, newly computed ones) for requests with a cache_key: known keys are read, only others computed."""
    new = compute(requests.join(cache.select("cache_key"), "cache_key", "left_anti"))
    known = requests.select("cache_key").join(cache, "cache_key")
    return known.unionByName(new.select(known.columns)), new


def write_csv(rows: DataFrame, path: str, fields: list[str], numbers: set[str]) -> None:
    """Spreadsheet files with a header; texts can't run as formulas."""
    rows.select(*[F.col(f) if f in numbers else safe_cell(F.col(f)).alias(f) for f in fields]).write.csv(path, header=True)


def write_once(rows: DataFrame, path: str) -> None:
    """Write to a new place; an existing one is an error."""
    rows.write.mode("errorifexists").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
