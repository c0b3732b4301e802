"""The registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvata.llm import cdc, chat, html_main, language, mixing, neardup, quality, suffixes, topk
from corvata.llm.decontaminate import decontaminate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS p
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pats),
grams AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS p
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM low) d JOIN lens ON i + n - 1 <= len(w)),
occ AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM grams g JOIN pats p ON g.n = p.n AND g.p = p.p),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""


def crc(column: str, mod: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


#: Passages of over 50 words have about 250 bytes or more; op1 counts the bytes of strings of this many that repeat, as well.
PASSAGE_BYTES = 200


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What its contract removes, at 400 bytes; beside that n_repeated, the bytes in repeated passages of PASSAGE_BYTES, removed or not."""
    done = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], shorter=PASSAGE_BYTES)
    return done.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS v, row_number() OVER () AS r FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM ok q JOIN ok c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

MIX_WEIGHTS = {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1, "unknown": 1, "*/en": 4, "*/fr": 3, "*/de": 3, "*/es": 2, "*/*/src0": 2}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mixing.domain_of_source(F.col("source")), MIX_WEIGHTS)
    return mixed.select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _fill_sql(name: str, rows: str, parent: str, order: str) -> str:
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({parent} ORDER BY CAST(cap AS DOUBLE) / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER ({parent} ORDER BY CAST(cap AS DOUBLE) / w, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM {rows}),
{name}_b AS (SELECT *, cap * lft <= (budget - below) * w AS sat FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER ({parent}), 0) AS rest, CASE WHEN sat THEN 0 ELSE w END AS w0 FROM {name}_b),
{name}_d AS (SELECT *, sum(w0) OVER ({parent}) AS ws, sum(w0) OVER ({parent} ORDER BY CAST(cap AS DOUBLE) / w, {order} ROWS UNBOUNDED PRECEDING) AS wu FROM {name}_c),
{name} AS (SELECT *, CASE WHEN sat THEN cap ELSE (rest * wu) // ws - (rest * (wu - w0)) // ws END AS got FROM {name}_d)"""


OP3_SQL = r"""
WITH base AS (SELECT doc_id, coalesce('dom' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
              CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS n FROM documents),
doc AS (SELECT * FROM base WHERE n > 0),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, count(*) AS docs,
         CASE domain WHEN 'dom0' THEN 4 WHEN 'dom1' THEN 3 WHEN 'dom2' THEN 2 ELSE 1 END AS w1, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 3 WHEN 'de' THEN 3 WHEN 'es' THEN 2 ELSE 1 END AS w2, CASE source WHEN 'src0' THEN 2 ELSE 1 END AS w3 FROM doc GROUP BY domain, lang, source),
r1 AS (SELECT domain, CAST(sum(tokens) * 3 AS HUGEINT) AS cap, CAST(first(w1) AS HUGEINT) AS w, CAST(sum(sum(tokens)) OVER () AS HUGEINT) * 3 // 5 AS budget FROM leaf GROUP BY domain),""" + _fill_sql("l1", "r1", "", "domain") + """,
r2 AS (SELECT domain, lang, cap, w, got AS budget FROM (SELECT domain, lang, CAST(sum(tokens) * 3 AS HUGEINT) AS cap, CAST(first(w2) AS HUGEINT) AS w FROM leaf GROUP BY domain, lang) JOIN (SELECT domain, got FROM l1) USING (domain)),""" + _fill_sql("l2", "r2", "PARTITION BY domain", "lang") + """,
r3 AS (SELECT domain, lang, source, tokens, cap, w, got AS budget FROM (SELECT domain, lang, source, tokens, CAST(tokens * 3 AS HUGEINT) AS cap, CAST(w3 AS HUGEINT) AS w FROM leaf) JOIN (SELECT domain, lang, got FROM l2) USING (domain, lang)),""" + _fill_sql("l3", "r3", "PARTITION BY domain, lang", "source") + """,
plan AS (SELECT domain, lang, source, got // tokens AS whole, got % tokens AS rest FROM l3 WHERE got > 0),
rows_ AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('17|' || CAST(whole AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), n ROWS UNBOUNDED PRECEDING) - n AS start FROM doc d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(unnest(range(CAST(whole AS BIGINT))) AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(n AS BIGINT) AS take_tokens FROM rows_
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), CAST(n AS BIGINT), CAST(least(n, rest - start) AS BIGINT) FROM rows_ WHERE start < rest
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return shown.withColumn("mask", spans).drop("spans")


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '\s', '_', 'g') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n FROM t),
who AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
h AS (SELECT n.*, w.participant, n.role = w.participant AS own, '<|im_start|>' || CASE WHEN n.role = w.participant THEN 'assistant' WHEN n.role = 'system' THEN 'system' ELSE 'user name=' || n.role END || chr(10) AS head FROM n JOIN who w USING (conv_id)),
c AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM h),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM c)
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_targets, string_agg(piece, '' ORDER BY n) AS text,
       coalesce(string_agg(CAST(CAST(stop - length(piece) + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (own), '') AS mask
FROM e GROUP BY conv_id, participant
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cdc.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return done.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "n_repeated_chunks", "kept_sha256", F.col("kept").alias("text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc("doc_id", 4) != 2))
    found = language.identify(docs.select("doc_id", "text", (crc("doc_id", 4) == 2).alias("held_out")), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(crc("doc_id", 3) != 1))
    found = quality.score(docs.withColumn("held_out", crc("doc_id", 3) == 1), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), carry=["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": OP2_SQL, "op3_mixing": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op6_benchmark_decontamination": OP6_SQL}
