"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

Documents form a tree of domains, languages and sources. A token budget flows from the root down:
each node's children get shares in proportion to their weights, but no child more than its subtree
can give (its tokens times the number of epochs allowed). What a child can't use goes to its
siblings first, and only what a whole subtree can't use goes to the siblings of its parent. A leaf
then takes a prefix of its epochs laid end to end: each epoch is the leaf's documents in the order of
a seeded digest; the last document is taken in part, so the leaf's budget is met to the token.

The prefix is found without sorting a leaf as a whole: digests fall into buckets of a few hundred
documents, bucket totals are summed along the leaf, and only inside a bucket are rows ordered.

Defined results: tokens are runs of non-white-space characters; a document without tokens is never
taken; a null domain, language or source is the child ``unknown``; a weight of 0 or less excludes a
child; a budget beyond what all epochs give takes everything. Rows that repeat a key are rows of
their own. All columns of the input but the text ride along
in ``row``; ``with_text`` adds the texts that were taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.spool import spool

TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Documents in a bucket of a leaf, in the mean.
BUCKET, BUCKETS = 256, 4096


def weight_of(weights: dict[str, int], path: list[Column], default: int) -> Column:
    """The weight of a path: its own entry ``a/b``, else the entry ``*/b`` for its level, else the default."""
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", *path)), F.try_element_at(table, F.concat_ws("/", *[F.lit("*")] * (len(path) - 1), path[-1])), F.lit(default))


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add got: the budget (same within a parent) split by w, at most cap each; all whole numbers."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [(F.col("cap").cast("double") / F.col("w").cast("double")), F.col(name)]
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    x = children.withColumn("_below", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_left", F.sum("w").over(after))
    x = x.withColumn("_full", d("cap") * d("_left") <= (d("budget") - d("_below")) * d("w"))
    x = x.withColumn("_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0)))
    x = x.withColumn("_w", F.when(F.col("_full"), F.lit(0)).otherwise(F.col("w"))).withColumn("_sum", F.sum("_w").over(by)).withColumn("_upto", F.sum("_w").over(upto))
    x = x.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("cast(cast(_rest as decimal(38,0)) * cast(_upto as decimal(38,0)) div cast(_sum as decimal(38,0)) - cast(_rest as decimal(38,0)) * cast(_upto - _w as decimal(38,0)) div cast(_sum as decimal(38,0)) as bigint)")))
    return x.drop("_below", "_left", "_full", "_rest", "_w", "_sum", "_upto")


def plan(leaves: DataFrame, weights: dict[str, int], budget: int | None, share: tuple[int, int], epochs: int, default_weight: int = 1) -> DataFrame:
    """leaves (domain, lang, source, tokens, docs) with got, the tokens that each gives."""
    path = [F.col(c) for c in LEVELS]
    out = None
    rows = leaves
    for k in range(1, 4):  # leaves below an excluded node give nothing
        rows = rows.withColumn(f"_w{k}", weight_of(weights, path[:k], default_weight).cast("long")).where(F.col(f"_w{k}") > 0)
    for k in range(1, 4):
        keys = list(LEVELS[:k])
        level = rows.groupBy(*keys).agg((F.sum("tokens") * epochs).alias("cap"), F.first(f"_w{k}").alias("w"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        if out is None:
            whole = F.lit(budget).cast("long") if budget is not None else F.expr(f"sum(tokens) over (partition by 0) * {share[0]} div {share[1]}")
            level = level.withColumn("budget", whole)
        else:
            level = level.join(out.select(*keys[:-1], F.col("got").alias("budget")), keys[:-1])
        out = _fill(level, keys[:-1], keys[-1])
    return out.select(*LEVELS, "tokens", "docs", "got")


def mix(docs: DataFrame, domain: Column, weights: dict[str, int], key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", budget: int | None = None, share: tuple[int, int] = (3, 5), epochs: int = 3, seed: int = 17) -> DataFrame:
    """Columns: row (struct of all columns but the text), key, hash (of the text), domain, lang, source, epoch, n_tokens, take_tokens."""
    unknown = F.lit("unknown")
    rest = [c for c in docs.columns if c != text]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.xxhash64(text).alias("hash"), F.coalesce(domain, unknown).alias("domain"),
        F.coalesce(F.col(lang).cast("string"), unknown).alias("lang"), F.coalesce(F.col(source).cast("string"), unknown).alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    base, _ = spool(base, "token-counts")  # texts are read once; what follows works on short rows
    base = base.where("n_tokens > 0")
    leaves, _ = spool(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    got = plan(leaves, weights, budget, share, epochs).where("got > 0").select(*LEVELS, F.expr("got div tokens").alias("whole"), F.expr("got % tokens").alias("rest"), F.expr("greatest(1, docs div %d)" % BUCKET).alias("buckets"))
    got, _ = spool(got, "leaf-budgets")  # one row by leaf; its size is known to Catalyst
    rows = base.join(got, list(LEVELS))
    cols = ["row", "key", "hash", *LEVELS, "epoch", "n_tokens", "take_tokens"]
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("take_tokens", F.col("n_tokens")).select(*cols)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("key")))
    part = rows.where("rest > 0").withColumn("digest", digest).withColumn("bucket", F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as bigint) * buckets div 4294967296"))
    leaf_bucket = [*LEVELS, "bucket"]
    sums = part.groupBy(*leaf_bucket).agg(F.sum("n_tokens").alias("in_bucket"))
    before = _before(sums)
    inside = Window.partitionBy(*leaf_bucket).orderBy("digest", "n_tokens", "hash", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    part = part.join(before, leaf_bucket).where("before < rest").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("start < rest")
    part = part.withColumn("epoch", F.col("whole")).withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start"))).select(*cols)
    return full.unionByName(part)


def _before(sums: DataFrame) -> DataFrame:
    """By leaf and bucket, the tokens of all buckets before it: added up within runs of BUCKETS buckets, and over runs, so no task sorts a whole leaf."""
    run = F.expr(f"bucket div {BUCKETS}")
    runs = sums.groupBy(*LEVELS, run.alias("run")).agg(F.sum("in_bucket").alias("in_run"))
    over_runs = Window.partitionBy(*LEVELS).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*LEVELS, "run", F.coalesce(F.sum("in_run").over(over_runs), F.lit(0)).alias("before_run"))
    within = Window.partitionBy(*LEVELS, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = sums.withColumn("run", run).withColumn("in_before", F.coalesce(F.sum("in_bucket").over(within), F.lit(0))).join(runs, [*LEVELS, "run"])
    return both.select(*LEVELS, "bucket", (F.col("before_run") + F.col("in_before")).alias("before"))


def with_text(mixed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add text, the tokens taken of it. Texts are shuffled once, to where their rows are."""
    identity = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.xxhash64(text).alias("hash")]
    texts = docs.select(*identity, F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("key", "hash").orderBy(F.lit(0)))).where("copy = 1").drop("copy")
    return mixed.join(texts, ["key", "hash"]).withColumn("text", F.when(F.col("take_tokens") < F.col("n_tokens"), token_prefix(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text")))


def token_prefix(text: Column, tokens: Column) -> Column:
    """The text up to the end of its token of that number, white space before it as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), tokens.cast("int")), "")


def domain_of_source(source: Column, domains: int = 4) -> Column:
    """The last number in a source's name modulo the number of domains: dom0, dom1, ..."""
    return F.concat(F.lit("dom"), (F.try_to_number(F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long") % domains).cast("string"))
