"""MinHash near-dedup by min-max hashing, with links confirmed on whole shingle sets.

A text's set is its distinct shingles of SHINGLE words, as 64-bit digests. Each permutation gives a
set two minwise values, its least and its greatest, so PERMUTATIONS evaluations make a signature of
twice that many values; bands of ROWS of them are bucket keys. At the default sizes a pair with a
similarity of 0.75 misses every common bucket with a chance of 2e-8, one of 0.8 with 7e-11.

Texts with equal sets are one unit from the start. In every bucket each unit is compared with the
bucket's leader only, the unit that shares most with others; links join units into components
(large-star and small-star rounds). Units of buckets that then still hold several components are
dealt anew into sharper buckets, by fresh permutations and longer bands, which a similar pair misses
with a chance of 5e-8 while units that merely share a passage seldom meet: again each is compared with
the leader. What then is in one bucket but not in one component goes through an exact prefix filter:
similar sets share one of their rarest shingles, early enough that the rest can still make up the
overlap; only such pairs are compared. So no bucket's size is capped, and a passage that a third of
all documents share doesn't pair them.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; a text with fewer words than SHINGLE has its whole word sequence as its one shingle; a null
key counts as larger than any; rows that repeat key and text all say the same. Other columns are kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.hot import hot_join
from corvata.llm.spool import discard, scratch, spool
from corvata.llm.textblocks import BLOCK_BYTES, SPACE, U64, Block, blocks, firsts, mix, signed, words

SHINGLE, PERMUTATIONS, ROWS = 5, 48, 3
#: The sharper buckets.
SHARP_PERMUTATIONS, SHARP_ROWS = 640, 8
NO_KEY = 2**63 - 1

_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 2**64, 4096, dtype=U64)


def _words(b: Block, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every word in order; one long text is read about limit bytes at a time."""
    n = len(b.data)
    if b.n > 1 or n <= limit:
        s, _, h = words(b)
        return np.searchsorted(b.offs, s, side="right") - 1, h
    parts, at = [], 0
    while at < n:
        end = min(n, at + limit)
        while end < n and not SPACE[b.data[end]]:  # words stay whole
            end += 1
        parts.append(words(Block(b.first, b.data[at:end], np.array([0, end - at], np.int64), b.null))[2])
        at = end
    h = np.concatenate(parts)
    return np.zeros(len(h), np.int64), h


def shingles(b: Block, k: int = SHINGLE, limit: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the distinct shingles of each text, sorted by text and digest."""
    doc, h = _words(b, limit)
    n = np.bincount(doc, minlength=b.n)
    out_doc, out = [], []
    if len(h) >= k:
        x = np.zeros(len(h) - k + 1, U64)
        for i in range(k):
            x = x * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        full = doc[: len(x)] == doc[k - 1 :]
        out_doc.append(doc[: len(x)][full])
        out.append(mix(x[full]))
    first = np.cumsum(n) - n
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = U64(0)
        for v in h[first[d] : first[d] + n[d]]:
            x = np.uint64((int(x) * 0x9E3779B97F4A7C15 + int(v)) % 2**64)
        out_doc.append(np.array([d]))
        out.append(mix(np.array([x ^ U64(n[d])], U64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    d, v = np.concatenate(out_doc), np.concatenate(out)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return d[keep], v[keep]


def band_keys(v: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS, skip: int = 0) -> np.ndarray:
    """sets x bands: keys of bands of rows values. Each permutation gives its least and its greatest value, each a minwise sample."""
    values = np.empty((2 * permutations, len(at)), U64)
    for p in range(permutations):
        x = v * _MUL[skip + p] + _ADD[skip + p]
        values[p] = np.minimum.reduceat(x, at)
        values[permutations + p] = np.maximum.reduceat(x, at)
    bands = 2 * permutations // rows
    key = np.empty((len(at), bands), U64)
    for j in range(bands):
        x = np.full(len(at), j + 1, U64)
        for r in range(rows):
            x = mix(x * U64(0x9E3779B97F4A7C15) + values[j * rows + r])
        key[:, j] = x
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, hash, n, one, two (digests of the set), bands: null where a smaller key in the block has the set."""
    for batch in batches:
        for b in blocks(batch["text"]):
            d, v = shingles(b)
            n = np.bincount(d, minlength=b.n)
            key, h = batch["key"].slice(b.first, b.n), batch["hash"].slice(b.first, b.n)
            has = np.flatnonzero(n)
            one, two, bands = np.zeros(b.n, np.int64), np.zeros(b.n, np.int64), np.full(b.n, None, object)
            if len(has):
                at = (np.cumsum(n) - n)[has]
                one[has] = signed(mix(np.add.reduceat(mix(v), at) + n[has].astype(U64)))
                two[has] = signed(mix(np.add.reduceat(mix(v ^ U64(0x5851F42D4C957F2D)), at) ^ n[has].astype(U64)))
                order, _ = firsts(one[has], two[has], key.to_numpy()[has])
                o, t = one[has][order], two[has][order]
                lead = np.ones(len(order), bool)
                lead[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
                own = np.sort(order[lead])
                size = n[has][own]
                take = np.repeat(at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                keys = band_keys(v[take], np.cumsum(size) - size)
                for i, k in zip(has[own], signed(keys), strict=True):
                    bands[i] = k
            pick = lambda x: pa.array([None if z else y for y, z in zip(x.tolist(), n == 0, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([key, h, pa.array(n.astype(np.int64)), pick(one), pick(two), pa.array(bands.tolist(), pa.list_(pa.int64()))], names=["key", "hash", "n", "one", "two", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch["text"]):
            d, v = shingles(b)
            n = np.bincount(d, minlength=b.n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(signed(v)))
            yield pa.RecordBatch.from_arrays([batch["sid"].slice(b.first, b.n), lists], names=["sid", "set"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sharper buckets of units."""
    for batch in (p for x in batches for p in (x.slice(i, 256) for i in range(0, x.num_rows, 256))):
        lists = batch["set"]
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        keys = band_keys(lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.cumsum(size) - size, SHARP_PERMUTATIONS, SHARP_ROWS, PERMUTATIONS)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(batch["sid"].to_numpy(), keys.shape[1]))], names=["bucket", "sid"])


def stars(links: DataFrame) -> DataFrame:
    """(sid, root): the smallest unit reachable from each unit that has links, but for roots themselves. Links are (a, b) with a > b.

    A unit with very many links is met by the rows of its links in several tasks."""
    spark = links.sparkSession
    edges, at = spool(links.distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = hot_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        mid, mid_at = spool(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large-star")
        root = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = hot_join(mid, root, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new, new_at = spool(small, "small-star")
        discard(spark, at, mid_at)
        edges, at = new, new_at
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("sid"), F.col("b").alias("root"))
        before = tuple(now)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar: 100 * intersection >= percent * union."""
    got = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return got.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _meet(dealt: DataFrame) -> DataFrame:
    """The rows (bucket, sid, size) of buckets with several units."""
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return spool(dealt.join(shared, "bucket").select("bucket", "sid", "size"), "buckets")[0]


def _led(buckets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each unit with the leaders of its buckets, where the sizes of their sets allow a link."""
    fame = buckets.groupBy("sid").agg(F.sum("size").alias("fame"))
    lead = buckets.select("bucket", "sid").join(fame, "sid").groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("sid")).alias("sid"))).alias("top"))
    lead = lead.select("bucket", (-F.col("top.sid")).alias("lead"))
    pairs = hot_join(buckets.select("bucket", "sid"), lead, "bucket").where("sid <> lead").select(F.greatest("sid", "lead").alias("a"), F.least("sid", "lead").alias("b")).distinct()
    return _sized(pairs, sizes, percent)


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    x, y = sizes.select(F.col("sid").alias("a"), F.col("n").alias("na")), sizes.select(F.col("sid").alias("b"), F.col("n").alias("nb"))
    return pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def _prefix_pairs(units: DataFrame, percent: int) -> DataFrame:
    """Of (sid, root, set), the pairs (a, b) of different roots that the prefix filter with positions can't rule out."""
    n = F.size("set")
    rows, _ = spool(units.select("sid", "root", n.alias("n"), F.explode("set").alias("shingle")), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    rare_first = Window.partitionBy("sid").orderBy("df", "shingle")
    ranked = rows.join(often, "shingle").withColumn("i", F.row_number().over(rare_first))
    prefix, _ = spool(ranked.where((100 * (F.col("i") - 1) <= (100 - percent) * F.col("n")) & (F.col("df") > 1)).drop("df"), "prefixes")
    other = prefix.select("shingle", F.col("sid").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    reach = (100 + percent) * (1 + F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib"))) >= percent * (F.col("n") + F.col("nb"))
    sized = 100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")
    return prefix.withColumnRenamed("sid", "a").join(other, "shingle").where((F.col("a") > F.col("b")) & (F.col("root") != F.col("root_b")) & sized & reach).select("a", "b").distinct()


def _divided(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, sid, root) of buckets that hold several components."""
    named = buckets.join(roots, "sid", "left").select("bucket", "sid", F.coalesce("root", "sid").alias("root"))
    state = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return named.join(state, "bucket")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Columns: key, hash (of the text), n_shingles, component_id, kept; one row by row."""
    with scratch(docs.sparkSession) as keep:
        return _components(docs, key, text, percent, keep)


def _components(docs: DataFrame, key: str, text: str, percent: int, keep: list[str]) -> DataFrame:
    t = F.col(text).cast("string")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(t).alias("hash"), t.alias("text"))
    signed_rows, signed_at = spool(rows.mapInArrow(_sign, "key long, hash long, n long, one long, two long, bands array<long>"), "signatures")
    same = Window.partitionBy("one", "two").orderBy("key", "hash")
    units = signed_rows.where("bands is not null").withColumn("i", F.row_number().over(same)).where("i = 1").drop("i")
    units, _ = spool(units.select(F.monotonically_increasing_id().alias("sid"), "*"), "units")
    buckets = _meet(units.select(F.explode("bands").alias("bucket"), "sid"))
    sizes, _ = spool(units.select("sid", "n", "key", "hash").join(buckets.select("sid").distinct(), "sid"), "sizes")
    one_each = rows.groupBy("key", "hash").agg(F.first("text").alias("text"))  # repeated rows meet before the shuffle
    texts = one_each.join(sizes.select("sid", "key", "hash").hint("merge"), ["key", "hash"])  # one plan at every size
    sets, _ = spool(texts.select("sid", "text").mapInArrow(_sets, "sid long, set array<long>"), "sets")
    first, _ = spool(_confirm(_led(buckets, sizes, percent), sets, percent), "confirmed")
    roots = stars(first)
    unsure = _divided(buckets, roots).select("sid").distinct()
    sharp = _meet(sets.join(unsure, "sid").mapInArrow(_deal, "bucket long, sid long"))
    second, _ = spool(_confirm(_led(sharp, sizes, percent), sets, percent), "confirmed")
    roots = stars(first.unionByName(second))
    left, _ = spool(_divided(sharp, roots).select("sid", "root").distinct(), "left")
    pairs = _prefix_pairs(left.join(sets, "sid"), percent)
    third, _ = spool(_confirm(pairs, sets, percent), "confirmed")
    if third.limit(1).count():
        roots = stars(first.unionByName(second).unionByName(third))
    named, _ = spool(units.join(roots, "sid", "left").select("one", "two", "key", F.coalesce("root", "sid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("key").alias("least"))
    worded, bare = signed_rows.where("one is not null"), signed_rows.where("one is null")
    by_set, set_at = spool(hot_join(named, least, "root").select("one", "two", "least"), "classes")
    keep += [signed_at, set_at]
    out = hot_join(worded.select("key", "hash", "n", "one", "two"), by_set, "one", ("two",)).select("key", "hash", "n", "least")
    out = out.unionByName(bare.select("key", "hash", "n", F.col("key").alias("least")))
    component, own = F.nullif("least", F.lit(NO_KEY)), F.nullif("key", F.lit(NO_KEY))
    return out.select(own.alias("key"), "hash", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs with one document of each group left; texts without words all stay.

    Of rows that repeat key and text one stays, that whose columns together have the least hash."""
    found = components(docs, key, text, percent)
    stay = found.where("kept and n_shingles > 0").select(F.coalesce("key", F.lit(NO_KEY)).alias("_key"), F.col("hash").alias("_hash")).distinct()
    t = F.col(text).cast("string")
    worded = F.coalesce(t.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key"), F.xxhash64(t).alias("_hash"))
    kept = rows.join(stay, ["_key", "_hash"]).groupBy("_key", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionByName(docs.where(~worded))
