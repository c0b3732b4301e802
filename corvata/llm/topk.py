"""Exact top-k search by inner product with pivot-table elimination.

Vectors are whole numbers. Adding one component, sqrt(M - |v|^2) to candidates and 0 to queries, with
M the largest squared norm, makes the highest inner product the smallest Euclidean distance, so the
triangle inequality bounds it: for every pivot p, |d(q,p) - d(v,p)| <= d(q,v). The index holds each
candidate's distances to all pivots; the largest of these bounds orders candidates, which are
evaluated until the best bound left can't reach the k-th score found; equal scores are evaluated too,
so ties go to the smaller id. Nothing is approximate: the index only orders and eliminates.

Queries go in blocks of bounded size, each broadcast against all candidates; every task keeps the
best k of what it reads, and these meet by query.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id
take no part; shorter vectors count as padded with zeros. A query meets every row but its own: of
the rows with its id and vector one is left out. Rows that repeat a query id are queries of their
own. Scores are exact 64-bit numbers; vectors so
long that a score could need more (a squared norm of 2**63) raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.spool import discard, spool

PIVOTS = 24
#: Rows from which pivots are picked and first k-th scores taken; only speed depends on them.
SAMPLE = 2048
#: Bytes of one broadcast block of queries.
QUERY_BLOCK_BYTES = 8 << 20


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of all components, null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dim).all():
        return flat.reshape(len(lens), dim)
    out = np.zeros((len(lens), dim), np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, n in enumerate(lens):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


class Space:
    """What all tasks share: dimensions, the largest squared norm, and the pivots."""

    def __init__(self, dim: int, top: float, sample: np.ndarray):
        self.dim, self.top = dim, top
        s = self.lift(sample.astype(float)) if len(sample) else np.zeros((0, dim + 1))
        pick, far = [], np.full(len(s), np.inf)
        while len(pick) < min(PIVOTS, len(s)):  # farthest first
            k = int(far.argmax()) if pick else 0
            pick.append(k)
            far = np.minimum(far, ((s - s[k]) ** 2).sum(axis=1))
        self.pivots = s[pick]

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.top - (v**2).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """pivots x rows"""
        sq = (self.pivots**2).sum(axis=1)[:, None] + (lifted**2).sum(axis=1)[None, :] - 2 * self.pivots @ lifted.T
        return np.sqrt(np.maximum(sq, 0)).astype(np.float32)


class Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, np.iinfo(np.int64).min)
        self.score = [np.zeros(0, np.int64)] * n
        self.id = [np.zeros(0, np.int64)] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor[q]
        if not keep.any():
            return
        s, i = np.concatenate([self.score[q], score[keep]]), np.concatenate([self.id[q], ids[keep]])
        if len(s) > 4 * self.k:
            cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[s >= cut], i[s >= cut]
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], s[order[-1]])


def search_block(best: Best, queries: np.ndarray, q_pivot: np.ndarray, vectors: np.ndarray, ids: np.ndarray, v_pivot: np.ndarray, top: float) -> int:
    """Evaluate candidates for all queries; returns how many pairs were evaluated."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1]) < 2**52
    v = vectors.astype(float) if exact else vectors
    done = 0
    for q in range(len(queries)):
        x = queries[q].astype(float) if exact else queries[q]
        norm = float((queries[q].astype(float) ** 2).sum())
        bound = np.abs(v_pivot[0] - q_pivot[0, q]) if len(v_pivot) else np.zeros(len(ids), np.float32)
        for p in range(1, len(v_pivot)):
            np.maximum(bound, np.abs(v_pivot[p] - q_pivot[p, q]), out=bound)
        slack = 1e-3 * (norm + top) ** 0.5 + 1e-3  # of single-precision distances
        most = (norm + top - np.maximum(bound - slack, 0) ** 2) / 2 + 1  # no score is higher
        left = np.flatnonzero(most >= best.floor[q])
        left = left[np.argsort(-most[left], kind="stable")]
        at, step = 0, 4 * best.k
        while at < len(left) and most[left[at]] >= best.floor[q]:
            part = left[at : at + step]
            best.add(q, np.rint(v[part] @ x).astype(np.int64) if exact else v[part] @ x, ids[part])
            at, step = at + len(part), step * 4
        done += min(at, len(left))
    return done


def search(rows: DataFrame, k: int, is_query: Column, vector: str = "embedding", id_col: str = "vec_id", scale: int = 64, query_block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Columns: query_id, rank, vec_id, score: each query's k best among all other rows."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), is_query.alias("is_query")).where("id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim, top, n = base.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    if top >= 2.0**63:
        raise OverflowError("scores of these vectors don't fit a 64-bit column")
    dim = max(1, dim)
    share = min(1.0, 2.0 * SAMPLE / n)
    sample = base.where(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("id", "v").limit(SAMPLE).toArrow()
    sample_v, sample_id = _matrix(sample["v"], dim), sample["id"].to_numpy()
    space = Space(dim, float(top), sample_v)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space  # PIVOTS vectors; they travel with the function
        for b in batches:
            d = s.distances(s.lift(_matrix(b["v"], s.dim).astype(float)))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array([c.tobytes() for c in np.ascontiguousarray(d.T)], pa.binary())], names=["id", "v", "d"])

    index, _ = spool(base.select("id", "v").mapInArrow(measure, "id long, v array<long>, d binary"), "pivot-table")
    queries, queries_at = spool(base.where("is_query").select(F.monotonically_increasing_id().alias("row"), "id", "v"), "queries")
    n_blocks = max(1, -(-queries.count() * dim * 8 // query_block_bytes))
    parts = []
    for block in range(n_blocks):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block)
        got = own.sort("row").toArrow()  # one block, of about query_block_bytes
        q = _matrix(got["v"], dim)
        first = Best(len(q), k + 1)
        if len(q) and len(sample_id):
            search_block(first, q, space.distances(np.column_stack([q, np.zeros(len(q))]).astype(float)), sample_v, sample_id, space.distances(space.lift(sample_v.astype(float))), space.top)
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), q, space.distances(np.column_stack([q, np.zeros(len(q))]).astype(float)), first.floor, block))
        parts.append(_search_part(index, sent, space, k))
        if n_blocks > 1:
            parts[-1], _ = spool(parts[-1], "top-part")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if n_blocks > 1:
        discard(spark, queries_at)
    query = Window.partitionBy("block", "q")
    ranked = found.withColumn("n", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    ranked = ranked.withColumn("own", F.min(F.when(own, F.col("n"))).over(query)).where("own is null or n <> own")
    ranked = ranked.withColumn("rank", (F.col("n") - F.when(F.col("n") > F.col("own"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_part(index: DataFrame, sent, space: Space, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, q_pivot, floor, block = sent.value
        best = Best(len(q), k + 1)
        best.floor = floor.copy()  # of k + 1 rows that all tasks know of
        for b in batches:
            if len(q) and b.num_rows:
                d = np.frombuffer(b"".join(b["d"].to_pylist()), np.float32).reshape(b.num_rows, -1).T
                search_block(best, q, q_pivot, _matrix(b["v"], space.dim), b["id"].to_numpy(), np.ascontiguousarray(d), space.top)
        own = (q * q).sum(axis=1)
        for i in range(0, len(q), 4096):
            n = [len(s) for s in best.score[i : i + 4096]]
            at = np.repeat(np.arange(i, i + len(n)), n)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), pa.array(ids[at]), pa.array(own[at]), pa.array(cat(best.id[i : i + 4096])), pa.array(cat(best.score[i : i + 4096]))], names=["block", "q", "query_id", "self", "vec_id", "score"])

    return index.mapInArrow(run, "block long, q long, query_id long, self long, vec_id long, score long")
