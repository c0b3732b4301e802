"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 16 bytes has four zero bits at its top and no
such place lies in the 16 bytes before, so cuts depend on nearby content alone and find themselves
again after an insertion; longer chunks are cut every MAX_CHUNK bytes. Cuts stand between characters.
Chunks are compared by 128-bit digest over the whole corpus. Where a run of neighbouring chunks that
all occur more than once reaches MIN_RUN bytes, each of them is removed unless it is the first
occurrence, in order of (key, digest of the text, position).

Copies that a task has met are counted before the shuffle, so a chunk that a third of all texts hold
sends two rows a task, or a few more where keys fall. Texts of any length are cut half a megabyte at a time.

Defined results: a null text counts as empty; empty texts have no chunks and keep nothing; a null key
sorts first; rows that repeat key and text own and lose the same chunks, as one document. All columns
of the input ride along in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.textblocks import BLOCK_BYTES, U64, Block, Fingerprint, Seen, blocks, carried, mix, pieces, signed

WINDOW, ZERO_BITS, GAP, MAX_CHUNK, MIN_RUN = 16, 4, 16, 512, 80

_GEAR = np.random.default_rng(5).integers(0, 2**16, 256, dtype=np.uint16)
_ONE, _TWO = Fingerprint(51), Fingerprint(52)
NULL_KEY = -(2**63)


def cuts(b: Block) -> np.ndarray:
    """Ends of all chunks of a block, in order; every text ends a chunk."""
    return _cuts(b)[0]


def _cuts(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and those of them that content alone decides."""
    d, n = b.data, len(b.data)
    h = _GEAR[d]
    for k in (1, 2, 4, 8):  # h[i] of the 2k bytes up to i
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    at = np.flatnonzero(h >> np.uint16(16 - ZERO_BITS) == 0) + 1
    doc = np.searchsorted(b.offs, at - 1, side="right") - 1
    inside = (at - b.offs[doc] >= WINDOW) & (at < b.offs[doc + 1])
    at, doc = at[inside], doc[inside]
    at_char = (d[at] & 0xC0) != 0x80
    at, doc = at[at_char], doc[at_char]
    apart = np.ones(len(at), bool)
    apart[1:] = (np.diff(at) > GAP) | (doc[1:] != doc[:-1])
    chosen = at[apart]
    ends = np.unique(np.concatenate([chosen, b.offs[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > MAX_CHUNK)
    if len(long):
        more = [np.arange(starts[i] + MAX_CHUNK, ends[i], MAX_CHUNK) for i in long]
        more = np.concatenate(more)
        for _ in range(3):
            cont = (more < n) & ((d[np.minimum(more, n - 1)] & 0xC0) == 0x80)
            more = more + cont
        ends = np.unique(np.concatenate([ends, more]))
    return ends, chosen


def chunk_parts(b: Block, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """chunks of a block; of one long text about limit bytes at a time, each part from a cut that content decides on, with the bytes before it that later cuts hang on."""
    n = len(b.data)
    if b.n > 1 or n <= limit:
        yield chunks(b)
        return
    at, take = 0, limit
    while at < n:
        lead = min(at, 4 * (WINDOW + GAP))
        data = b.data[at - lead : at + take]
        part = Block(b.first, data, np.array([0, len(data)], np.int64), b.null)
        ends, chosen = _cuts(part)
        last = len(data) if at + take >= n else int(chosen[-1]) if len(chosen) and chosen[-1] > lead else 0
        if not last:
            take *= 2  # no cut in all of it: a run without any change
            continue
        ends = ends[(ends > lead) & (ends <= last)]
        starts = np.concatenate([[lead], ends[:-1]])
        one, two = _digests(part, starts, ends)
        yield np.zeros(len(ends), np.int64), starts + at - lead, ends - starts, one, two
        at, take = at - lead + last, limit


def _digests(b: Block, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (e - s).astype(U64)
    return signed(mix(_ONE.of(_ONE.prefix(b.data), s, e) + n)), signed(mix(_TWO.of(_TWO.prefix(b.data), s, e) + n))


def chunks(b: Block) -> tuple[np.ndarray, ...]:
    """(text, start in the text, length, digest, digest) of every chunk."""
    if not len(b.data):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    e = cuts(b)
    s = np.concatenate([[0], e[:-1]])
    doc = np.searchsorted(b.offs, s, side="right") - 1
    one, two = _digests(b, s, e)
    return doc, s - b.offs[doc], e - s, one, two


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (one, two, key, hash, start, size, n): n = 0 for copies settled in the block, else copies of the chunk that the task has met (2 for more)."""
    seen = Seen(3)
    for batch in batches:
        keys, hashes = batch["key"].to_numpy(), batch["hash"].to_numpy()
        for b, (doc, start, size, one, two) in ((b, c) for b in blocks(batch["text"]) for c in chunk_parts(b)):
            if not len(doc):
                continue
            key, h = keys[b.first + doc], hashes[b.first + doc]
            order = np.lexsort((start, h, key, two, one))
            new = np.ones(len(order), bool)
            o1, o2 = one[order], two[order]
            new[1:] = (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(order)))
            lead = order[new]
            known, told = seen.meet(one[lead], two[lead], count > 1, key[lead], h[lead], start[lead])
            n = np.zeros(len(order), np.int64)
            n[lead[~told]] = np.minimum(count + known, 2)[~told]
            first = n > 0
            rest = np.flatnonzero(~first)  # settled: join neighbours
            edge = np.ones(len(rest), bool)
            edge[1:] = (doc[rest[1:]] != doc[rest[:-1]]) | (start[rest[1:]] != start[rest[:-1]] + size[rest[:-1]])
            begin = np.flatnonzero(edge)
            total = np.add.reduceat(size[rest], begin) if len(begin) else np.zeros(0, np.int64)
            parts = np.diff(np.append(begin, len(rest)))
            rest = rest[begin]
            spread = signed(mix(np.arange(len(rest), dtype=U64) + h[rest].view(U64)))  # settled rows meet nothing
            cols = [np.concatenate([a[first], z]) for a, z in ((one, spread), (two, spread), (key, key[rest]), (h, h[rest]), (start, start[rest]), (size, total), (n, -parts))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["one", "two", "key", "hash", "start", "size", "n"])


def settle(size: int, found: list[tuple[int, int, int, bool]]) -> tuple[list[tuple[int, int]], int]:
    """(removed byte runs, repeated chunks) of a text with repeated pieces (start, size, chunks, first)."""
    own = {(s, n) for s, n, _, first in found if first}
    pieces = sorted({(s, n, k) for s, n, k, _ in found})
    removed: list[tuple[int, int]] = []
    count, i = 0, 0
    while i < len(pieces):
        j, end = i, pieces[i][0]
        while j < len(pieces) and pieces[j][0] <= end:
            end = max(end, pieces[j][0] + pieces[j][1])
            j += 1
        if end - pieces[i][0] >= MIN_RUN:
            for s, n, k in pieces[i:j]:
                count += k
                if (s, n) in own:
                    continue
                if removed and removed[-1][1] >= s:
                    removed[-1] = (removed[-1][0], max(removed[-1][1], s + n))
                else:
                    removed.append((s, s + n))
        i = j
    return removed, count


def cut_out(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in removed:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for x in batches for p in pieces(x, "text")):
        texts, size, gone, spans, reps, sha = [], [], [], [], [], []
        for t, f in zip(batch["text"], batch["found"], strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            removed, count = settle(len(data), [tuple(x.values()) for x in f.as_py() or ()])
            kept = cut_out(data, removed) if removed else data
            texts.append(kept.decode("utf-8", "surrogatepass"))
            size.append(len(data))
            gone.append(len(data) - len(kept))
            spans.append([{"start": s, "end": e} for s, e in removed])
            reps.append(count)
            sha.append(hashlib.sha256(kept).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = [batch["row"], pa.array(texts, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(reps, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "kept", "n_bytes", "n_removed", "removed", "n_repeated_chunks", "kept_sha256"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (struct of all columns, or of those in carry), kept, n_bytes, n_removed, removed (byte spans), n_repeated_chunks, kept_sha256."""
    k, t = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)), F.col(text).cast("string")
    hashed = F.xxhash64(F.col(key).cast("long"), t)
    rows = docs.where(F.octet_length(t) > 0).select(k.alias("key"), hashed.alias("hash"), t.alias("text"))
    made = rows.mapInArrow(_emit, "one long, two long, key long, hash long, start long, size long, n long")
    packed = made.select("one", "two", "key", "hash", F.expr("shiftleft(start, 32) | size").alias("place"), "n")
    digest = Window.partitionBy("one", "two").orderBy("key", "hash", "place")
    met = packed.withColumn("first", (F.row_number().over(digest) == 1) & (F.col("n") > 0)).withColumn("all", F.sum(F.greatest("n", F.lit(0))).over(Window.partitionBy("one", "two")))
    found = met.where("n < 0 or all > 1").select("key", "hash", "place", F.when(F.col("n") < 0, -F.col("n")).otherwise(1).alias("n"), "first")
    by_doc = found.groupBy("key", "hash").agg(F.collect_list(F.struct(F.expr("shiftright(place, 32)").alias("start"), F.expr("place & 4294967295").alias("size"), "n", "first")).alias("found"))
    whole_docs = docs.select(carried(docs, carry), k.alias("key"), hashed.alias("hash"), t.alias("text"))
    state = whole_docs.join(by_doc, ["key", "hash"], "left").select("row", "text", "found")
    schema = state.select("row", F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.lit(0).cast("long").alias("n_repeated_chunks"), F.lit("").alias("kept_sha256")).schema
    return state.mapInArrow(_finish, schema)
