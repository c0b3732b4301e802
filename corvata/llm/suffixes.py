"""Suffix-array dedup: which bytes lie in a string of LENGTH bytes that starts elsewhere too.

Distributed prefix doubling. A position's rank stands for its first 2, then 4, ... units of UNIT bytes:
Spark sorts the pairs (rank of the position, rank of the position an offset further on; at first,
names of their first unit), numbers equal pairs alike in sort order, drops positions whose pair is
unique, and doubles the offset; the last step overlaps. Done at every byte this would sort the corpus many times over, so
content decides which positions can have a partner at all:

* Every window of LENGTH bytes is anchored at its lowest-hashed SEED-gram (the leftmost of equals), so
  equal windows have equal anchors at equal distances. Neighbouring windows with one anchor form a
  range. Ranges whose whole strings are equal are one row from there on, with a count; their bytes
  are known to repeat. Ranges whose SEED-gram no other range has can't repeat and drop out.
* Of the others, the positions ranked are those a whole number of units from the anchor. Equal
  windows agree in all of these that they hold, so a window whose ranked positions are unique doesn't
  repeat. Ranks grow to the whole units that every window of UNIT neighbouring ones (a cell) holds.
* Cells whose rank is shared are extended to LENGTH at every byte: in narrower cells, by the bytes
  left and right of the ranked string, until cells are single windows.

Rows of equal strings are counted before they are shuffled where they meet, and joins on ranks are
salted, so hot passages don't grow a task. Comparisons are by 64-bit ranks of 64-bit fingerprints while
filtering and by 128-bit digests of whole strings where bytes are found to repeat. Texts are shuffled
twice, short rows otherwise; a text of any length is looked at half a megabyte at a time.

Defined results: a null text counts as empty; texts shorter than LENGTH keep everything unless a
longer string covers them (it can't: matches never cross texts). Rows that repeat key and text are
copies of each other, so both lose what is long enough. All columns ride along in ``row``, or those
that ``carry`` names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvata.llm.hot import hot_join
from corvata.llm.spool import discard, scratch, spool
from corvata.llm.textblocks import BLOCK_BYTES, U64, Block, Fingerprint, Seen, blocks, carried, firsts, mix, pieces, signed

LENGTH, SEED = 400, 64
#: A range's place holds its first window, its number of windows less one, and its anchor in it.
_BITS = 12
NULL_KEY = -(2**63)
_ONE, _TWO = Fingerprint(31), Fingerprint(32)
_K = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(v)
    pad = np.full((-n) % w, np.iinfo(v.dtype).max, v.dtype)
    x = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def ranges(b: Block, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, rank, digest, digest) of every range; places in the text."""
    z = np.zeros(0, np.int64)
    has = np.flatnonzero(b.lens >= length)
    if not len(has):
        return z, z, z, z, z, z, z
    c1, c2 = _ONE.prefix(b.data), _TWO.prefix(b.data)
    rank = mix(_ONE.windows(c1, seed))
    low = sliding_min((rank & U64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=U64), length - seed + 1)
    count = b.lens[has] - length + 1
    skip = np.repeat(b.offs[has] - (np.cumsum(count) - count), count)
    p = np.arange(count.sum()) + skip
    a = (low[p] & U64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(a, prepend=-1))
    lo, hi, a = p[edge], p[np.append(edge[1:], len(p)) - 1], a[edge]
    shape = (a - lo).astype(U64) * _K[0] + (hi - lo).astype(U64) * _K[1]
    one = mix(_ONE.of(c1, lo, hi + length) + shape)
    two = mix(_TWO.of(c2, lo, hi + length) + shape)
    doc = np.repeat(has, count)[edge]
    at = b.offs[doc]
    return doc, lo - at, hi - at, a - at, signed(rank[a]), signed(one), signed(two)


_ROW = "rank long, one long, two long, key long, hash long, place long, n long"


def _batch(cols: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=[x.split()[0] for x in names.split(", ")])


def _join_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans of one text that touch or overlap; sorted by (doc, start), with ends that don't fall."""
    if not len(doc):
        return doc, start, end
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def _bounded(b: Block, length: int) -> Iterator[tuple[Block, int]]:
    """The block, or where it is one long text, parts of it with the place where each starts; parts overlap by length - 1 bytes."""
    n = len(b.data)
    if b.n > 1 or n <= BLOCK_BYTES + length:
        yield b, 0
        return
    for at in range(0, n - length + 1, BLOCK_BYTES):
        data = b.data[at : at + BLOCK_BYTES + length - 1]
        yield Block(b.first, data, np.array([0, len(data)], np.int64), b.null), at


def _find_ranges(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n > 0: a range, and how many equal ones the task has met (2 for more); else -n bytes from place on are settled."""
        seen = Seen()
        for batch in batches:
            keys, hashes = batch["key"].to_numpy(), batch["hash"].to_numpy()
            for b, at_byte in (p for b in blocks(batch["text"]) for p in _bounded(b, length)):
                doc, lo, hi, a, rank, one, two = ranges(b, length, seed)
                if not len(doc):
                    continue
                lo, hi, a = lo + at_byte, hi + at_byte, a + at_byte
                order, at = firsts(one, two)
                size = np.diff(np.append(at, len(order)))
                first = order[at]
                known, told = seen.meet(one[first], two[first], size > 1)
                settled = np.sort(order[np.repeat(known | (size > 1), size)])
                first, count = first[~told], (size + known)[~told]
                sd, ss, se = _join_spans(doc[settled], lo[settled], hi[settled] + length)
                place = (lo << (2 * _BITS)) | ((hi - lo) << _BITS) | (a - lo)
                spread = np.arange(len(sd))
                k, h = keys[b.first + doc], hashes[b.first + doc]
                yield _batch([np.append(rank[first], spread * 0), np.append(one[first], signed(mix(spread.astype(U64) + U64(b.first)))), np.append(two[first], spread), np.append(k[first], keys[b.first + sd]), np.append(h[first], hashes[b.first + sd]), np.append(place[first], ss), np.append(np.minimum(count, 2), ss - se)], _ROW)

    return run


_SNIPPET = "key long, hash long, anchor long, before long, rank long, n long, bytes binary, low long, high long"


def _cut_snippets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each unsettled range's bytes: before of them stand left of the anchor; distances low to high of window starts to it."""
        mask = (1 << _BITS) - 1
        for batch in (p for x in batches for p in pieces(x, "text")):
            cols: list[list] = [[] for _ in range(9)]
            for text, key, h, found in zip(batch["text"], batch["key"], batch["hash"], batch["found"], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for f in found.as_py():
                    place = f["place"]
                    lo, wide, a = place >> (2 * _BITS), (place >> _BITS) & mask, place & mask
                    for c, x in zip(cols, (key.as_py(), h.as_py(), lo + a, a, f["rank"], f["n"], data[lo : lo + wide + length], a - wide, a), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in _SNIPPET.split(", ")])

    return run


_CELL = "rank long, one long, two long, sid long, cell long, key long, hash long, start long, end long, n long"


def _unit_pairs(length: int, unit: int):
    """Pairs of names of each ranked position's first and second unit bytes; a name holds the rank of the anchor and the place k to it, in units."""
    held = (length - unit + 1) // unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                snip = part["bytes"].to_pylist()
                data = np.frombuffer(b"".join(snip), np.uint8)
                base = np.cumsum([0, *map(len, snip)])[:-1].astype(np.int64)
                first = -(part["high"].to_numpy() // unit)
                count = held - part["low"].to_numpy() // unit - first
                src = np.repeat(np.arange(len(snip)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[src]
                at = (base + part["before"].to_numpy())[src] + k * unit
                c = _ONE.prefix(data)
                name = signed(mix(_ONE.of(c, at, at + unit) * _K[0] + mix(part["rank"].to_numpy().view(U64)[src] + k.astype(U64) * _K[1])))
                one = np.flatnonzero(src[1:] == src[:-1]) if held > 1 else np.arange(len(src))  # positions with another one behind them
                two = one + 1 if held > 1 else one
                yield pa.RecordBatch.from_arrays([part["sid"].take(pa.array(src[one])), pa.array(k[one]), part["n"].take(pa.array(src[one])), pa.array(name[one]), pa.array(name[two])], names=["sid", "k", "n", "r1", "r2"])

    return run


def _rerank(pairs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Of rows (sid, k, n, r1, r2), (sid, k, n, rank): equal pairs numbered alike in their sort order; unique ones, and those of settled ranges alone, drop out."""
    pairs = pairs.withColumn("pair", F.xxhash64("r1", "r2"))
    met = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("rows"), F.max((F.col("n") == 1).cast("int")).alias("open")).where("rows > 1 and open = 1")
    ranks = met.sort("r1", "r2").select(F.xxhash64("r1", "r2").alias("pair"), F.monotonically_increasing_id().alias("rank"))
    return spool(hot_join(pairs.select("sid", "k", "n", "pair"), ranks, "pair").select("sid", "k", "n", "rank"), name)


def _doubled(snippets: DataFrame, length: int, unit: int) -> tuple[DataFrame, str]:
    """(sid, cells): of each range the cells, (rank, cell, n), whose ranked string of whole units others have too."""
    held = (length - unit + 1) // unit
    first = snippets.select("sid", "bytes", "before", "low", "high", "rank", "n").mapInArrow(_unit_pairs(length, unit), "sid long, k long, n long, r1 long, r2 long")
    have = min(2, held)
    state, at = _rerank(first, f"rank{have}")
    while have < held:
        offset = min(have, held - have)
        ahead = state.select("sid", (F.col("k") - offset).alias("k"), F.col("rank").alias("r2"))
        new, new_at = _rerank(state.withColumnRenamed("rank", "r1").join(ahead, ["sid", "k"]), f"rank{have + offset}")
        discard(snippets.sparkSession, at)
        state, at, have = new, new_at, have + offset
    return state.where("k <= 0").groupBy("sid").agg(F.collect_list(F.struct("rank", (-F.col("k")).alias("cell"), "n")).alias("cells")), at


def _make_cells(length: int, seed: int, wide: int, parent: int, held: int):
    """Cells of wide window starts, by distance to the anchor, from those of parent; held: bytes ranked there, 0 for all that its windows share."""
    top = length - seed  # the largest distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in (p for x in batches for p in (x.slice(i, 512) for i in range(0, x.num_rows, 512))):
            snip = batch["bytes"].to_pylist()
            data = np.frombuffer(b"".join(snip), np.uint8)
            base = np.concatenate([[0], np.cumsum([len(s) for s in snip])[:-1]]).astype(np.int64)
            get = {c: batch[c].to_numpy() for c in ("sid", "key", "hash", "anchor", "before", "low", "high")}
            src, cell, rank, n, first_d, last_d = [], [], [], [], [], []
            for i, cells in enumerate(batch["cells"].to_pylist()):
                low, high = int(get["low"][i]), int(get["high"][i])
                for c in cells:
                    d0, d1 = c["cell"] * parent, min(c["cell"] * parent + parent - 1, top)
                    for k in range(max(low, d0) // wide, min(high, d1) // wide + 1):
                        src.append(i)
                        cell.append(k)
                        rank.append(c["rank"])
                        n.append(c["n"])
                        first_d.append(d0)
                        last_d.append(d1)
            src, cell, n = np.array(src, np.int64), np.array(cell, np.int64), np.array(n, np.int64)
            old = np.array(rank, np.int64).view(U64)
            d0, d1 = np.array(first_d, np.int64), np.array(last_d, np.int64)
            c0, c1 = cell * wide, np.minimum(cell * wide + wide - 1, top)
            a = base[src] + get["before"][src]
            p1, p2 = _ONE.prefix(data), _TWO.prefix(data)
            ranked_from = a - d0
            ranked_to = ranked_from + held if held else a - d1 + length
            left, right = _ONE.of(p1, a - c0, ranked_from), _ONE.of(p1, ranked_to, a - c1 + length)
            new = signed(mix(old * _K[0] + mix(left * _K[1] + cell.astype(U64) * _K[3]) + right * _K[2]))
            e0, e1 = np.maximum(c0, get["low"][src]), np.minimum(c1, get["high"][src])
            shape = e0.astype(U64) * _K[0] + e1.astype(U64) * _K[1]
            one = signed(mix(_ONE.of(p1, a - e1, a - e0 + length) + shape))
            two = signed(mix(_TWO.of(p2, a - e1, a - e0 + length) + shape))
            start, end = get["anchor"][src] - e1, get["anchor"][src] - e0 + length
            order, at = firsts(new, one, two)
            total = np.add.reduceat(n[order], at) if len(at) else n
            first = order[at]
            size = np.diff(np.append(at, len(order)))
            known, told = seen.meet(one[first] ^ new[first], two[first], total > 1)
            settled = order[np.repeat(known | (size > 1), size)]
            settled = settled[n[settled] == 1]
            so = np.lexsort((start[settled], src[settled]))
            sd, ss, se = _join_spans(src[settled][so], start[settled][so], end[settled][so])
            first, total = first[~told], (total + known)[~told]
            pad = np.zeros(len(sd), np.int64)
            spread = signed(mix(np.arange(len(sd), dtype=U64)))
            yield _batch([np.append(new[first], spread), np.append(one[first], spread), np.append(two[first], pad), np.append(get["sid"][src[first]], pad), np.append(cell[first], pad), np.append(get["key"][src[first]], get["key"][sd]), np.append(get["hash"][src[first]], get["hash"][sd]), np.append(start[first], ss), np.append(end[first], se), np.append(np.minimum(total, 2), pad - 1)], _CELL)

    return run


def _classes(met: DataFrame) -> DataFrame:
    """Of rows (rank, n, ...), one by distinct string: those whose rank has others and an unsettled one."""
    ranks = met.groupBy("rank").agg(F.count(F.lit(1)).alias("_all"), F.max((F.col("n") == 1).cast("int")).alias("_one")).where("_all > 1 and _one = 1").select("rank")
    return hot_join(met, ranks, "rank")


def _finisher(as_text: bool):
    return lambda batches: _finish(batches, as_text)


def _merged(found: list | None) -> list[list[int]]:
    """Spans of one text, those that touch or overlap made one."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut_runs(length: int):
    """Of runs of repeated shorter strings the text, from a character to a character, where a repeated string of length bytes fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for x in batches for p in pieces(x, "text")):
            cols: list[list] = [[], [], [], []]
            for text, key, h, found in zip(batch["text"], batch["key"], batch["hash"], batch["found"], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for s, e in _merged(found.as_py()):
                    if e - s < length:
                        continue
                    while s > 0 and data[s] & 0xC0 == 0x80:
                        s -= 1
                    while e < len(data) and data[e] & 0xC0 == 0x80:
                        e += 1
                    for c, x in zip(cols, (key.as_py(), h.as_py(), s, data[s:e].decode("utf-8", "surrogatepass")), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=["key", "hash", "base", "text"])

    return run


def _finish(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in (p for x in batches for p in pieces(x, "text")):
        texts, size, gone, spans, sha = [], [], [], [], []
        for t, f in zip(batch["text"], batch["found"], strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            removed = _merged(f.as_py())
            kept, at = [], 0
            for s, e in removed:
                kept.append(data[at:s])
                at = e
            left = b"".join([*kept, data[at:]])
            texts.append(left.decode("utf-8", "ignore") if as_text else left)
            size.append(len(data))
            gone.append(len(data) - len(left))
            spans.append([{"start": s, "end": e} for s, e in removed])
            sha.append(hashlib.sha256(left).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = [batch["row"], pa.array(texts, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(sha, pa.string())]
        names = ["row", "kept", "n_bytes", "n_removed", "removed", "kept_sha256"]
        if "passages" in batch.schema.names:
            cols.append(pa.array([sum(e - s for s, e in _merged(f.as_py())) for f in batch["passages"]], pa.int64()))
            names.append("n_repeated")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int | None = None) -> DataFrame:
    """key, hash (of the row's key and text), start, end: spans whose union is what repeats. length up to 4000."""
    with scratch(docs.sparkSession) as keep:
        return _repeats(_rows(docs, key, text), length, seed, keep)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    k, t = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)), F.col(text).cast("string")
    return docs.select(k.alias("key"), F.xxhash64(F.col(key).cast("long"), t).alias("hash"), t.alias("text"))


def _repeats(rows: DataFrame, length: int, seed: int | None, keep: list[str]) -> DataFrame:
    spark = rows.sparkSession
    seed = seed or min(SEED, max(1, length // 4))
    rows = rows.where(F.octet_length("text") >= length)
    string = Window.partitionBy("one", "two")
    made = rows.mapInArrow(_find_ranges(length, seed), _ROW)
    made = made.withColumn("all", F.sum(F.greatest("n", F.lit(0))).over(string)).withColumn("i", F.row_number().over(string.orderBy("key", "hash", "place")))
    met, met_at = spool(made.select("rank", "key", "hash", "place", "n", "all", "i"), "ranges")
    keep.append(met_at)
    found = [
        met.where("n < 0").select("key", "hash", F.col("place").alias("start"), (F.col("place") - F.col("n")).alias("end")),
        met.where("n = 1 and all > 1").select("key", "hash", F.expr(f"shiftright(place, {2 * _BITS})").alias("start"), F.expr(f"shiftright(place, {2 * _BITS}) + (shiftright(place, {_BITS}) & {(1 << _BITS) - 1}) + {length}").alias("end")),
    ]
    open_ranges = _classes(met.where("n > 0 and i = 1").select("rank", "key", "hash", "place", F.least("all", F.lit(2)).cast("long").alias("n")))
    by_doc = open_ranges.groupBy("key", "hash").agg(F.collect_list(F.struct("place", "rank", "n")).alias("found"))
    one_row = rows.join(by_doc, ["key", "hash"]).select("key", "hash", "text", "found")
    cut = one_row.mapInArrow(_cut_snippets(length), _SNIPPET)
    snippets, _ = spool(cut.select(F.monotonically_increasing_id().alias("sid"), "*"), "snippets")
    unit = 1 << (seed.bit_length() - 1)
    left, left_at = _doubled(snippets, length, unit)
    wide, parent, held = unit, unit, (length - unit + 1) // unit * unit
    while True:
        state = snippets.join(left, "sid")
        cells = state.select("sid", "key", "hash", "anchor", "before", "low", "high", "bytes", "cells").mapInArrow(_make_cells(length, seed, wide, parent, held), _CELL)
        string = Window.partitionBy("rank", "one", "two")
        cells = cells.withColumn("all", F.sum(F.greatest("n", F.lit(0))).over(string)).withColumn("i", F.row_number().over(string.orderBy("key", "hash", "start")))
        done, done_at = spool(cells.where("n < 0 or all > 1 or i = 1").drop("one", "two"), f"cells{wide}")
        keep.append(done_at)
        discard(spark, *([left_at] if held else []))
        found.append(done.where("n < 0 or (n = 1 and all > 1)").select("key", "hash", "start", "end"))
        if wide == 1:
            break
        left = _classes(done.where("n > 0 and i = 1").select("rank", "sid", "cell", F.least("all", F.lit(2)).cast("long").alias("n")))
        left = left.groupBy("sid").agg(F.collect_list(F.struct("rank", "cell", "n")).alias("cells"))
        parent, wide, held = wide, max(1, wide // 8), 0
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _both(rows: DataFrame, length: int, shorter: int, seed: int | None) -> DataFrame:
    """(key, hash, found, passages): spans of strings of length bytes that repeat, and of shorter ones.

    Whatever repeats at the length lies in runs of what repeats at the shorter one, at each of its places; so only those runs are searched again.
    """
    spans = F.collect_list(F.struct("start", "end"))
    with scratch(rows.sparkSession) as keep:
        with scratch(rows.sparkSession) as here:
            passages, at = spool(_repeats(rows.where(F.octet_length("text") >= shorter), shorter, seed, []).groupBy("key", "hash").agg(spans.alias("passages")), "passages")
            here.append(at)
            keep.append(at)
        long = passages.where(F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]) >= length)
        cut = rows.join(long.withColumnRenamed("passages", "found"), ["key", "hash"]).select("key", "hash", "text", "found").mapInArrow(_cut_runs(length), "key long, hash long, base long, text string")
        runs, at = spool(cut.select(F.xxhash64("key", "hash", "base").alias("run"), F.xxhash64(F.lit("second"), "base", "hash", "key").alias("run2"), "*"), "runs")
        keep.append(at)
        again = _repeats(runs.select(F.col("run").alias("key"), F.col("run2").alias("hash"), "text"), length, seed, keep).withColumnsRenamed({"key": "run", "hash": "run2"})
        found = again.join(runs.select("run", "run2", "key", "hash", "base").distinct(), ["run", "run2"]).select("key", "hash", (F.col("start") + F.col("base")).alias("start"), (F.col("end") + F.col("base")).alias("end"))
    return passages.join(found.groupBy("key", "hash").agg(spans.alias("found")), ["key", "hash"], "left")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int | None = None, as_text: bool = False, carry: list[str] | None = None, shorter: int | None = None) -> DataFrame:
    """Columns: row (struct of all columns, or of those in carry), kept (bytes, or as text without characters cut in two), n_bytes, n_removed, removed (byte spans), kept_sha256.

    With a shorter length also n_repeated: bytes in strings of that many bytes that repeat, which stay unless longer ones cover them.
    """
    if shorter is not None and not 0 < shorter <= length:
        raise ValueError("shorter is more than length")
    by_doc = repeats(docs, key, text, length, seed).groupBy("key", "hash").agg(F.collect_list(F.struct("start", "end")).alias("found")) if shorter is None else _both(_rows(docs, key, text), length, shorter, seed)
    more = [] if shorter is None else ["passages"]
    k, t = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)), F.col(text).cast("string")
    state = docs.select(carried(docs, carry), k.alias("key"), F.xxhash64(F.col(key).cast("long"), t).alias("hash"), t.alias("text")).join(by_doc, ["key", "hash"], "left").select("row", "text", "found", *more)
    count = [F.lit(0).cast("long").alias("n_repeated") for _ in more]
    schema = state.select("row", F.lit("" if as_text else b"").alias("kept"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.lit("").alias("kept_sha256"), *count).schema
    return state.mapInArrow(_finisher(as_text), schema)
