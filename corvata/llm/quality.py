"""Quality scores by Bradley-Terry pairwise ranking.

Each document is a short vector of statistics of its whole text (character classes, words, lines,
repetition). Every pair of a good and a bad labelled document is a preference; the weights minimise
the mean logistic loss on differences of their features, with a small ridge. The threshold is the
quantile of all training scores at the training share of bad rows, so as many rows are rejected as
labels say; the score is the logistic function of the distance from it.

Nothing is sampled. Pairs needn't be laid out: what a row adds to the loss hangs on its own score and
on how those of the other kind are spread, so each step of Newton's method takes one pass over all
labelled rows that counts scores by class on a fine grid, and one that sums slopes and bends. Up to
LOCAL_ROWS rows the passes run in the driver, beyond as Spark jobs over written features, of which
the driver sees sums alone.

Defined results: a null text counts as empty and is scored like one; labels that are null or not 0
or 1 are skipped; without rows of both labels every score is 0.5. Repeated rows count once. Texts of any length are read half a megabyte at a time.
All columns of the input ride along in ``row``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvata.llm.spool import scratch, spool
from corvata.llm.textblocks import BLOCK_BYTES, SPACE, U64, WORD, Block, blocks, carried, mix, words

#: Labelled rows, about 700 bytes each, up to which the passes over all of them run in the driver.
LOCAL_ROWS = 16_384
#: Pairs that the tests' plain version draws; the model here is of all pairs.
PAIRS = 30_000
#: Steps of the grid of scores: for slopes; the least for bends, which has up to COARSE places. TASKS bounds the sums that reach the driver.
FINE, BEND, COARSE, TASKS = 1 / 256, 32, 96, 48
#: Features of hashed words, and as many of hashed pairs of neighbouring words.
HASHED = 64
RIDGE = 1e-3

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"%", b"&", b"$", b"#", b"*", b"@_~^=+", b"<>{}[]\\/", b"\"'`;:()-"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)  #: the last one: control characters and bytes of other characters
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_K = len(_CLASSES) + 1


def _repeated(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """By text, the weight of those names that stood in the same text before."""
    if not len(doc):
        return np.zeros(n)
    key = mix(name + doc.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(doc), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[again], weight[again], minlength=n)


def _hashed(doc: np.ndarray, name: np.ndarray, n: int) -> np.ndarray:
    """texts x HASHED: square roots of the shares of names by hash."""
    flat = np.bincount(doc * HASHED + (mix(name) >> U64(58)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    return np.sqrt(flat / np.maximum(flat.sum(axis=1, keepdims=True), 1))


def _parts(b: Block, limit: int) -> Iterator[Block]:
    """One long text in parts that end after white space."""
    at, n = 0, len(b.data)
    while at < n:
        end = min(n, at + limit)
        while end < n and not SPACE[b.data[end - 1]]:
            end += 1
        yield Block(b.first, b.data[at:end], np.array([0, end - at], np.int64), b.null)
        at = end


def _line_sums(b: Block, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text the bytes of lines that stood in it before, and its number of lines."""
    edge = np.unique(np.concatenate([b.offs, np.flatnonzero(b.data == 10) + 1])).astype(np.int64)
    ls, le = edge[:-1], edge[1:]
    if not len(ls):
        return np.zeros(b.n), np.zeros(b.n)
    ldoc = doc[ls]
    return _repeated(ldoc, WORD.of(WORD.prefix(b.data), ls, le), (le - ls).astype(float), b.n), np.bincount(ldoc, minlength=b.n)


def _long_line_sums(b: Block) -> tuple[np.ndarray, np.ndarray]:
    seen: set[bytes] = set()
    again = lines = 0
    for m in re.finditer(rb"[^\n]*\n|[^\n]+$", b.data.tobytes()):
        name = hashlib.blake2b(m[0], digest_size=12).digest()
        again += len(m[0]) if name in seen else 0
        lines += 1
        seen.add(name)
    return np.array([float(again)]), np.array([lines])


def features(b: Block, limit: int = BLOCK_BYTES) -> np.ndarray:
    """texts x features, float64. One long text is read limit bytes at a time; its words' digests stay, 8 bytes each."""
    n, lens = b.n, b.lens
    size = np.maximum(lens, 1)[:, None]
    if n == 1 and len(b.data) > limit:
        found = [(p, *words(p)) for p in _parts(b, limit)]
        share = sum(np.bincount(_CLASS[p.data], minlength=_K) for p, *_ in found).reshape(1, _K) / size
        h, sizes = np.concatenate([f[3] for f in found]), np.concatenate([f[2] - f[1] for f in found])
        first = np.concatenate([p.data[s] for p, s, _, _ in found])
        wdoc = np.zeros(len(h), np.int64)
        dup, lines = _long_line_sums(b)
    else:
        doc = np.repeat(np.arange(n, dtype=np.int64), lens)
        share = np.bincount(doc * _K + _CLASS[b.data], minlength=n * _K).reshape(n, _K) / size
        s, e, h = words(b)
        sizes, first, wdoc = e - s, b.data[s], doc[s]
        dup, lines = _line_sums(b, doc)
    dup = dup / size[:, 0]
    count = np.bincount(wdoc, minlength=n)
    nw = np.maximum(count, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    adjacent = np.bincount(wdoc[same], minlength=n) / nw
    capital = np.bincount(wdoc, (first >= 65) & (first <= 90), minlength=n) / nw
    alone = np.bincount(wdoc, sizes == 1, minlength=n) / nw
    length = np.bincount(wdoc, sizes, minlength=n) / nw
    spread = np.sqrt(np.maximum(np.bincount(wdoc, sizes**2.0, minlength=n) / nw - length**2, 0))
    again = _repeated(wdoc, h, np.ones(len(h)), n) / nw
    per_line = np.log1p(count / np.maximum(lines, 1))
    base = np.column_stack([np.sqrt(share), np.log1p(lens), np.log1p(count), length.clip(0, 40), spread.clip(0, 40), again, again**2, adjacent, np.sqrt(adjacent), capital, alone, dup, np.sqrt(dup), np.log1p(lines), per_line])
    pair = wdoc[1:] == wdoc[:-1]
    said = _hashed(wdoc, h, n), _hashed(wdoc[1:][pair], (h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])[pair], n)
    return np.column_stack([base, *said])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) * self.weights).sum(axis=1)  # the same for a row in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.raw(x) - self.threshold).clip(-500, 500)))


Chunks = Iterator[tuple[np.ndarray, np.ndarray]]  #: labels and features of some rows
Passes = Callable[[Callable[[Chunks], object]], list]  #: runs a function over all rows; gives what it made of each share of them


def _moments(at: np.ndarray):
    """Rows, good ones, and sums and squares of features less those of one row, at."""

    def run(chunks: Chunks):
        n, good, total, squares = 0, 0, np.zeros(len(at)), np.zeros(len(at))
        for y, x in chunks:
            d = x.astype(float) - at
            n, good, total, squares = n + len(y), good + int((y == 1).sum()), total + d.sum(axis=0), squares + (d * d).sum(axis=0)
        return n, good, total, squares

    return run


def _split(s: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The place on a grid at or below each score, and the share that belongs to the next one."""
    at = np.floor(s / step)
    return at.astype(np.int64), s / step - at


def _spread(m: Model):
    """How many scores of bad and of good rows are at each place of the fine grid."""

    def run(chunks: Chunks):
        places, counts = np.zeros(0, np.int64), np.zeros((0, 2))
        for y, x in chunks:
            at, up = _split(m.raw(x), FINE)
            kind = np.column_stack([y == 0, y == 1]).astype(float)
            places, back = np.unique(np.concatenate([places, at, at + 1]), return_inverse=True)
            rows = np.concatenate([counts, kind * (1 - up)[:, None], kind * up[:, None]])
            counts = np.column_stack([np.bincount(back, rows[:, c], minlength=len(places)) for c in (0, 1)])
        return places, counts

    return run


def _against(counts: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """At each place of the fine grid, the kernel of (every other place's score less its own), weighted by counts."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    back = kernel(np.arange(n - 1, -n, -1) * FINE)
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(back, size), size)[n - 1 : 2 * n - 1]


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp((-v).clip(-500, 500)))


def _bend(v: np.ndarray) -> np.ndarray:
    return _logistic(v) * _logistic(-v)


def _slopes(m: Model, first: int, slope: np.ndarray, coarse: int, bend: np.ndarray):
    """Sums over rows: features by slope, their products by bend, and features by class and place of the coarse grid.

    slope: by class, at the places of the fine grid from the first on; bend: at those of the coarse one, coarse fine places apart.
    """

    def run(chunks: Chunks):
        d = len(m.mean)
        s1, s2, s3 = np.zeros(d), np.zeros((d, d)), np.zeros((2, bend.shape[1], d))
        for y, x in chunks:
            s, z = m.raw(x), m.scaled(x)
            for c in (0, 1):
                zc, fine = z[y == c], s[y == c] / FINE - first
                at, up = _split(fine * FINE, coarse * FINE)
                s1 += np.interp(fine, np.arange(slope.shape[1]), slope[c]) @ zc
                s2 += (zc * np.interp(fine / coarse, np.arange(bend.shape[1]), bend[c])[:, None]).T @ zc
                for place, share in ((at, 1 - up), (at + 1, up)):
                    order = np.argsort(place, kind="stable")
                    edge = np.flatnonzero(np.diff(place[order], prepend=-1))
                    if len(edge):
                        s3[c, place[order][edge]] += np.add.reduceat((zc * share[:, None])[order], edge)
        return s1, s2, s3

    return run


def _between(m: Model, lo: float, hi: float, most: int):
    """Scores below lo, by part of [lo, hi], the least above it, those in it while they are not more than most, and the ends of those."""

    def run(chunks: Chunks):
        below, parts, above, inside, least, last = 0, np.zeros(most, np.int64), np.inf, np.zeros(0), np.inf, -np.inf
        for _, x in chunks:
            s = m.raw(x)
            below += int((s < lo).sum())
            above = min(above, s[s > hi].min(initial=np.inf))
            got = s[(s >= lo) & (s <= hi)]
            parts += np.bincount(_part(got, lo, hi, most), minlength=most)
            inside = np.concatenate([inside, got])[: most + 1]
            least, last = min(least, got.min(initial=np.inf)), max(last, got.max(initial=-np.inf))
        return below, parts, above, inside, least, last

    return run


def _part(s: np.ndarray, lo: float, hi: float, parts: int) -> np.ndarray:
    return np.minimum((s - lo) / max(hi - lo, 1e-300) * parts, parts - 1).astype(np.int64)


def _quantile(passes: Passes, m: Model, n: int, share: float, most: int = 4096) -> float:
    """np.quantile of all scores: the range where it lies is cut into as many parts as most, again until so few are left or all of them are equal."""
    place = share * (n - 1)
    k = int(place)
    hi = 8 * float(np.abs(m.weights).sum()) + 1
    lo = -hi
    for _ in range(64):
        got = passes(_between(m, lo, hi, most))
        below, parts, above = sum(g[0] for g in got), sum(g[1] for g in got), min(g[2] for g in got)
        inside = np.sort(np.concatenate([g[3] for g in got]))
        least, last = min(g[4] for g in got), max(g[5] for g in got)
        if parts.sum() <= most:
            break
        if least == last:
            inside = np.full(parts.sum(), least)
            break
        p = int(np.searchsorted(np.cumsum(parts) + below, k, side="right"))
        width = (hi - lo) / most
        new = max(lo, lo + width * (p - 1)), min(hi, lo + width * (p + 2))  # a part to either side, for rounding
        if new == (lo, hi):  # neighbours among floats, each the score of many rows
            return float(least if k - below < parts[: most // 2].sum() else last)
        lo, hi = max(new[0], least), min(new[1], last)
    here = inside[k - below]
    after = inside[k - below + 1] if k - below + 1 < len(inside) else above
    return float(here if place == k or not np.isfinite(after) else here + (place - k) * (after - here))


def _learn(passes: Passes, one: np.ndarray, ridge: float) -> Model | None:
    """The model of all pairs; one: any row's features."""
    one = one.astype(float)
    n, n_good, total, squares = (sum(p) for p in zip(*passes(_moments(one)), strict=True))
    each = np.array([n - n_good, n_good])
    if not each.all():
        return None
    scale = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    m = Model(one + total / n, np.where(scale > 1e-9, scale, 1.0), np.zeros(len(one)), 0.0)
    best, old, step = np.inf, m.weights, np.zeros(len(one))
    for _ in range(40):
        spread = passes(_spread(m))
        first = min(p[0] for p, _ in spread if len(p))
        size = max(p[-1] for p, _ in spread if len(p)) - first + 1
        coarse = max(BEND, -(-size // COARSE))
        size = -(-size // coarse) * coarse + 1  # the last place is one of the coarse grid
        counts = np.zeros((2, size))
        for p, c in spread:
            counts[:, p - first] += c.T
        bad, good = counts / each[:, None]
        loss = float(good @ _against(bad, lambda v: np.logaddexp(0, v))) + ridge / 2 * float(m.weights @ m.weights)
        if loss > best + 1e-9 and np.abs(step).max() > 1e-5:
            step = step / 2
            m.weights = old + step
            continue
        if np.abs(step).max() < 1e-5 and best < np.inf:
            break
        best, old = loss, m.weights
        slope = np.stack([-_against(good, lambda v: _logistic(-v)), _against(bad, _logistic)])
        places = np.arange(0, size, coarse)
        both = _bend((places[:, None] - places) * FINE)
        at, up = np.divmod(np.arange(size), coarse)
        held = np.stack([np.bincount(at, k * (1 - up / coarse), minlength=len(places) + 1)[: len(places)] + np.bincount(at + 1, k * up / coarse, minlength=len(places) + 1)[: len(places)] for k in (bad, good)])
        s1, s2, s3 = (sum(p) for p in zip(*passes(_slopes(m, first, slope / each[:, None], coarse, (held @ both)[::-1] / each[:, None])), strict=True))
        across = (s3[1] / n_good).T @ both @ (s3[0] / (n - n_good))
        step = np.linalg.solve(s2 - across - across.T + ridge * np.eye(len(one)), s1 - ridge * old)
        m.weights = old + step
    m.threshold = _quantile(passes, m, n, (n - n_good) / n)
    return m


def train(x: np.ndarray, label: np.ndarray, pairs: int | None = None, ridge: float = RIDGE) -> Model | None:
    """The model of all pairs of these rows; None without both kinds. pairs is not used any more: all count."""
    known = np.isin(label, (0, 1))
    x, label = x[known], label[known]
    if not len(x):
        return None
    return _learn(lambda f: [f((label[i : i + 4096], x[i : i + 4096]) for i in range(0, len(x), 4096))], x[0], ridge)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch["text"]):
            made = pa.array([r.tobytes() for r in features(b).astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(b.first, b.n) for c in ("key", "h")), made], names=["key", "h", "x"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch["x"].to_pylist()
    return batch["label"].to_numpy(), np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1)


def _jobs(rows: DataFrame) -> Passes:
    """Passes as Spark jobs."""

    def passes(f: Callable[[Chunks], object]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(_arrays(b) for b in batches if b.num_rows))], pa.binary())], names=["made"])

        return [pickle.loads(r.made) for r in rows.coalesce(TASKS).mapInArrow(run, "made binary").collect()]

    return passes


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", ridge: float = RIDGE) -> Model | None:
    """Learn from every labelled row; None without both kinds."""
    with scratch(docs.sparkSession):
        labels = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label")).distinct()
        texts = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("key is not null")
        made = texts.withColumn("h", F.xxhash64("key", "text")).select("key", "h", "text").mapInArrow(_features, "key string, h long, x binary")
        # Of all documents, since features are a third of the mean text, which a join would shuffle; never broadcast, so that disk grows with the input alone.
        both = made.join(labels.hint("merge"), "key").dropDuplicates(["key", "label", "h"])
        rows, _ = spool(both.sortWithinPartitions("h", "label").select("label", "x"), "features")
        n = rows.count()
        if not n:
            return None
        if n > LOCAL_ROWS:
            return _learn(_jobs(rows), np.frombuffer(bytes(rows.first().x), np.float32), ridge)
        got = sorted((r.label, bytes(r.x)) for r in rows.collect())
        return train(np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(n, -1), np.array([y for y, _ in got]), ridge=ridge)


def score(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (struct of all columns, or of those in carry), score, predicted (1 from the threshold on)."""
    state = docs.select(carried(docs, carry), F.col(text).cast("string").alias("text"))
    if model is None:
        return state.select("row", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(features(b)) for b in blocks(batch["text"])]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return state.mapInArrow(run, state.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
