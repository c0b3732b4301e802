"""Language identification by nearest centroid.

A text is the L2-normalised TF-IDF vector of its hashed byte trigrams (ASCII letters lower-cased,
other ASCII read as space). Training clusters the vectors of each language into several unit
centroids by spherical k-means; a text takes the language of the centroid of highest cosine. A text
whose cosine distance is over the radius learned for that language is marked rejected.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; with
nothing learned every text is ``und``; ties between languages go to the first in sort order.
Texts of any length are read half a megabyte at a time.
Training rows with a null text or language are skipped, and repeated ones count once. All columns of the input ride along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvata.llm.spool import spool
from corvata.llm.textblocks import BLOCK_BYTES, LOWER, Block, blocks, carried

DIMS = 4096
#: Languages learned, those of most documents; a column of garbage can't make the model grow.
LANGUAGES = 256
#: Documents learned from, by language, in expectation; each sends at most 24 KB to the driver.
SAMPLE_PER_LANGUAGE = 400
CLUSTERS = 4
#: A training quantile of distances to the nearest centroid, times a margin, is a language's radius.
RADIUS_QUANTILE, RADIUS_MARGIN = 0.995, 1.25
_ROWS = 512

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def trigram_counts(block: Block, limit: int = BLOCK_BYTES) -> np.ndarray:
    """texts x DIMS counts of hashed trigrams; those with a space in the middle, or two, are left out. One long text is read in parts."""
    n = len(block.data)
    if block.n > 1 or n <= limit + 2:
        return _trigram_counts(block)
    out = np.zeros((1, DIMS), np.float32)
    for at in range(0, n - 2, limit):
        part = block.data[at : at + limit + 2]
        out += _trigram_counts(Block(block.first, part, np.array([0, len(part)], np.int64), block.null))
    return out


def _trigram_counts(block: Block) -> np.ndarray:
    d = _FOLD[block.data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros((block.n, DIMS), np.float32)
    code = ((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20)
    doc = np.repeat(np.arange(block.n, dtype=np.int64), block.lens)
    use = (d[1:-1] != 32) & (doc[:-2] == doc[2:])
    flat = np.bincount(doc[:-2][use] * DIMS + code[use], minlength=block.n * DIMS)
    return flat.reshape(block.n, DIMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  #: all languages' centroids, one below the other
    owner: np.ndarray  #: index into languages by centroid
    radius: np.ndarray  #: by language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, cosine) of each row."""
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        return self.owner[best], cos[np.arange(len(cos)), best].clip(0, 1).round(5)


def _spherical_kmeans(x: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        nearest = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[nearest == i].sum(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))]))
    return c


def train(langs: list[str], counts: np.ndarray, clusters: int = CLUSTERS, seed: int = 7) -> Model:
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(np.log1p(counts) * idf)
    names = sorted(set(langs))
    lang = np.array([names.index(v) for v in langs])
    parts, radius = [], []
    for i in range(len(names)):
        own = x[lang == i]
        c = _spherical_kmeans(own, clusters, seed + i)
        parts.append(c)
        radius.append(RADIUS_MARGIN * float(np.quantile(1 - (own @ c.T).max(axis=1), RADIUS_QUANTILE)))
    owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(parts)])
    return Model(names, idf, np.concatenate(parts).astype(np.float32), owner, np.array(radius))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, clusters: int = CLUSTERS, seed: int = 7, languages: int = LANGUAGES) -> Model | None:
    """Learn from a hashed sample of about per_language rows of each of the most frequent languages; None without rows."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
    sizes, _ = spool(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages), "language-sizes")  # a row by language, of known size: joining it shuffles no texts
    share = F.pmod("h", F.lit(1_000_000)) / 1_000_000.0
    sample = rows.join(sizes, "lang").where(share < F.lit(float(per_language)) / F.col("count")).dropDuplicates(["lang", "h"]).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch["text"], rows=_ROWS):
                counts = trigram_counts(b)
                at = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(b.first, b.n), pa.array([x.astype(np.uint16).tobytes() for x in at], pa.binary()), pa.array([counts[i, x].tobytes() for i, x in enumerate(at)], pa.binary())], names=["lang", "at", "n"])

    got = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in sample.mapInArrow(sparse, "lang string, at binary, n binary").collect())
    if not got:
        return None
    counts = np.zeros((len(got), DIMS), np.float32)
    for i, (_, at, n) in enumerate(got):
        counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return train([g[0] for g in got], counts, clusters, seed)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns: row (struct of all columns, or of those in carry), lang_pred, score, rejected."""
    state = docs.select(carried(docs, carry), F.when(has_letters(F.col(text)), F.col(text).cast("string")).alias("text"))
    if model is None:
        return state.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # languages x CLUSTERS x DIMS floats; it travels with the function
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            langs, scores, far = [], [], []
            for b in blocks(batch["text"], rows=_ROWS):
                i, cos = m.nearest(trigram_counts(b))
                langs += np.where(b.null, "und", names[i]).tolist()
                scores += np.where(b.null, 0.0, cos).tolist()
                far += (b.null | (1 - cos > m.radius[i])).tolist()
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    schema = state.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return state.mapInArrow(run, schema)
