"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A pattern
is a window of consecutive item words, or a whole item of fewer words. Patterns of one length share
a table: a block is a pair of neighbouring words; the shift table says how far the search may jump
when a block ends at the current position; where the shift is 0 the block's bucket holds the
patterns that end in it, and comparing all words confirms an occurrence.

Defined results: a null or empty text has no words and no hits; an item without words matches
nothing; an item whose id is null marks words but is not counted or listed; rows that repeat an id
are one item; no benchmark rows means nothing is hit. A text of any
length is split into words as a whole, which takes some 20 times its size. Any other columns ride
along in ``row``, or those that ``carry`` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvata.llm.spool import spool
from corvata.llm.textblocks import carried

WINDOW = 10
#: Benchmark text in one broadcast table; a larger benchmark is searched for in several passes.
TABLE_BYTES = 4 << 20

_LOWER_AND_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_AND_SPACE).split() if text else []


class WuManber:
    """Search tables for word patterns of any lengths, one table per length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.tables = []
        for length in sorted({len(p) for p in patterns}):
            block = min(2, length)
            shift: dict = {}
            bucket: dict = {}
            for p, ids in patterns.items():
                if len(p) != length:
                    continue
                for end in range(block, length + 1):
                    b = p[end - block : end]
                    shift[b] = min(shift.get(b, length), length - end)
                bucket.setdefault(p[length - block :], {})[p] = ids
            self.tables.append((length, block, shift, bucket))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, ids) of every occurrence."""
        n = len(w)
        for length, block, shift, bucket in self.tables:
            jump, i = length - block + 1, length
            get = shift.get
            while i <= n:
                s = get((w[i - 2], w[i - 1]) if block == 2 else (w[i - 1],), jump)
                if s:
                    i += s
                    continue
                found = bucket[tuple(w[i - block : i])].get(tuple(w[i - length : i]))
                if found is not None:
                    yield i - length, i, found
                i += 1


def patterns_of(items: list[tuple[object, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        w = split_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = out.setdefault(tuple(w[i : i + window]), set())
            if item_id is not None:
                ids.add(str(item_id))
    return out


def _searcher(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wm = WuManber(table.value)
        for batch in batches:
            n_words, n_hit, marks, items = [], [], [], []
            for text, old, ids in zip(batch["text"], batch["marks"], batch["items"], strict=True):
                w = split_words(text.as_py())
                hit = None if old.as_py() is None else np.unpackbits(np.frombuffer(old.as_py(), np.uint8), count=len(w))
                found = set(ids.as_py() or ())
                for i, j, names in wm.search(w):
                    if hit is None:
                        hit = np.zeros(len(w), np.uint8)
                    hit[i:j] = 1
                    found |= names
                n_words.append(len(w))
                n_hit.append(0 if hit is None else int(hit.sum()))
                marks.append(None if hit is None else np.packbits(hit).tobytes())
                items.append(sorted(found))
            cols = [batch["row"], batch["text"], pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "marks", "items", "n_words", "n_hit"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Columns: row (struct of all columns of docs, or of those in carry), n_words, n_hit, items (sorted ids as strings), contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()  # repeated items count once
    size = items.agg(F.sum(F.octet_length("t")), F.count(F.lit(1))).first()
    passes = max(1, -(-int(size[0] or 0) // table_bytes))
    state = docs.select(carried(docs, carry), F.col(text).cast("string").alias("text"), F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    schema = state.select("row", "text", "marks", "items", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit")).schema
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(passes)) == k)
        table = spark.sparkContext.broadcast(patterns_of([tuple(r) for r in part.collect()], window))  # of about TABLE_BYTES of text
        state = state.select("row", "text", "marks", "items").mapInArrow(_searcher(table), schema)
        if k + 1 < passes:
            state = spool(state, "decontaminate")[0]
    return state.select("row", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))
