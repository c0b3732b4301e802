"""Numpy views of Arrow text: blocks of whole texts as one byte array, words and fingerprints.

Every helper works on a block, that is half a megabyte of whole UTF-8 texts laid end to end, so
memory is bounded by BLOCK_BYTES or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text looked at at once: a worker needs up to 150 times as much.
BLOCK_BYTES = 1 << 19
U64 = np.uint64


@dataclass
class Block:
    first: int  #: row of the first text in its batch
    data: np.ndarray  #: uint8, all texts end to end
    offs: np.ndarray  #: int64, n + 1 offsets into data
    null: np.ndarray  #: bool by text

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.offs)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[Block]:
    """Cut an Arrow string column into blocks of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    step = min(rows, 256)  # what is converted at once; a block may end earlier
    for base in range(0, len(column), step):
        part = column.slice(base, step)
        null = np.asarray(part.is_null())
        part = part.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        bufs, n = part.buffers(), len(part)
        offs = np.frombuffer(bufs[1], dtype=np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
            j = min(n, max(j, i + 1))
            yield Block(base + i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j])
            i = j


def pieces(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about limit bytes of a text column each."""
    for b in blocks(batch[column], limit, rows):
        yield batch.slice(b.first, b.n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Fingerprint:
    """Polynomial fingerprints of substrings modulo 2**64 from prefix sums; two seeds give 128 bits.

    A byte b stands for a seeded random odd-mixed 64-bit number, so low bits are well spread.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        base = int(rng.integers(0, 2**63)) * 2 + 1
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.pow = self.inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                p = np.full(n, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """C with C[j] - C[i] the weighted sum of bytes i..j-1."""
        n = len(data)
        self._grow(n + 1)
        c = np.empty(n + 1, U64)
        c[0] = 0
        np.cumsum(self.table[data] * self.pow[:n], dtype=U64, out=c[1:])
        return c

    def of(self, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Fingerprints of data[i:j], the same wherever the bytes stand."""
        return (c[j] - c[i]) * self.inv[i]

    def windows(self, c: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of all substrings of one length, by start."""
        n = len(c) - length
        return (c[length:] - c[:n]) * self.inv[:n] if n > 0 else np.zeros(0, U64)


WORD = Fingerprint(20240601)

#: ASCII capitals to small letters; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space is 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(block: Block, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a block: (starts, ends, fingerprints); no word crosses a text's end."""
    data = LOWER[block.data]
    inside = ~separator[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = block.offs[1:-1]
    cut = cut[cut < len(data)]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    c = WORD.prefix(data)
    return s, e, mix(WORD.of(c, s, e) + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts): rows sorted by the columns, the first one leading, ties as they stand."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(new)


class Seen:
    """Strings (two digests each) that a task has met in earlier blocks, up to CAP of them, and which were told to be repeated.

    So a string that is in every block costs a task two rows, not one a block. What is forgotten costs rows, never results.
    """

    CAP = 1 << 18

    def __init__(self, places: int = 0) -> None:
        """places: columns of a place that orders rows of a string; a row before all that were met is told again."""
        self.one, self.two, self.told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.place = [np.zeros(0, np.int64)] * places

    def meet(self, one: np.ndarray, two: np.ndarray, again: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct strings of a block (again: the block itself repeats them): which are known, and which need not be told any more."""
        at = np.searchsorted(self.one, one)
        at[at == len(self.one)] = 0
        known = np.zeros(len(one), bool)
        if len(self.one):
            known = (self.one[at] == one) & (self.two[at] == two)
        told = np.zeros(len(one), bool)
        told[known] = self.told[at[known]]
        if place and known.any():
            before, level = np.zeros(len(one), bool), known.copy()
            for mine, theirs in zip(place, self.place, strict=True):
                before |= level & (mine < theirs[at])
                level &= mine == theirs[at]
            told &= ~before
            for mine, theirs in zip(place, self.place, strict=True):
                theirs[at[before]] = mine[before]
        if known.any():
            self.told[at[known]] = True
        if len(self.one) + len(one) > self.CAP:
            self.one, self.two, self.told = self.one[:0], self.two[:0], self.told[:0]
            self.place = [p[:0] for p in self.place]
        new = np.flatnonzero(~known)
        new = new[np.argsort(one[new], kind="stable")]
        to = np.searchsorted(self.one, one[new])
        self.one, self.two, self.told = (np.insert(a, to, b) for a, b in ((self.one, one[new]), (self.two, two[new]), (self.told, again[new])))
        self.place = [np.insert(a, to, b[new]) for a, b in zip(self.place, place, strict=True)]
        return known, told


def carried(rows: DataFrame, carry: list[str] | None) -> Column:
    """The struct ``row`` that rides along: all columns, or those named."""
    return F.struct(*[F.col(f"`{c}`") for c in (rows.columns if carry is None else carry)]).alias("row")
