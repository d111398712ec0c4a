"""Helpers shared by the text operators: Arrow views of text, hashed words and shingles, salted joins, checkpoints.

Everything here is a small per-batch helper; Spark partitions, shuffles and joins the work.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

from fenmark.session import remove, shared_folder

#: Bytes that are looked at together; what a batch needs besides its text and its results is a small multiple of this.
BLOCK = 1 << 18
#: Written tables up to the first size on disk, and the second one as rows, may be broadcast.
SMALL, SMALL_ROWS = 8 << 20, 64 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
BYTE_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BLOCK + 1 powers of BASE and of its inverse modulo 2**64."""
    both = []
    for b in (BASE, INVERSE):
        a = np.full(BLOCK + 1, b, dtype=np.uint64)
        a[0] = 1
        both.append(np.multiply.accumulate(a))
    return both[0], both[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column one after the other, and their n + 1 offsets. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `most` bytes."""
    data, offs = flat(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def _pieces(data: np.ndarray, offs: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial, first and end byte of each run of word bytes of a row in data[a:b]."""
    inside = IS_WORD[data[a:b]]
    edges = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, b, "left")] - a
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers()
    total = np.zeros(b - a + 1, np.uint64)
    np.cumsum(BYTE_CODES[LOWER[data[a:b]]] * up[: b - a], out=total[1:])
    return (total[end] - total[start]) * down[start], start + a, end + a


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and end byte of each word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of a chunk.

    Texts of any length are read in blocks; a word that a block's end cuts, however long, is put together from its pieces.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    parts = [_pieces(data, offs, a, min(a + BLOCK, len(data))) for a in range(0, len(data), BLOCK)]
    value, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    cut = np.flatnonzero((start[1:] == end[:-1]) & (start[1:] % BLOCK == 0)) + 1
    cut = cut[~np.isin(start[cut], offs)]
    head = -1
    for k in cut.tolist():
        head = head if head >= 0 and end[head] == start[k] else k - 1
        value[head : head + 1] += value[k : k + 1] * np.uint64(pow(BASE, int(start[k] - start[head]), 1 << 64))
        end[head] = end[k]
    value, start, end = (np.delete(x, cut) for x in (value, start, end))
    return mix(value + (end - start).astype(np.uint64)), np.searchsorted(offs, start, "right") - 1, start, end


def shingles(hashed: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with 1 to k - 1 words gives its whole sequence as one."""
    m = len(hashed) - k + 1
    parts, rows = [], []
    if m > 0:
        acc = hashed[:m].copy()
        for j in range(1, k):
            acc = acc * np.uint64(BASE) + hashed[j : j + m]
        same = row[:m] == row[k - 1 : k - 1 + m]
        parts.append(mix(acc[same]))
        rows.append(row[:m][same])
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, len(row)])
        for f, c in zip(first[count < k], count[count < k], strict=True):
            acc = np.uint64(c)
            with np.errstate(over="ignore"):
                for x in hashed[f : f + c]:
                    acc = acc * np.uint64(BASE) + x
            parts.append(mix(np.array([acc], np.uint64)))
            rows.append(row[f : f + 1])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    hashed, row, _, _ = words(data, offs)
    sh, at = shingles(hashed, row, k)
    order = np.lexsort((sh, at))
    sh, at = sh[order], at[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
    sh, at = sh[new], at[new]
    edge = np.searchsorted(at, np.arange(len(offs)))
    for i in range(len(offs) - 1):
        yield sh[edge[i] : edge[i + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Scratch:
    """Tables in the shared folder that cut lineage. On leaving the block all are removed but those passed to keep().

    Written tables rather than checkpoint(): a checkpoint keeps its plan's size estimate, a product over joins whose digits double
    with each round of a loop.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, {}, set()

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def bytes_of(self, df: DataFrame) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def is_small(self, df: DataFrame, most: int = SMALL) -> bool:
        """Whether a table of this block has at most `most` bytes as written, and at most SMALL_ROWS as rows: repetitive columns take
        little room on disk."""
        if self.bytes_of(df) > most:
            return False
        wide = [F.coalesce(F.octet_length(f.name) if isinstance(f.dataType, StringType | BinaryType) else 8 * F.size(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType | BinaryType | ArrayType | MapType)]
        row = functools.reduce(lambda a, b: a + b, wide, F.lit(16 * len(df.columns)))
        return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= SMALL_ROWS

    def small(self, df: DataFrame, most: int = SMALL) -> DataFrame:
        """A table of this block, marked for broadcast if it is small; else Spark's joins shuffle it."""
        return F.broadcast(df) if self.is_small(df, most) else df

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(id(df))
        return df

    def drop(self, df: DataFrame) -> None:
        path, _ = self.paths.pop(id(df))
        remove(self.spark, path)

    def __exit__(self, *_: object) -> None:
        for k, (_, df) in list(self.paths.items()):
            if k not in self.kept:
                self.drop(df)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: Column, how: str = "inner", salts: int = 8) -> DataFrame:
    """left join right where left may hold very many rows of one key and right has few rows a key: each key's left rows are dealt
    over `salts` partitions by salt_by, and right's thin rows are repeated as often."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def each_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: f on every non-empty batch. At the end the memory of batches goes back, as workers wait for their next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)
        b = None
        pa.default_memory_pool().release_unused()

    return run
