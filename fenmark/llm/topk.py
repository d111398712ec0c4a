"""Operator 5, exact top-k search by inner product: tiled matrix products, partial selection in each tile, merging by a tree.

Candidates are packed into tiles and queries into blocks, each a matrix in one row. `TILES` tiles and `BLOCKS` blocks that are dealt
to one group meet in a task, a matrix product a pair, of which each query keeps its k best. So a tile is shuffled once for each
`BLOCKS` blocks, and a block once for each `TILES` tiles. Lists of a query are merged `FAN` groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch

TILE_ROWS, BLOCK_ROWS = 4096, 1024
TILES, BLOCKS = 4, 16
FAN = 16
#: Products whose sums stay below this are exact in doubles.
EXACT = float(1 << 53)

PACKED = "ids binary, vectors binary, width int"


def quantised(column: str) -> F.Column:
    """floor(256 * x) of each component x, as a double. One that does not fit 64 bits is an error."""

    def one(x: F.Column) -> F.Column:
        y = x.cast("double") * 256
        return F.when(F.abs(y) < float(1 << 63), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component beyond 64 bits")).cast("long"))

    return F.transform(column, one)


def usable(column: str) -> F.Column:
    """The vector is not null and has finite components only."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, v) into matrices of at most `most` rows, shorter vectors padded with zeros."""
        ids, rows = [], []

        def out() -> pa.RecordBatch:
            width = max(1, *map(len, rows))
            full = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                full[i, : len(r)] = r
            if len(full) and full.min() >= -(1 << 31) and full.max() < 1 << 31:
                full = full.astype(np.int32)
            made = [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary()), pa.array([width], pa.int32())]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["ids", "vectors", "width"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v"), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy())
                if len(ids) >= most:
                    yield out()
        if ids:
            yield out()

    return run


def _matrix(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(ids, np.int64)
    return at, np.frombuffer(vectors, np.int32 if len(vectors) == 4 * len(at) * width else np.int64).reshape(len(at), width)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products. Sums that do not fit 64 bits are an error, not wrong numbers."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * width
    if most < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most >= float(1 << 63):
        raise OverflowError("inner products beyond 64 bits")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query the k best rows of a tile: query, row and score. cid is in order, so that ties fall to the smaller."""
    scores = _products(q, c)
    own, ids, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(qid)):
        s = scores[i]
        at = np.flatnonzero(cid != qid[i]) if qid[i] in cid else None
        t = s if at is None else s[at]
        if len(t) > k:
            least = np.partition(t, len(t) - k)[len(t) - k]
            keep = np.flatnonzero(t >= least)
        else:
            keep = np.arange(len(t))
        keep = keep[np.argsort(-t[keep], kind="stable")[:k]]
        own.append(np.full(len(keep), qid[i]))
        ids.append(cid[keep if at is None else at[keep]])
        best.append(t[keep])
    return [np.concatenate(x) for x in (own, ids, best)]


def _meet(k: int):
    def run(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        """Every tile of a group with every block of it."""
        found = []
        for r in tiles.to_pylist():
            cid, c = _matrix(r["ids"], r["vectors"], r["width"])
            order = np.argsort(cid, kind="stable")
            cid, c = cid[order], c[order]
            for b in range(len(blocks)):
                own, ids, best = _best(*_matrix(*(blocks[x][b].as_py() for x in ("ids", "vectors", "width"))), cid, c, k)
                found.append(pa.table({"part": pa.array(np.full(len(own), r["a"], np.int64)), "query_id": own, "vec_id": ids, "score": best}))
        none = pa.array([], pa.int64())
        return pa.concat_tables(found) if found else pa.table({x: none for x in ("part", "query_id", "vec_id", "score")})

    return run


def _dealt(packed: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """packed, dealt into n_own groups (column `own`) and once for each of the n_other groups that its group meets (column `other`)."""
    named = packed.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n_own)).cast("long"))
    return named.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id, v) its k best rows of vectors (vec_id, v), v arrays of longs.

    The score is the integer inner product; ties go to the smaller vec_id, and rows with the query's own vec_id are left out. A
    query with fewer candidates gets all, with none no row. Of vectors of different lengths the longer one's rest counts as zero.
    Rows with a null vec_id take no part. A repeated query id gives its list once; repeated candidates count as often as they come.
    Without queries or vectors there are no rows. v must not be null or hold nulls (usable() tells). Products whose sum may not fit
    64 bits are an error.
    """
    with Scratch(vectors.sparkSession) as scratch:
        tiles = scratch.table(vectors.where("vec_id is not null").select("vec_id", "v").mapInArrow(_pack(TILE_ROWS), PACKED))
        blocks = queries.where("vec_id is not null").select("vec_id", "v").dropDuplicates(["vec_id"]).mapInArrow(_pack(BLOCK_ROWS), PACKED)
        blocks = scratch.table(blocks)
        left, n = (max(1, -(-x.count() // each)) for x, each in ((tiles, TILES), (blocks, BLOCKS)))
        # every group of the stated queries meets every group of tiles; either holds thousands of vectors
        meets = _dealt(tiles, "a", left, "b", n).groupBy("a", "b").cogroup(_dealt(blocks, "b", n, "a", left).groupBy("a", "b"))
        best = scratch.keep(scratch.table(meets.applyInArrow(_meet(k), "part long, query_id long, vec_id long, score long")))
    order = [F.desc("score"), F.asc("vec_id")]
    while True:
        left = -(-left // FAN)
        best = best.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(left)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
        if left <= 1:
            return best.select("query_id", "rank", "vec_id", "score")
