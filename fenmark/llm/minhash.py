"""Operator 2, MinHash near-dedup: universal hash minima, banding, signature verification, exact verification, components.

Documents with equal shingle sets form a class; only classes are banded. In each bucket every class is held against the
bucket's smallest and largest document (the hubs), so a bucket of n classes gives under 2 n candidates. Buckets that then still
span several components are searched for the links between those, in tiles of bounded size that compare signatures in place: first
the best few partners of each document, then, of documents with very many, all of them, by full sets held in the tile. All links
are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import BASE, Scratch, chunks, each_batch, mix, salted_join, shingle_sets, signed
from fenmark.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
THRESHOLD = 75
#: A pair of similarity 0.75 has a signature agreement below a half once in some 3 billion times (128 minima). What passes is
#: confirmed on full sets, so a lower bound costs confirmations only.
SIGNATURE_LEAST = 0.5
TILE = 512
#: Partners of a row that a tile names for confirmation; rows with more are dealt with in place.
PARTNERS = 8

_seeds = np.random.default_rng(7)
MULTIPLIERS = _seeds.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _seeds.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash a * x + b (mod 2**32) over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (MULTIPLIERS[:, None] * x[None, i : i + 1024] + OFFSETS[:, None]).min(axis=1), out=out)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(BANDS, ROWS)[:, j].astype(np.uint64))
    return acc


def _class(values: np.ndarray) -> bytes:
    """A name of 128 bits for a shingle set: rows with equal sets have the same."""
    first = mix(values)
    both = np.array([first.sum(), mix(first ^ np.uint64(BASE)).sum()], np.uint64)
    return mix(both + np.uint64(len(values))).tobytes()


def _fingerprint(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, end, data, offs in chunks(batch.column("text")):
        n, cls, sigs, keys = [], [], [], []
        for s in shingle_sets(data, offs, SHINGLE):
            sig = signature(s) if len(s) else None
            n.append(len(s))
            cls.append(_class(s) if len(s) else None)
            sigs.append(sig.tobytes() if len(s) else None)
            keys.append(signed(_band_keys(sig)).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "sig", "keys"])


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, _, data, offs in chunks(batch.column("text")):
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in shingle_sets(data, offs, SHINGLE)], pa.binary())], names=["shingles"])


def _with_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at = 0
    for part in _sets(batch):
        yield pa.RecordBatch.from_arrays([batch.column("rep").slice(at, part.num_rows), part.column(0)], names=["rep", "shingles"])
        at += part.num_rows


def _agree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose signatures agree often enough."""
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
    yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= SIGNATURE_LEAST))


def _confirm(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Keeps pairs with 100 * |intersection| >= 75 * |union| on full sets."""
    keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
    yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table, list[np.ndarray], list[np.ndarray]]:
    sides = [table.filter(table[c]) for c in ("is_left", "is_right")]
    sigs = [np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(t), BANDS * ROWS) for t in sides]
    return *sides, sigs, [t["component"].to_numpy() for t in sides]


def _promising(i: int, sigs: list[np.ndarray], comp: list[np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray]:
    """Right rows of other components than left row i's whose signatures agree with it, and how much. Of the bands in which a pair
    meets only the first counts, so that it is looked at once."""
    like = np.where(comp[1] != comp[0][i], (sigs[1] == sigs[0][i]).mean(axis=1), 0)
    at = np.flatnonzero(like >= SIGNATURE_LEAST)
    if len(at):
        met = (sigs[1][at].reshape(-1, BANDS, ROWS) == sigs[0][i].reshape(BANDS, ROWS)).all(axis=2)
        at = at[met.argmax(axis=1) == band]
    return at, like[at]


def _tile(most: int):
    def run(table: pa.Table) -> pa.Table:
        """The `most` best pairs of each left row of a tile; (x, x) and the bucket's key for a left row that has more."""
        left, right, sigs, comp = _sides(table)
        rep = [t["rep"].to_numpy() for t in (left, right)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        key = table["key"][0].as_py() if len(table) else None
        for i in range(len(left)):
            at, like = _promising(i, sigs, comp, table["band"][0].as_py())
            if len(at) > most:
                at = at[np.argpartition(-like, most)[:most]]
                a.append(rep[0][i : i + 1])
                b.append(rep[0][i : i + 1])
            a.append(np.full(len(at), rep[0][i]))
            b.append(rep[1][at])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "key": pa.array([key if same else None for same in x == y], pa.int64())})

    return run


def _alike(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(p) + len(q) - both)


def _exact_tile(table: pa.Table) -> pa.Table:
    """A link for each two components of a tile that have one, by full sets held in the tile. All pairs that could be are tried."""
    left, right, sigs, comp = _sides(table)
    sets = [[np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()] for t in (left, right)]
    rep = [t["rep"].to_numpy() for t in (left, right)]
    a, b, joined = [], [], set()
    for i in range(len(left)):
        at, like = _promising(i, sigs, comp, table["band"][0].as_py())
        for j in at[np.argsort(-like, kind="stable")]:
            two = (int(comp[0][i]), int(comp[1][j]))
            if two not in joined and _alike(sets[0][i], sets[1][j]):
                joined |= {two, two[::-1]}
                a.append(min(rep[0][i], rep[1][j]))
                b.append(max(rep[0][i], rep[1][j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) of documents that are links, by full sets made from their whole texts."""
    sets = _sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), docs, scratch)
    found = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    return scratch.table(found.mapInArrow(each_batch(_confirm), "a long, b long").distinct())


def _sets_of(reps: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, shingles) of the named documents. Their list is broadcast where small, so that the texts need not be shuffled."""
    need = scratch.table(reps.distinct())
    return scratch.table(docs.join(scratch.small(need), F.col("doc_id") == F.col("rep")).select("rep", "text").mapInArrow(each_batch(_with_sets), "rep long, shingles binary"))


def _mixed(members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, band, rep, component, big, n_left, n_right): rows of the buckets that hold several components; big is the largest.
    Buckets of two are tested already."""
    named = scratch.small(found).withColumnRenamed("node", "rep")
    labelled = members.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = scratch.table(labelled.select("key", "band", "rep", "component"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("big"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and n > 2")
    mixed = mixed.select("key", F.col("big.component").alias("big"), F.ceil((F.col("n") - F.col("big.n")) / TILE).cast("int").alias("n_left"), F.ceil(F.col("n") / TILE).cast("int").alias("n_right"))
    mixed = scratch.table(mixed)
    if scratch.is_small(mixed):
        return labelled.join(F.broadcast(mixed), "key")
    return salted_join(labelled, mixed, ["key"], F.col("rep"))


def _tiles(rows: DataFrame, left: F.Column, more: list[str]) -> DataFrame:
    """Left rows against all rows of a bucket, both dealt into tiles of about TILE rows, so that no task gets a whole large bucket."""
    dealt = F.xxhash64("rep")
    same = ["key", "band", "rep", "component", *more]
    one = rows.where(left).select(*same, F.pmod(dealt, "n_left").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("r"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    two = rows.select(*same, F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("l"), F.pmod(dealt, "n_right").cast("int").alias("r"), F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    return one.union(two).groupBy("key", "l", "r")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents (doc_id, text; other columns are ignored).

    Null and word-less texts have no shingles, are linked with nothing and are kept; an empty table gives no rows. Rows with equal
    sets, repeated rows included, are one class, named by its smallest doc_id. Rows that repeat a doc_id with other texts are one
    document. Rows with a null doc_id are linked to rows with an equal set only; their component_id is that class's, or null. A worker
    needs some 40 bytes for each byte of its longest text's words.
    """
    docs = documents.select("doc_id", "text")
    with Scratch(documents.sparkSession) as scratch:
        marked = scratch.keep(scratch.table(docs.mapInArrow(each_batch(_fingerprint), "doc_id long, n_shingles long, cls binary, sig binary, keys array<long>")))
        full = marked.where("cls is not null")
        classes = scratch.table(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
        chosen = full.join(classes.select(F.col("cls").alias("c"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("cls") == F.col("c")))
        chosen = scratch.table(chosen.select("rep", "sig", "keys"))
        sigs = chosen.select("rep", "sig")

        banded = chosen.select("rep", F.posexplode("keys").alias("band", "key"))
        hubs = banded.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first != last")
        members = scratch.table(salted_join(banded, hubs, ["key"], F.col("rep")))
        pairs = members.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).union(members.where("rep != last").select("rep", "last")).distinct()
        pairs = pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        tested = scratch.table(pairs.mapInArrow(each_batch(_agree), "a long, b long"))
        links = _confirmed(tested, docs, scratch)
        members = members.select("key", "band", "rep")
        left = F.col("component") != F.col("big")

        def joined() -> DataFrame:
            return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

        found = joined()
        rows = _mixed(members, found, scratch)
        pairs = scratch.table(_tiles(rows.join(sigs, "rep"), left, ["sig"]).applyInArrow(_tile(PARTNERS), "a long, b long, key long").distinct())
        more = scratch.table(pairs.where("a != b").select("a", "b").join(scratch.small(tested), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.union(_confirmed(more, docs, scratch))
            found = joined()
        crowded = scratch.table(pairs.where("a = b").select("key").distinct())
        if not crowded.isEmpty():
            # a pair that its first bucket's tiles did not name has a row that was crowded there, which by now may be in the largest
            # component; such buckets, where still mixed, are searched whole, in place
            rows = _mixed(members, found, scratch)
            rows = scratch.table(rows.join(scratch.small(crowded), "key"))
            facts = _sets_of(rows.select("rep"), docs, scratch).join(sigs, "rep")
            links = links.union(scratch.table(_tiles(rows.join(facts, "rep"), left, ["sig", "shingles"]).applyInArrow(_exact_tile, "a long, b long").distinct()))
            found = joined()

        named = found.select(F.col("node").alias("rep"), "component").distinct()
        # only classes with copies or links need a name other than their own document
        named = classes.join(named, "rep", "left").where("n > 1 or component is not null").select("cls", F.coalesce("component", "rep").alias("component"))
        named = scratch.keep(scratch.table(named))
        out = salted_join(marked.select("doc_id", "n_shingles", "cls"), named, ["cls"], F.col("doc_id"), how="left")
        component = F.coalesce("component", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
