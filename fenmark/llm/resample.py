"""Operator 11, target-distribution importance resampling over hashed n-grams, by an integer word dictionary.

A task maps the distinct words of its texts to ids. A run of words is a tuple of ids; tuples are told apart as pairs of (id of the
tuple without its last word, id of the last word). The bytes of each distinct tuple are put together and hashed once, and its bucket
is joined back to every place where the tuple stands. The dictionary belongs to a task and is bounded by bytes: one dictionary of the
whole corpus would have to meet each (document, word) pair in a shuffle, while this way only a count for each bucket leaves a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, each_batch, flat

#: Bytes of text that are split together, and bytes of a task's dictionary, after which it begins anew.
PIECE, DICTIONARY_BYTES = 1 << 20, 96 << 20
#: Rows of a range when scores are put in order, at most about.
RANGE_ROWS = 1 << 20

#: Word bytes as they are, A-Z lower-cased, others as spaces: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased UTF-8.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Dictionary(dict):
    """word -> id. Each distinct word is hashed when it is first met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets
        self.forget()

    def forget(self) -> None:
        """Begins anew: no word keeps an id of lists that are gone."""
        self.clear()
        self.words, self.hashed, self.held = [], [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        self.hashed.append(zlib.crc32(word) % self.buckets)
        self.held += 200 + len(word)
        return i

    def features(self, ids: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, row) of every run of 1 to n words that lies within one row."""
        yield np.array(self.hashed, np.int64)[ids], row
        tuples = ids
        for size in range(2, n + 1):
            ends = len(ids) - size + 1
            if ends <= 0:
                return
            whole = row[:ends] == row[size - 1 :]
            pairs, first, tuples = np.unique(tuples[:ends] << 32 | ids[size - 1 :], return_index=True, return_inverse=True)
            made = [zlib.crc32(b" ".join([self.words[w] for w in ids[f : f + size].tolist()])) % self.buckets for f in first.tolist()]
            yield np.array(made, np.int64)[tuples][whole], row[:ends][whole]


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about PIECE bytes."""
    raw, at = raw.translate(FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _blocks(column: pa.Array, words: Dictionary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word ids, row of each) of whole texts, some PIECE bytes together."""
    data, offs = flat(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, "right")) - 1)
        parts, counts = [], []
        for i in range(at, end):
            ids = [np.fromiter(map(words.__getitem__, p), np.int64, len(p)) for p in _pieces(data[offs[i] : offs[i + 1]].tobytes())]
            parts += ids
            counts.append(sum(map(len, ids)))
        yield at, end, np.concatenate(parts) if parts else np.zeros(0, np.int64), np.repeat(np.arange(end - at), counts)
        if words.held > DICTIONARY_BYTES:
            words.forget()
        at = end


def bucket_counts(texts: DataFrame, n: int, buckets: int, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket: a list of fixed length, added up in each task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Dictionary(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, ids, row in _blocks(b.column(0), words):
                for found, _ in words.features(ids, row, n):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = [0] * buckets
    for bucket, count in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = count
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the ratio of each bucket's smoothed share in the target to that in the source), in doubles."""
    b = len(source)
    s, t = float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(source, target, strict=True)]


def weigh(documents: DataFrame, gain: list[int], n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of a document's features) for each row of documents."""
    buckets = len(gain)
    shared = documents.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary(buckets)

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for at, end, ids, row in _blocks(b.column("text"), words):
                counts[at:end] = np.bincount(row, minlength=end - at)
                for found, of in words.features(ids, row, n):
                    total = np.zeros(len(found) + 1, np.int64)
                    np.cumsum(shared.value[found], out=total[1:])
                    edge = np.searchsorted(of, np.arange(end - at + 1))
                    features[at:end] += np.diff(edge)
                    weight[at:end] += total[edge[1:]] - total[edge[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

        yield from each_batch(one)(batches)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(df: DataFrame, order: list, scratch: Scratch, rows: int) -> DataFrame:
    """df (of `rows` rows) with place = 1, 2, ... in the given order, without a task that sorts it whole: sorted ranges are written
    once, and their offsets are added. Equal rows may take either's place."""
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    table = scratch.keep(scratch.table(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())))
    at = table.withColumn("_range", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    offsets, before = [], 0  # a row for each range
    for r in at.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    return at.join(F.broadcast(start), "_range").withColumn("place", F.col("_row") + F.col("_before") + 1).drop("_range", "_row", "_before", "_at")


def resample(documents: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of documents (doc_id long, text); target has a column of texts.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of texts whose A-Z are lower-cased; features are all runs of 1 to n of them, each
    counted as often as it stands there. A score is the weight plus Gumbel noise made from sha256(`seed:doc_id`), so that the highest
    scores are a draw without replacement by importance; of the documents with at least least_words words, percent in a hundred
    (rounded down) are drawn, ties to the smaller doc_id, and get ranks 1, 2, ...; others have a null rank.

    Null and empty texts have no features and weight 0. A row without a doc_id counts in the statistics, has no score and is not
    drawn. Rows that repeat a doc_id are rows of their own. Empty documents give no rows; an empty target is the uniform one. Other
    columns are ignored. A worker needs the words of one long text as 8-byte ids, its dictionary, and PIECE bytes of words.
    """
    texts = documents.select("doc_id", "text")
    gain = gains(bucket_counts(texts, n, buckets), bucket_counts(target, n, buckets, target_text))
    name = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    with Scratch(documents.sparkSession) as scratch:
        scored = scratch.table(weigh(texts, gain, n).withColumn("score", F.col("weight") + noise))
        eligible = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
        rows, able = scored.agg(F.count(F.lit(1)), F.count_if(eligible)).first()
        order = [(~eligible).asc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n_words").asc(), F.col("n_features").asc(), F.col("weight").asc()]
        out = ranked(scored, order, scratch, rows)
        rank = F.when(eligible & (F.col("place") <= percent * able // 100), F.col("place"))
        return out.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
