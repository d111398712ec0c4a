"""Operator 4, a counterfactual-regularised toxicity classifier.

A logistic model over hashed words and word beginnings. Sentences that name a group of people are scored again with the group
swapped for another, and with none; the squared changes of the score are penalised, so that a mention alone moves no score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import BASE, BYTE_CODES, LOWER, chunks, each_batch, mix, words

#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 20_000
BITS = 20
FEATURES = 600
PREFIXES = (4, 5, 6)
LEAST_DOCS = 5
PENALTY, L2 = 20.0, 1e-4
CUT = 0.7

#: Terms that name groups of people; each line is a ring in which a term is swapped for the next.
IDENTITY_TERMS = """
women men
woman man
girls boys
muslims christians jews hindus atheists
muslim christian jewish hindu atheist
black white asian latino
gay straight lesbian bisexual transgender
immigrants natives refugees citizens
elderly young
disabled deaf blind
frauen männer
frau mann
femmes hommes
femme homme
mujeres hombres
mujer hombre
"""
SWAP = {a: b for line in IDENTITY_TERMS.split("\n") if line.strip() for t in [line.split()] for a, b in zip(t, t[1:] + t[:1], strict=True)}
MENTION = regex.compile(r"\b(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")\b", regex.I)


def swapped(text: str) -> str:
    """text with each group term replaced by the next of its ring."""
    return MENTION.sub(lambda m: SWAP[m[0].lower()], text)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each word beginning of a chunk, with repeats."""
    hashed, row, start, end = words(data, offs)
    rows, found = [row], [hashed]
    for n in PREFIXES:
        at = end - start >= n
        s = start[at]
        rows.append(row[at])
        value = np.full(len(s), n << 40, np.uint64)
        for j in range(n):
            value += BYTE_CODES[LOWER[data[s + j]]] * np.uint64(pow(BASE, j, 1 << 64))
        found.append(mix(value))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def _counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of a batch have each bucket."""
    both = np.zeros((2, 1 << BITS), np.int32)
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
    for at, _, data, offs in chunks(batch.column("text")):
        row, bucket = _distinct(*features(data, offs))
        np.add.at(both, (toxic[row + at], bucket), 1)
    found = np.flatnonzero(both.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(both[1][found].astype(np.int64)), pa.array(both[0][found].astype(np.int64))], names=["bucket", "toxic", "other"])


def _presence(text: str, place: np.ndarray) -> list[int]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    at = place[features(raw, np.array([0, len(raw)]))[1]]
    return np.unique(at[at >= 0]).tolist()


@dataclass
class Model:
    """Weights by bucket; those not named are 0."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def _bucket_of(term: str) -> int:
    raw = np.frombuffer(term.encode(), np.uint8)
    return int(features(raw, np.array([0, len(raw)]))[1][0])


def _descend(x: np.ndarray, y: np.ndarray, change: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least log loss + PENALTY * mean squared change of the score under swaps + L2, by Adam. Classes weigh the same."""
    n, d = x.shape
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:d] + w[d], -30, 30)))
        e = (p - y) * weight
        g = np.r_[x.T @ e + 2 * L2 * w[:d], e.sum()]
        if len(change):
            g[:d] += 2 * PENALTY * (change.T @ (change @ w[:d])) / len(change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def fit(labelled: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of labelled (doc_id, text, toxic 0 or 1), fitted on the `most` rows of smallest doc_id hash at most.

    Rows with a null doc_id, text or label are passed over; without both labels the model scores one of 0 and 1 everywhere, 0 if there
    are none. Repeated rows count as often as they come. Buckets are chosen by the difference of their shares in toxic and other texts;
    ties go to the smaller bucket.
    """
    rows = labelled.where("doc_id is not null and text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    last = rows.select("h").orderBy("h").limit(most).agg(F.max("h"), F.count(F.lit(1))).first()
    if not last[1]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    rows = rows.where(F.col("h") <= F.lit(last[0]))
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 20.0 if 1 in size else -20.0)
    counts = rows.select("text", "toxic").mapInArrow(each_batch(_counts), "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = [F.col("toxic") / size[1], F.col("other") / size[0]]
    gain = (share[0] - share[1]) * F.log((share[0] + 1e-4) / (share[1] + 1e-4))
    chosen = [r.bucket for r in counts.where(F.col("toxic") + F.col("other") >= LEAST_DOCS).orderBy(gain.desc(), "bucket").limit(FEATURES).collect()]
    buckets = np.array(sorted({*chosen, *map(_bucket_of, SWAP)}), np.int64)
    place = np.full(1 << BITS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))

    def presence(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t.as_py() for t in batch.column("text")]
        own = [_presence(t, place) for t in texts]
        other = [[_presence(x, place) for x in (swapped(t), MENTION.sub("", t))] if MENTION.search(t) else [] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.list_(pa.int64())))], names=["toxic", "own", "other"])

    got = rows.select("text", "toxic").mapInArrow(each_batch(presence), "toxic int, own array<long>, other array<array<long>>").collect()
    x, y, change = np.zeros((len(got), len(buckets)), np.float32), np.array([r.toxic for r in got]), []
    for i, r in enumerate(got):
        x[i, r.own] = 1
        for o in r.other:
            c = x[i].copy()
            c[o] -= 1
            change.append(c)
    # labelled mentions are few, so each ring's bare swap counts as a sentence too
    for a, b in SWAP.items():
        c = np.zeros(len(buckets), np.float32)
        c[place[_bucket_of(a)]] += 1
        c[place[_bucket_of(b)]] -= 1
        change.append(c)
    w, bias = _descend(x, y, np.array(change))
    # the cut of the score goes where it parts the fitted rows best
    z = x @ w + bias
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1
    best = int(np.argmax(f1))
    cut = z[order][best] if best + 1 == len(y) else (z[order][best] + z[order][best + 1]) / 2
    return Model(buckets, w, float(bias - cut + math.log(CUT / (1 - CUT))))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of documents (doc_id, text; other columns are ignored).

    Null and empty texts get the bias' score; none is dropped, and repeated rows are scored alike. An empty table gives no rows. Texts
    are scored whole, in blocks; a worker needs some 15 bytes for each byte of its longest text.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.table(), model.bias))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        z = np.full(batch.num_rows, bias)
        for at, _, data, offs in chunks(batch.column("text")):
            row, bucket = features(data, offs)
            known = table[bucket] != 0
            row, bucket = _distinct(row[known], bucket[known])
            np.add.at(z, row + at, table[bucket])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(each_batch(run), "doc_id long, score double")
