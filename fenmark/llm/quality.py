"""Operator 1, a weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation over the counts of vote
patterns, of all documents, estimates each labeller's accuracies and each pattern's posterior. Posteriors label a bounded sample,
on which a linear scorer over hashed words is fitted; the scorer then grades every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import chunks, each_batch, words

#: Bound of the posterior-labelled sample that the scorer is fitted on.
TRAIN_ROWS = 8_000
BITS = 14
KEEP = 0.5
ROUNDS = 200

#: Frequent words of the four languages; running text has some.
COMMON_WORDS = "the of and to in is that it for with der die und das ist nicht den von mit ein le la les de et des un une que est el los las en y se por con"


def votes(text: str = "text") -> dict[str, Column]:
    """Each labeller's vote on a text: 1 good, 0 bad, null abstains. A null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.length(t)
    tokens = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    n = F.size(tokens)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'\"()-]", ""))
    known = F.size(F.filter(tokens, lambda w: w.isin(*COMMON_WORDS.split())))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    distinct = F.size(F.array_distinct(tokens))

    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    return {
        "length": vote(n < 8, n >= 40),
        "signs": vote(share(signs, size) > 0.05, share(signs, size) < 0.01),
        "capitals": vote(share(capitals, letters) > 0.4, (share(capitals, letters) < 0.15) & (letters > 0)),
        "common_words": vote((n >= 8) & (share(known, n) < 0.03), share(known, n) > 0.1),
        "repeats": vote((n >= 16) & (share(distinct, n) < 0.35), (n >= 16) & (share(distinct, n) > 0.5)),
        "line_repeats": vote((F.size(lines) >= 3) & (share(F.size(F.array_distinct(lines)), F.size(lines)) < 0.6), (F.size(lines) >= 2) & (share(F.size(F.array_distinct(lines)), F.size(lines)) > 0.95)),
        "sentence_end": vote((n >= 8) & ~t.rlike(r"[.!?]"), t.rlike(r"\p{Ll}[.!?](\s|$)")),
        "letters": vote(share(letters, size) < 0.6, share(letters, size) > 0.75),
    }


def pattern(text: str = "text") -> Column:
    """The votes as a string of 1, 0 and - in the labellers' order."""
    return F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in votes(text).values()])


def expectation_maximisation(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of good by pattern, accuracies [labeller, class, vote]) from the counts of all patterns.

    Votes are independent given the class; an abstention tells nothing. It starts from the vote majority, and pseudo-counts keep
    labellers better than chance at the start.
    """
    if not counts:
        return {}, np.zeros((0, 2, 2))
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    seen = np.array([[c == "1" for c in p] for p in names]), np.array([[c == "0" for c in p] for p in names])
    good = (1 + seen[0].sum(axis=1)) / (2 + seen[0].sum(axis=1) + seen[1].sum(axis=1))
    for _ in range(rounds):
        prior = np.clip((n * good).sum() / n.sum(), 0.01, 0.99)
        # accuracy[labeller, class, vote]
        acc = np.zeros((len(names[0]), 2, 2))
        for cls, weight in ((1, n * good), (0, n * (1 - good))):
            for vote in (0, 1):
                acc[:, cls, vote] = weight @ seen[1 - vote] + (8.0 if vote == cls else 2.0)
        acc /= acc.sum(axis=2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + seen[0] @ np.log(acc[:, 1, 1] / acc[:, 0, 1]) + seen[1] @ np.log(acc[:, 1, 0] / acc[:, 0, 0])
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(now - good).max() < 1e-9
        good = now
        if done:
            break
    return dict(zip(names, good.tolist(), strict=True)), acc


@dataclass
class Model:
    posterior: dict[str, float]
    accuracy: np.ndarray
    weights: np.ndarray
    bias: float


def _shares(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): square roots of the shares of hashed words, and of classes of bytes, in each row."""
    hashed, row, start, end = words(data, offs)
    key, count = np.unique((row << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    total = np.bincount(row, minlength=len(offs) - 1)
    at = key >> BITS
    rows, buckets, values = [at], [key & ((1 << BITS) - 1)], [np.sqrt(count / np.maximum(total[at], 1))]
    size = np.diff(offs)
    kinds = [(data >= 65) & (data <= 90), (data >= 33) & (data <= 47) | (data == 124), (data >= 48) & (data <= 57), data == 10]
    some = np.flatnonzero(size)
    sums = [np.zeros(len(size)) for _ in kinds]
    for total_of, k in zip(sums, kinds, strict=True):
        if len(some):
            total_of[some] = np.add.reduceat(k, offs[some], dtype=np.int64) / size[some]
    sums += [np.minimum(total, 200) / 200, np.bincount(at, minlength=len(size)) / np.maximum(total, 1)]
    for j, v in enumerate(sums):
        rows.append(np.arange(len(size)))
        buckets.append(np.full(len(size), (1 << BITS) + j))
        values.append(v)
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


WIDTH = (1 << BITS) + 6


def fit(documents: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Labeller accuracies from the vote patterns of all documents (doc_id, text), and a scorer fitted on `most` at most, those of
    smallest doc_id hash, then text hash.

    Rows with a null doc_id vote but are not sampled; null texts vote as empty ones. Rows that repeat a doc_id all vote; equal ones are
    sampled once. An empty table gives a model that scores 0.5. The sample is at the driver as the distinct hashed words
    of each text, 8 bytes each and 16,390 a text at most, so a long text takes no more than 130 KB there.
    """
    counts = {r.p: r["count"] for r in documents.select(pattern().alias("p")).groupBy("p").count().collect()}
    posterior, acc = expectation_maximisation(counts)
    rows = documents.where("doc_id is not null").select("text", F.struct(F.xxhash64("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return Model(posterior, acc, np.zeros(WIDTH), 0.0)

    def sparse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, end, data, offs in chunks(batch.column("text")):
            row, bucket, value = _shares(data, offs)
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(end - at + 1))
            lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x[order].astype(t))) for x, t in ((bucket, np.int32), (value, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("p").slice(at, end - at), *lists], names=["p", "bucket", "value"])

    first = rows.where((F.col("h.d") < last.d) | (F.col("h.d") == last.d) & (F.col("h.t") <= last.t)).dropDuplicates(["h"])
    sample = first.select("text", pattern().alias("p")).mapInArrow(each_batch(sparse), "p string, bucket array<int>, value array<float>").toArrow()
    y = np.array([posterior[p] for p in sample["p"].to_pylist()])
    lists = [sample[c].combine_chunks() for c in ("bucket", "value")]
    if isinstance(lists[0], pa.ChunkedArray):
        lists = [pa.concat_arrays(x.chunks) for x in lists]
    size = lists[0].value_lengths().to_numpy()
    row = np.repeat(np.arange(len(y)), size)
    bucket, value = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(float)
    w, b, m, v = np.zeros(WIDTH), 0.0, np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, 151):
        z = np.bincount(row, value * w[bucket], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.r_[np.bincount(bucket, value * e[row], minlength=WIDTH) + 1e-5 * w, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(posterior, acc, w, float(b))


def score(documents: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, posterior (of the document's own votes), score (of the scorer, 0 to 1) and kept (score >= keep), for every row.

    Null and empty texts are scored like any other, and repeated rows each by themselves; an empty table gives no rows. A vote
    pattern that was not fitted has a null posterior. A score of exactly `keep` is kept. Other columns are ignored. A worker needs some
    15 bytes for each byte of its longest text.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.bias, model.posterior))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, bias, posterior = sent.value
        z = np.full(batch.num_rows, bias)
        for at, _, data, offs in chunks(batch.column("text")):
            row, bucket, value = _shares(data, offs)
            z[at : at + len(offs) - 1] += np.bincount(row, value * weights[bucket], minlength=len(offs) - 1)
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([posterior.get(p) for p in batch.column("p").to_pylist()], pa.float64()), pa.array(s), pa.array(s >= keep)], names=["doc_id", "posterior", "score", "kept"])

    return documents.select("doc_id", "text", pattern().alias("p")).mapInArrow(each_batch(run), "doc_id long, posterior double, score double, kept boolean")
