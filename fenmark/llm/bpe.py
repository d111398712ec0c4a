"""Operator 10, byte-level BPE encoding and decoding by a two-tier lookup.

Each match of the pre-token pattern is looked up in a minimal perfect hash over the vocabulary's byte strings; a hit is one id.
A miss is merged with a heap over a linked list of its bytes, lowest rank first and leftmost on ties. A memo, bounded by bytes,
keeps the ids of pre-tokens seen lately in a worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from fenmark.llm.common import each_batch

#: Bytes of each of the memo's two generations, about; longer pre-tokens are not kept.
MEMO_BYTES, MEMO_LONGEST = 16 << 20, 128


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file. Ids are the ranks; they may have gaps."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: as many slots as keys, one seed a bucket, keys checked on lookup."""

    def __init__(self, ranks: dict[bytes, int], load: int = 3):
        n = len(ranks)
        self.n, self.buckets = n, max(1, n // load)
        by_bucket: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in ranks:
            by_bucket[xxhash.xxh64_intdigest(k) % self.buckets].append(k)
        self.seeds, free = [0] * self.buckets, bytearray(b"\x01") * n
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        for b in sorted(range(self.buckets), key=lambda i: -len(by_bucket[i])):
            keys, seed = by_bucket[b], 0
            while keys:
                seed += 1
                slots = {xxhash.xxh64_intdigest(k, seed) % n for k in keys}
                if len(slots) == len(keys) and all(free[s] for s in slots):
                    break
            self.seeds[b] = seed
            for k in keys:
                s = xxhash.xxh64_intdigest(k, seed) % n
                free[s], self.keys[s], self.ids[s] = 0, k, ranks[k]

    def get(self, key: bytes) -> int:
        """The id of key, or -1."""
        s = xxhash.xxh64_intdigest(key, self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]) % self.n if self.n else 0
        return self.ids[s] if self.n and self.keys[s] == key else -1


class Encoder(dict):
    """pre-token -> ids. Missing ones are made and kept; two generations bound the memo."""

    def __init__(self, ranks: dict[bytes, int], most: int = MEMO_BYTES):
        super().__init__()
        self.table, self.ranks, self.most, self.held, self.old = PerfectHash(ranks), ranks, most, 0, {}
        self.pairs = [ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token)
        if ids is None:
            raw = token.encode("utf-8", "surrogatepass")
            one = self.table.get(raw)
            ids = (one,) if one >= 0 else self.merged(raw)
        if len(token) <= MEMO_LONGEST:
            # the objects' heads, their share of the dictionary, and what they hold
            self.held += 160 + 2 * len(token) + 8 * len(ids)
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[token] = ids
        return ids

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is not in the vocabulary. An entry of the heap is a rank and the place where its pair begins."""
        n, rank, pop, push = len(raw), self.ranks.get, heapq.heappop, heapq.heappush
        width = 16 if n < 1 << 16 else n.bit_length()
        low = (1 << width) - 1
        best = [self.pairs[x << 8 | y] for x, y in zip(raw, raw[1:])]  # noqa: B905  the rank of the pair that begins here
        best.append(-1)
        heap = [r << width | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            x = pop(heap)
            i = x & low
            if best[i] != x >> width:
                continue  # one of its parts has merged since
            j = after[i]
            k = after[i] = after[j]
            best[j] = r = -1
            if k < n:
                before[k] = i
                if (r := rank(raw[i : after[k]], -1)) >= 0:
                    push(heap, r << width | i)
            best[i] = r
            if (p := before[i]) >= 0:
                r = best[p] = rank(raw[p:k], -1)
                if r >= 0:
                    push(heap, r << width | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return tuple(out)


class Codec:
    """Encoder and decoder of a vocabulary and a pre-token pattern; built once in each worker."""

    _kept: dict[tuple, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.encoder = Encoder(ranks)
        size = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes | None] = [None] * size
        self.names: list[str | None] = [None] * size
        for k, i in ranks.items():
            self.pieces[i], self.names[i] = k, str(i)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
        if (name, pattern) not in cls._kept:
            cls._kept[name, pattern] = cls(ranks, pattern)
        return cls._kept[name, pattern]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.encoder.__getitem__, self.split(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def named(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def _shared(documents: DataFrame, path: str):
    """The vocabulary, of a fixed size, read on the driver and sent to each worker once."""
    return documents.sparkSession.sparkContext.broadcast(load_ranks(path))


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """documents with a column of token ids of each whole text: int array, empty for null and empty texts. Other columns are kept.

    The pattern splits a text into pre-tokens that are encoded separately; there are no special tokens. A column named as `out` is
    replaced; an empty table stays empty. A worker needs some 40 bytes for each byte of its longest text, and the memo's bound.
    """
    ranks = _shared(documents, path)
    rest = documents.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema)}{', ' if rest.columns else ''}`{out}` array<int>"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern, path)
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = [codec.encode(t.as_py()) for t in part.column(part.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out])

    return rest.mapInArrow(each_batch(run), schema)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256, round_trip for every row of documents (doc_id, text).

    Each text is encoded, and its ids are decoded again, in one pass, so that the ids need not leave the task. ids_sha256 is of
    decimal ids joined by one space. Null and empty texts have no tokens; repeated rows give repeated results; an empty table none.
    """
    ranks = _shared(documents, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern, path)
        n, size, a, b, same = [], [], [], [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            ids = codec.encode(text)
            raw = codec.decode(ids)
            n.append(len(ids))
            size.append(len(raw))
            a.append(hashlib.sha256(codec.named(ids).encode()).hexdigest())
            b.append(hashlib.sha256(raw).hexdigest())
            same.append(raw == text.encode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(each_batch(run), "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text its ids stand for in a column `out`; bytes that are not UTF-8 become U+FFFD, null ids a null text."""
    ranks = _shared(encoded, path)
    rest = encoded.drop(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{out}` string"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = {i: k for k, i in ranks.value.items()}  # an id that the vocabulary does not have is an error
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            made = [None if v is None else b"".join(map(pieces.__getitem__, v)).decode("utf-8", "replace") for v in part.column(part.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, out])

    return rest.mapInArrow(each_batch(run), schema)
