"""Operator 13, token ids as files of patched frame-of-reference blocks.

A file is a row of blocks and an index, all numbers little-endian. Spark's own text sink writes them, one row a block, so that tasks
commit as any other sink's do and every store that Spark knows will take them; the sink puts one line feed after each row.

    block   minimum u32, count u16, width u16, exceptions u32; (id - minimum) modulo 2**width, packed from the lowest bit on, to a
            whole byte; places of the exceptions u16; (id - minimum) >> width of each u32
    index   file number u32, blocks u32, documents u32; start of each block u64; doc_id of each document i64; whether it is null u8;
            ids up to its end u64
    tail    length of the index u64, MAGIC

Blocks but the last hold BLOCK_IDS ids, so that the block of any place is known; documents go on over blocks. The width is that of the
PERCENTILE-th percentile of a block; what is wider is an exception.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, each_batch

MAGIC = b"PFORIDS1"
BLOCK_IDS, PERCENTILE = 4096, 95
#: Blocks that are packed or unpacked together, bytes of text for each file, and bytes of a worker's memo, about.
TOGETHER, FILE_TEXT, MEMO_BYTES, MEMO_LONGEST = 32, 32 << 20, 96 << 20, 64
HEAD, INDEX, TAIL = struct.Struct("<IHHI"), struct.Struct("<III"), struct.Struct("<Q8s")

#: A space before a character that is no white space begins a new pre-token of byte-level BPE, whatever is before it.
CUT = re.compile("[ ](?=[^\\s\x1c-\x1f\x85᠎])")
#: Characters whose kind needs no Unicode tables, and the pre-tokens of texts that have no others.
LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
PLAIN = re.compile(f"[ -~\n{LETTERS}]*")
WORDS = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^ \n0-9{LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+")

FOUND = "file long, doc_id long, at long, n_tokens long, ids_crc32 long"


def byte_names() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others by the next free code."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Pieces(dict):
    """pre-token -> its ids as bytes, by the tokenizers library's model. Those met lately are kept, in two generations, for all tasks of
    a worker. Texts with characters beyond PLAIN are cut at spaces, and pieces that have such go through the library whole."""

    _kept: dict[str, Pieces] = {}

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.names, self.old, self.held = byte_names(), {}, 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            # of ASCII, only the space and the line feed have other names
            named = word.replace(" ", self.names[32]).replace("\n", self.names[10]) if word.isascii() else word.encode().decode("latin-1").translate(self.names)
            made = struct.pack("<%dI" % len(found := self.tokenizer.model.tokenize(named)), *[x.id for x in found])
        if len(word) <= MEMO_LONGEST:
            self.held += 220 + len(made)
            if self.held > MEMO_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[word] = made
        return made

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian."""
        if not text:
            return b""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        out = []
        for i, piece in enumerate(CUT.split(text)):
            piece = " " + piece if i else piece
            if PLAIN.fullmatch(piece):
                out += map(self.__getitem__, WORDS.findall(piece))
            else:
                out.append(np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


def _widths(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), x.astype(np.uint64), "right")


def _kind(width: int) -> np.dtype:
    """The numbers whose low bits are packed."""
    return np.dtype("<u2" if width <= 16 else "<u4")


def pack(ids: np.ndarray) -> list[bytes]:
    """Blocks of equally many ids each: ids is a matrix of unsigned 32-bit numbers, a block a row."""
    m, n = ids.shape
    least = ids.min(axis=1)
    above = ids - least[:, None]
    k = min(n - 1, n * PERCENTILE // 100)
    widths = _widths(np.partition(above, k, axis=1)[:, k])
    out: list[bytes] = [b""] * m
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        part = above[rows]
        kind = _kind(w)
        bits = np.unpackbits(part.astype(kind).view(np.uint8).reshape(len(rows), n, -1), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), n * w), axis=1, bitorder="little") if w else np.zeros((len(rows), 0), np.uint8)
        high = (part.astype(np.uint64) >> np.uint64(w)).astype("<u4")
        for j, r in enumerate(rows.tolist()):
            at = np.flatnonzero(high[j])
            out[r] = HEAD.pack(int(least[r]), n, w, len(at)) + packed[j].tobytes() + at.astype("<u2").tobytes() + high[j][at].tobytes()
    return out


def unpack(content: memoryview, starts: list[int]) -> list[np.ndarray]:
    """The ids of the blocks that begin at starts."""
    heads = [HEAD.unpack_from(content, s) for s in starts]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(starts)
    for n, w in {(h[1], h[2]) for h in heads}:
        rows = [j for j, h in enumerate(heads) if h[1:3] == (n, w)]
        size = (n * w + 7) // 8
        values = np.zeros((len(rows), n), np.uint32)
        if w:
            packed = np.stack([np.frombuffer(content, np.uint8, size, starts[j] + HEAD.size) for j in rows])
            kind = _kind(w)
            bits = np.zeros((len(rows), n, 8 * kind.itemsize), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, count=n * w, bitorder="little").reshape(len(rows), n, w)
            values = np.packbits(bits, axis=2, bitorder="little").view(kind).reshape(len(rows), n).astype(np.uint32)
        for j, v in zip(rows, values, strict=True):
            least, _, _, extra = heads[j]
            if extra:
                at = starts[j] + HEAD.size + size
                v[np.frombuffer(content, "<u2", extra, at)] |= np.frombuffer(content, "<u4", extra, at + 2 * extra) << np.uint32(w)
            out[j] = v + np.uint32(least)
    return out


def index_row(file: int, starts: list[int], doc_id: list[int | None], ends: list[int]) -> bytes:
    """The index of a file, and its tail."""
    null = np.array([i is None for i in doc_id], np.uint8)
    index = INDEX.pack(file, len(starts), len(doc_id)) + np.array(starts, "<u8").tobytes() + np.array([i or 0 for i in doc_id], "<i8").tobytes()
    index += null.tobytes() + np.array(ends, "<u8").tobytes()
    return index + TAIL.pack(len(index), MAGIC)


def read_index(content: memoryview) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """File number, starts of blocks, and of each document: doc_id, whether that is null, ids up to its end."""
    size, magic = TAIL.unpack_from(content, len(content) - TAIL.size - 1)
    if magic != MAGIC or content[-1] != 10:
        raise ValueError("not a whole file of token ids")
    at = len(content) - TAIL.size - 1 - size
    file, blocks, docs = INDEX.unpack_from(content, at)
    at += INDEX.size
    starts, doc_id = np.frombuffer(content, "<u8", blocks, at), np.frombuffer(content, "<i8", docs, at + 8 * blocks)
    at += 8 * (blocks + docs)
    return file, starts, doc_id, np.frombuffer(content, np.uint8, docs, at), np.frombuffer(content, "<u8", docs, at + docs)


def ids_between(content: memoryview, first: int, end: int) -> np.ndarray:
    """The ids at places first to end - 1 of a file; only their blocks are unpacked."""
    starts = read_index(content)[1]
    a, b = first // BLOCK_IDS, -(-end // BLOCK_IDS)
    if first >= end:
        return np.zeros(0, np.uint32)
    return np.concatenate(unpack(content, starts[a:b].tolist()))[first - a * BLOCK_IDS : end - a * BLOCK_IDS]


def write(documents: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Encodes documents (doc_id long, text) with the tokenizer file at path and writes their ids, each document's followed by end_id,
    in ascending order of doc_id over the files of folder, a new one in any store that Spark writes to.

    Rows without a doc_id come first; rows that repeat one are in the order of their texts' hashes. Null and empty texts are end_id
    alone. An empty table writes no ids. Special tokens in texts are ordinary text. Ranges of ids are sorted, so that no task sees
    more than its file; a worker needs some 60 bytes for each byte of its longest text, and the memo's bound.
    """
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    mark = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        held, size, at, done = [], 0, 0, 0
        starts, doc_id, ends = [], [], []

        def rows(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            made = pack(ids)
            for block in made:
                starts.append(at)
                at += len(block) + 1
            return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["data"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            ids, step = np.frombuffer(b"".join(held), "<u4"), BLOCK_IDS * TOGETHER
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for a in range(0, whole, step):
                yield rows(ids[a : min(a + step, whole)].reshape(-1, BLOCK_IDS))
            if last and whole < len(ids):
                yield rows(ids[whole:].reshape(1, -1))
            held = [ids[whole:].tobytes()]
            size = len(held[0])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = pieces.encode(text.as_py())
                held += [ids, mark]
                size += len(ids) + 4
                done += len(ids) // 4 + 1
                doc_id.append(i)
                ends.append(done)
                if size >= 4 * BLOCK_IDS * TOGETHER:
                    yield from flush(False)
        if doc_id:
            yield from flush(True)
            index = index_row(TaskContext.get().partitionId(), starts, doc_id, ends)
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.binary())], names=["data"])
        pa.default_memory_pool().release_unused()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ranges are told by ids and hashes alone: their sample goes through the driver, and texts must not
    files = docs.repartitionByRange(max(1, -(-total // FILE_TEXT)), *order[:2]).sortWithinPartitions(*order)
    rows = files.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """FOUND for each document of the files that write() made: its file's number, its place there, how many ids it has (the end id
    among them) and their crc32 as little-endian 32-bit numbers. A file that is not whole is an error. Blocks are unpacked one group
    after the other; a worker holds one file and the rows of its batch."""

    def one(content: memoryview) -> pa.RecordBatch:
        file, starts, doc_id, null, ends = read_index(content)
        crcs, crc, d, at = np.zeros(len(ends), np.int64), 0, 0, 0
        for g in range(0, len(starts), TOGETHER):
            ids = np.concatenate(unpack(content, starts[g : g + TOGETHER].tolist()))
            raw, a = ids.astype("<u4").tobytes(), 0
            while d < len(ends) and ends[d] <= at + len(ids):
                b = int(ends[d]) - at
                crcs[d], crc, a, d = zlib.crc32(raw[4 * a : 4 * b], crc), 0, b, d + 1
            crc = zlib.crc32(raw[4 * a :], crc)
            at += len(ids)
        if d < len(ends) or at != (ends[-1] if len(ends) else 0):
            raise ValueError("the blocks of a file do not hold the ids that its index tells of")
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ends), file, np.int64)), pa.array(doc_id, mask=null.astype(bool)), pa.array(begins), pa.array(ends.astype(np.int64) - begins), pa.array(crcs)],
            names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column("content"):
            buffer = content.as_buffer()
            if buffer is not None and buffer.size:
                yield one(memoryview(buffer))

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(each_batch(run), FOUND)


def round_trip(spark: SparkSession, documents: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes documents as in write() below folder and reads the files back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 for each row of documents. The starts of files come from one row for each file."""
    write(documents, path, folder, end_id)
    with Scratch(spark) as scratch:
        found = scratch.keep(scratch.table(read(spark, folder)))
        files = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = scratch.keep(scratch.table(files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))))
        return found.join(scratch.small(files), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
