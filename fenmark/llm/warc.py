"""Operator 3, WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable frame that holds the seek table of the
public seekable format. An index maps each record to its bundle, its frame and its offset inside the decompressed frame, so
that one record needs one frame. Equal payloads are stored once: later ones are revisit records.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, each_batch, salted_join

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: A scan has a task for each bundle, up to so many tasks.
SCAN_TASKS = 20_000
LEVEL = 3
REVISIT_LEAST = 1000

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, frame_offset long, record_offset long, record_bytes long"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_bytes long, content binary"


def record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. Line breaks in a url are escaped."""
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(frame: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, content) of each record of a decompressed frame from `at` on."""
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *rest = frame[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in rest)
        size = int(head["Content-Length"])
        yield at, head, frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer of a bundle: compressed and decompressed size of each frame."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the last bytes of an open bundle."""
    size = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", f.read_at(8 * n, size - 9 - 8 * n)):
        out.append((at, c, d))
        at += c
    return out


def classify(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to: which pages are stored and which revisit another.

    Of equal payloads of at least REVISIT_LEAST bytes the one with the largest page_id is the response. Pages with a null page_id
    are responses; rows that repeat a page_id and payload are all responses if that page is. A null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_LEAST).select("page_id", "payload_digest")
    copies = large.groupBy("payload_digest").agg(F.max("page_id").alias("target"), F.min("page_id").alias("least")).where("least < target").select("payload_digest", "target")
    revisits = scratch.table(salted_join(large, copies, ["payload_digest"], F.col("page_id")).where("page_id < target").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "target").distinct())
    # only the thin list of revisits meets the pages; it is not broadcast by us, as it grows with them
    found = rows.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("target").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("target").alias("refers_to"))


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that Hadoop names: its connector's s3a and s3n are S3 here."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def write(classified: DataFrame, folder: str) -> DataFrame:
    """Writes the records of classify() into bundles below folder, a URI that driver and executors share; gives the INDEX rows.

    Lazy: nothing is written until the result is used, and each use writes under other names, so take it once (as a written table).
    A bundle gets its name when it is complete; a task that is run again leaves whole bundles that no index row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out, name, frames, at, frame, held, index = None, "", [], 0, [], 0, []

        def flush() -> None:
            nonlocal out, name, at, frame, held
            if not frame:
                return
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out, at = fs.open_output_stream(f"{root}/.{name}", compression=None), 0
            packed = packer.compress(b"".join(x for _, x in frame))
            offset = 0
            for page_id, x in frame:
                index.append((page_id, name, len(frames), at, offset, len(x)))
                offset += len(x)
            out.write(packed)
            frames.append((len(packed), offset))
            at += len(packed)
            frame, held = [], 0

        def close() -> pa.RecordBatch | None:
            nonlocal out, frames, index
            if out is None:
                return None
            out.write(seek_table(frames))
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            cols = list(zip(*index, strict=True))
            out, frames, index = None, [], []
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            for r in zip(*(b.column(c) for c in ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html")), strict=True):
                page_id, url, kind, digest, size, refers_to, html = (x.as_py() for x in r)
                x = record(page_id, url, kind, digest, size, refers_to, (html or "").encode() if kind == "response" else b"")
                frame.append((page_id, x))
                held += len(x)
                if held >= FRAME_BYTES:
                    flush()
                    if at >= BUNDLE_BYTES:
                        yield close()
        flush()
        if (last := close()) is not None:
            yield last

    return classified.mapInArrow(run, INDEX)


def _rows(found: list[tuple[dict[str, str], bytes]], content: bool) -> pa.RecordBatch:
    number = lambda x: int(x) if x else None
    heads = [h for h, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number(h["X-Page-ID"]) for h in heads], pa.int64()),
            pa.array([h["WARC-Type"] for h in heads], pa.string()),
            pa.array([number(h.get("X-Refers-To-Page")) for h in heads], pa.int64()),
            pa.array([int(h["X-Payload-Length"]) for h in heads], pa.int64()),
            pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h in heads], pa.string()),
            pa.array([len(c) for _, c in found], pa.int64()),
            pa.array([c if content else None for _, c in found], pa.binary()),
        ],
        names=[x.split()[0] for x in RECORDS.split(", ")],
    )


def scan(bundles: DataFrame, folder: str, content: bool = True) -> DataFrame:
    """All records (RECORDS) of the bundles named in column `bundle`, one frame at a time. A response whose content does not have
    its digest is an error. Null names are passed over, and a name that comes twice is read once; no names give no rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for name in batch.column("bundle"):
            with fs.open_input_file(f"{root}/{name.as_py()}") as f:
                for at, packed, size in read_seek_table(f):
                    frame = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=size)
                    found = [(h, c) for _, h, c in parse(frame)]
                    for h, c in found:
                        if h["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(c).hexdigest() != h["WARC-Payload-Digest"]:
                            raise ValueError(f"damaged record {h['WARC-Record-ID']} in {name}")
                    yield _rows(found, content)

    names = bundles.where("bundle is not null").select("bundle").distinct()
    # names are few bytes, so that Spark alone would put them all into one task
    return names.repartition(max(1, min(names.count(), SCAN_TASKS)), "bundle").mapInArrow(each_batch(run), RECORDS)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records (RECORDS) of the given rows of an index, by seeking: one read and one decompression a record."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        found = []
        for r in batch.to_pylist():
            with fs.open_input_file(f"{root}/{r['bundle']}") as f:
                at, packed, size = read_seek_table(f)[r["frame"]]
                frame = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=size)
            _, h, c = next(parse(frame, r["record_offset"]))
            found.append((h, c))
        yield _rows(found, True)

    return index.mapInArrow(each_batch(run), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Archives every page (page_id, url, html; other columns are ignored) below folder and reads the archives back: RECORDS without
    the content, one row for each row of pages. Nulls as in classify(); an empty table gives no rows and no archives. A page is held
    whole, with its frame, while it is written or read."""
    with Scratch(spark) as scratch:
        index = scratch.keep(scratch.table(write(classify(pages.select("page_id", "url", "html"), scratch), folder)))
        return scan(index, folder, content=False)
