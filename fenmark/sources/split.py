"""Large vector files read by many tasks: a data source that plans partitions inside a file.

A shapefile is cut by its index (.shx), which tells where each record lies, and its attribute table has rows of one width. A GeoJSON
collection is cut by bytes: inside JSON text, a brace followed by the member "type" of value "Feature" cannot be part of a string, as
its quotes would be escaped there, so a task finds the features that begin in its range wherever that lies.

Files are opened by the workers, through pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fenmark.sources.vector import dbf_fields, dbf_row, declared_srid, shape_of, srid_of, wkb

SCHEMA = "number long, attributes string, geom binary, srid int"
#: Bytes of a partition, of a read, and rows of a batch.
SPLIT_BYTES, READ_BYTES, BATCH_ROWS = 32 << 20, 4 << 20, 2_000
FEATURE = re.compile(rb'\{\s*"type"\s*:\s*"Feature"\s*[,}]')
#: A feature's beginning is no longer than this, white space included.
BEGINNING = 256


def opened(path: str) -> pa.NativeFile:
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path) if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(inner)


@dataclass
class Range(InputPartition):
    """Records first to end - 1 of a shapefile, or features that begin at bytes first to end - 1."""

    first: int
    end: int


def _batches(rows: Iterator[tuple[int, dict, bytes | None, int]], keep: list[str] | None) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32())
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["number", "attributes", "geom", "srid"])

    for number, attributes, geom, srid in rows:
        known = attributes if keep is None else {k: attributes.get(k) for k in keep}
        held.append((number, json.dumps(known, ensure_ascii=False), geom, srid))
        if len(held) >= BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.path = given["path"]
        self.split = int(given.get("splitbytes", SPLIT_BYTES))
        self.keep = json.loads(given["columns"]) if "columns" in given else None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.rows(partition), self.keep)


class ShapefileReader(_Reader):
    def _beside(self, ending: str) -> pa.NativeFile:
        return opened(self.path[: -len(".shp")] + ending)

    def partitions(self) -> list[Range]:
        with opened(self.path) as f, self._beside(".shx") as index:
            size, count = f.size(), (index.size() - 100) // 8
        each = max(1, count * self.split // max(size, 1))
        return [Range(a, min(a + each, count)) for a in range(0, count, each)] or [Range(0, 0)]

    def rows(self, part: Range) -> Iterator[tuple[int, dict, bytes | None, int]]:
        if part.first >= part.end:
            return
        with opened(self.path) as shp, self._beside(".shx") as shx, self._beside(".dbf") as dbf:
            head = dbf.read_at(32, 0)
            start, width = struct.unpack("<HH", head[8:12])
            fields = dbf_fields(dbf.read_at(start, 0))
            try:
                with self._beside(".prj") as f:
                    srid = srid_of(f.read().decode())
            except FileNotFoundError:
                srid = srid_of(None)
            places = [(a * 2, n * 2) for a, n in struct.iter_unpack(">II", shx.read_at(8 * (part.end - part.first), 100 + 8 * part.first))]
            i = 0
            while i < len(places):
                # records that follow each other are read together
                j, base = i + 1, places[i][0]
                while j < len(places) and places[j][0] >= places[j - 1][0] and sum(places[j]) + 8 - base <= READ_BYTES:
                    j += 1
                raw = shp.read_at(sum(places[j - 1]) + 8 - base, base)
                table = dbf.read_at((j - i) * width, start + (part.first + i) * width)
                for k in range(i, j):
                    at, size = places[k]
                    row = table[(k - i) * width : (k - i + 1) * width]
                    if row[:1] != b"*":  # deleted
                        yield part.first + k, dbf_row(fields, row), wkb(shape_of(raw[at - base + 8 : at - base + 8 + size])), srid
                i = j


class GeoJsonReader(_Reader):
    def partitions(self) -> list[Range]:
        with opened(self.path) as f:
            size = f.size()
        return [Range(a, min(a + self.split, size)) for a in range(0, size, self.split)] or [Range(0, 0)]

    def _srid(self, f: pa.NativeFile) -> int:
        """Of a crs member before the features."""
        head = f.read_at(min(f.size(), 1 << 16), 0)
        first = FEATURE.search(head)
        found = re.search(rb'"crs"\s*:\s*(\{.*?\}\s*\})', head[: first.start()] if first else head, re.S)
        return declared_srid(json.loads(found[1]) if found else None)

    def rows(self, part: Range) -> Iterator[tuple[int, dict, bytes | None, int]]:
        with opened(self.path) as f:
            size, srid = f.size(), self._srid(f)
            base, data, looked = part.first, b"", 0  # data begins at byte base of the file, and was searched up to `looked`
            begun: list[int] = []  # places in data where features begin that are not read yet, past the range's end too
            after = 0  # byte of the file from which on a beginning is a new one

            def more() -> bool:
                """Drops what is read, reads on and looks for beginnings; False at the end of the file."""
                nonlocal base, data, looked, begun, after
                cut = begun[0] if begun else max(0, len(data) - BEGINNING)
                base, data, looked, begun = base + cut, data[cut:], looked - cut, [x - cut for x in begun]
                at = base + len(data)
                if at >= size:
                    return False
                data += f.read_at(min(READ_BYTES, size - at), at)
                begun += [m.start() for m in FEATURE.finditer(data, max(looked - BEGINNING, after - base, 0))]
                looked = len(data)
                after = base + begun[-1] + 1 if begun else after
                return True

            def feature() -> dict:
                """The first one of begun. It ends before the next begins, unless that one lies inside it."""
                nonlocal begun
                k = 1
                while True:
                    while k >= len(begun) and more():
                        pass
                    text = data[begun[0] : begun[k] if k < len(begun) else len(data)]
                    try:
                        found, _ = json.JSONDecoder().raw_decode(text.decode("utf-8", "replace"))
                    except json.JSONDecodeError:
                        if k >= len(begun):
                            raise
                        k += 1
                        continue
                    begun = begun[k:]
                    return found

            while True:
                while not begun and base + max(0, len(data) - BEGINNING) < part.end and more():
                    pass
                if not begun or base + begun[0] >= part.end:
                    return
                number = base + begun[0]
                found = feature()
                yield number, found.get("properties") or {}, wkb(found.get("geometry")), srid


class SplitVector(DataSource):
    """Options: path (.shp, or GeoJSON whose features begin with their type), splitBytes, columns (JSON list of attributes to keep)."""

    @classmethod
    def name(cls) -> str:
        return "vector"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (ShapefileReader if self.options["path"].lower().endswith(".shp") else GeoJsonReader)(dict(self.options))


def read_split(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Features (number, attributes, geom, srid) of one large file, in partitions of about split_bytes each. number is the record of a
    shapefile, from 0, or the byte at which a GeoJSON feature begins; columns are the attributes to keep (all).

    Features of GeoJSON must begin with their type, as usual writers do; others, and features inside the properties of others that lie
    across a partition's edge, are not for this reader but for vector.read_vector. A crs member counts if it comes before the features.
    """
    spark.dataSource.register(SplitVector)
    reader = spark.read.format("vector").option("path", path).option("splitBytes", split_bytes)
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    return reader.load()
