"""Readers of vector formats as DataFrames with a WKB column geom and the attributes as JSON text."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.session import ensure_spatial

#: Features that a reader hands on at once.
BATCH_ROWS = 1_000
FEATURES = "attributes string, geom binary, srid int"


def wkb(geometry: dict | None) -> bytes | None:
    """WKB of a GeoJSON geometry; third ordinates are dropped, null stays null."""
    if not geometry:
        return None

    def points(many: list) -> bytes:
        return struct.pack("<I", len(many)) + b"".join(struct.pack("<dd", *p[:2]) for p in many)

    def rings(many: list) -> bytes:
        return struct.pack("<I", len(many)) + b"".join(map(points, many))

    kind = geometry["type"]
    if kind == "GeometryCollection":
        parts = [wkb(g) for g in geometry["geometries"]]
        return struct.pack("<BII", 1, 7, len(parts)) + b"".join(parts)
    c = geometry["coordinates"]
    if kind == "Point":
        return struct.pack("<BIdd", 1, 1, *c[:2])
    if kind == "LineString":
        return struct.pack("<BI", 1, 2) + points(c)
    if kind == "Polygon":
        return struct.pack("<BI", 1, 3) + rings(c)
    single = {"MultiPoint": (4, "Point"), "MultiLineString": (5, "LineString"), "MultiPolygon": (6, "Polygon")}
    code, part = single[kind]
    return struct.pack("<BII", 1, code, len(c)) + b"".join(wkb({"type": part, "coordinates": x}) for x in c)


def declared_srid(crs: dict | None, default: int = 4326) -> int:
    """The EPSG code of a GeoJSON crs member; CRS84 is 4326."""
    name = ((crs or {}).get("properties") or {}).get("name", "")
    if not name:
        return default
    return 4326 if name.endswith("CRS84") else int(name.rpartition(":")[2])


def geojson_features(text: str) -> Iterator[tuple[str, bytes | None, int]]:
    """(attributes, geom, srid) of each feature; a bare geometry is one feature."""
    doc = json.loads(text)
    srid = declared_srid(doc.get("crs"))
    features = doc["features"] if doc.get("type") == "FeatureCollection" else [doc if doc.get("type") == "Feature" else {"geometry": doc}]
    for f in features:
        yield json.dumps(f.get("properties") or {}, ensure_ascii=False), wkb(f.get("geometry")), srid


def kml_features(text: str) -> Iterator[tuple[str, bytes | None, int]]:
    """(attributes, geom, srid) of each placemark with a point, line or polygon."""
    from xml.etree import ElementTree

    def coords(e) -> list:
        return [[float(v) for v in p.split(",")] for p in (e.text or "").split()]

    def shapes(e) -> list[dict]:
        """The geometries below an element, those of nested collections too."""
        out = []
        for poly in e.iterfind(".//{*}Polygon"):
            rings = [coords(c) for side in ("outerBoundaryIs", "innerBoundaryIs") for b in poly.iterfind(f".//{{*}}{side}") for c in b.iterfind(".//{*}coordinates")]
            out.append({"type": "Polygon", "coordinates": rings})
        for kind in ("LineString", "Point"):
            for g in e.iterfind(f".//{{*}}{kind}"):
                c = coords(next(g.iterfind(".//{*}coordinates")))
                out.append({"type": kind, "coordinates": c[0] if kind == "Point" else c})
        return out

    root = ElementTree.fromstring(text)
    for p in root.iterfind(".//{*}Placemark"):
        name = p.find("{*}name")
        known = {"Name": name.text if name is not None else None}
        for d in p.iterfind("{*}ExtendedData//{*}Data"):
            v = d.find("{*}value")
            known[d.get("name")] = v.text if v is not None else None
        for d in p.iterfind("{*}ExtendedData//{*}SimpleData"):
            known[d.get("name")] = d.text
        found, kinds = shapes(p), {g["type"] for g in shapes(p)}
        if len(found) > 1:
            one = kinds.pop() if len(kinds) == 1 else None
            found = [{"type": f"Multi{one}", "coordinates": [g["coordinates"] for g in found]} if one else {"type": "GeometryCollection", "geometries": found}]
        yield json.dumps(known, ensure_ascii=False), wkb(found[0] if found else None), 4326


def _polygon_parts(points: list[tuple], parts: list[int]) -> dict:
    """Rings of a shape record grouped by winding: clockwise ones are outer."""
    ends = [*parts[1:], len(points)]
    out: list[list] = []
    for a, b in zip(parts, ends, strict=True):
        ring = points[a:b]
        turn = sum((q[0] - p[0]) * (q[1] + p[1]) for p, q in zip(ring, ring[1:], strict=False))
        if turn > 0 or not out:
            out.append([ring])
        else:
            out[-1].append(ring)
    return {"type": "Polygon", "coordinates": out[0]} if len(out) == 1 else {"type": "MultiPolygon", "coordinates": out}


def dbf_fields(head: bytes) -> list[tuple[str, str, int]]:
    """Name, kind and width of each column, from the beginning of an attribute table."""
    fields, at = [], 32
    while head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode(), chr(head[at + 11]), head[at + 16]))
        at += 32
    return fields


def dbf_row(fields: list[tuple[str, str, int]], raw: bytes) -> dict[str, object]:
    """The values of a row, whose first byte tells whether it is deleted."""
    row: dict[str, object] = {}
    p = 1
    for name, kind, size in fields:
        text = raw[p : p + size].decode("utf-8", "replace").strip()
        p += size
        if kind in "NF":
            row[name] = None if not text or text.startswith("*") else float(text) if "." in text or "e" in text.lower() else int(text)
        else:
            row[name] = text or None
    return row


def shape_of(body: bytes) -> dict | None:
    """The GeoJSON geometry of a shape record's content."""
    kind = struct.unpack("<I", body[:4])[0] % 10
    if kind == 1:
        return {"type": "Point", "coordinates": struct.unpack("<dd", body[4:20])}
    if kind == 8:
        (n,) = struct.unpack("<I", body[36:40])
        return {"type": "MultiPoint", "coordinates": list(struct.iter_unpack("<dd", body[40 : 40 + 16 * n]))}
    if kind in (3, 5):
        n_parts, n_points = struct.unpack("<II", body[36:44])
        parts = list(struct.unpack(f"<{n_parts}I", body[44 : 44 + 4 * n_parts]))
        points = list(struct.iter_unpack("<dd", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points]))
        if kind == 5:
            return _polygon_parts(points, parts)
        return {"type": "MultiLineString", "coordinates": [points[a:b] for a, b in zip(parts, [*parts[1:], n_points], strict=True)]}
    return None


def srid_of(prj: str | None) -> int:
    return 27700 if prj and "British_National_Grid" in prj.replace(" ", "_") else 4326


def shapefile_features(shp: bytes, dbf: bytes, prj: str | None) -> Iterator[tuple[str, bytes | None, int]]:
    """(attributes, geom, srid) of each record that is not marked as deleted: null, point, multipoint, line and polygon shapes, also
    with Z or M."""
    _, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, srid = dbf_fields(dbf), srid_of(prj)
    at, i = 100, 0
    while at < len(shp):
        size = struct.unpack(">I", shp[at + 4 : at + 8])[0] * 2
        row = dbf[head + i * width : head + (i + 1) * width]
        if row[:1] != b"*":  # deleted
            yield json.dumps(dbf_row(fields, row), ensure_ascii=False), wkb(shape_of(shp[at + 8 : at + 8 + size])), srid
        at, i = at + 8 + size, i + 1


def geopackage_features(raw: bytes, layer: str | None) -> Iterator[tuple[str, bytes | None, int]]:
    """(attributes, geom, srid) of a layer of a GeoPackage; the first where none is named."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite opens paths only; the file lives within this call
        f.write(raw)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            table, column, srid = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns WHERE ?1 IS NULL OR table_name = ?1 ORDER BY table_name", (layer,)).fetchone()
            quoted = '"' + table.replace('"', '""') + '"'
            cur = db.execute(f"SELECT * FROM {quoted}")
            names = [d[0] for d in cur.description]
            for row in cur:
                values = dict(zip(names, row, strict=True))
                blob = values.pop(column)
                envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] if blob else 0
                yield json.dumps(values, ensure_ascii=False, default=str), None if blob is None else bytes(blob[8 + envelope :]), srid
        finally:
            db.close()


def zip_member(raw: bytes, name: str | None = None) -> tuple[str, dict[str, bytes]]:
    """The named member, or the first .shp, .geojson, .json or .kml, and all members by name. A member outside the archive's own
    folder is an error."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n in z.namelist():
            if n.startswith(("/", "\\")) or ".." in PurePosixPath(n.replace("\\", "/")).parts:
                raise ValueError(f"unsafe_zip_entry: {n}")
        members = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    if name is not None:
        if name not in members:
            raise ValueError(f"entry_not_found: {name}")
        return name, members
    for ending in (".shp", ".geojson", ".json", ".kml"):
        for n in sorted(members):
            if n.lower().endswith(ending):
                return n, members
    raise ValueError("no_supported_file")


def features(name: str, raw: bytes, layer: str | None = None, entry: str | None = None, beside: dict[str, bytes] | None = None) -> Iterator[tuple[str, bytes | None, int]]:
    """The features of one file by its ending."""
    kind = name.lower().rpartition(".")[2]
    if kind == "zip":
        inner, members = zip_member(raw, entry)
        return features(inner, members[inner], layer, None, members)
    if kind in ("geojson", "json"):
        return geojson_features(raw.decode())
    if kind == "kml":
        return kml_features(raw.decode())
    if kind == "gpkg":
        return geopackage_features(raw, layer)
    if kind == "shp":
        stem = name[:-4]
        found = {n.lower(): v for n, v in (beside or {}).items()}
        for needed in (".dbf", ".shx"):
            if (stem + needed).lower() not in found:
                raise ValueError(f"missing_companion: {stem + needed}")
        prj = found.get((stem + ".prj").lower())
        return shapefile_features(raw, found[(stem + ".dbf").lower()], prj.decode() if prj else None)
    raise ValueError(f"unsupported_format: {name}")


def read_vector(spark: SparkSession, path: str, layer: str | None = None, entry: str | None = None, declared: tuple[int, ...] | None = None) -> DataFrame:
    """Features (path, attributes, geom, srid) of all files at path (a glob works), one task a file or so, handed on in batches.
    Shapefiles come zipped. With `declared`, other EPSG codes are an error."""

    def parse(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = features(p.rpartition("/")[2], raw.as_py(), layer, entry)
                while rows := list(islice(found, BATCH_ROWS)):
                    if declared is not None and (other := {r[2] for r in rows} - set(declared)):
                        raise ValueError(f"unsupported_crs: {sorted(other)} in {p}")
                    cols = [[p] * len(rows), *([r[i] for r in rows] for i in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int32()), strict=True)], names=["path", "attributes", "geom", "srid"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, f"path string, {FEATURES}")


def from_wkt(df: DataFrame, column: str, srid: int) -> DataFrame:
    """df with geom and srid from a WKT column."""
    ensure_spatial(df.sparkSession)
    return df.withColumn("geom", st.from_text(column)).withColumn("srid", F.lit(srid))
