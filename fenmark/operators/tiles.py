"""Vector tiles: geometries on a tile's grid, encoded as a Mapbox vector tile layer; one tile, or all tiles of a range of zooms."""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.operators.grid import spatial_join, spread
from fenmark.operators.outputs import tile_etag
from fenmark.session import written

#: Features of a tile that are encoded or decoded together, and how many times as many entries of its dictionaries are.
PART_FEATURES, FAN = 4096, 8
PARTIAL = "z int, x int, y int, part long, names array<binary>, shown array<binary>, tags array<array<int>>, bodies array<binary>"
#: A piece of a tile's layer: its place in the tile, its bytes, and how many features they hold.
PIECE = "z int, x int, y int, place long, piece binary, features long"
#: Places of features, of keys and of values begin here.
KEYS_AT, VALUES_AT = 1 << 60, 1 << 61
WORLD = 2 * 3.141592653589793 * 6378137.0


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def _area(ring: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def commands(wkb: bytes) -> tuple[int, list[int]]:
    """Tile geometry type (1 point, 2 line, 3 polygon) and command integers of a WKB geometry with whole coordinates."""
    at, cursor, out, kind = 0, [0, 0], [], 0

    def take(form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from(form, wkb, at)
        at += struct.calcsize(form)
        return got

    def points(order: str) -> list[tuple[int, int]]:
        (n,) = take(order + "I")
        return [tuple(round(v) for v in take(order + "dd")) for _ in range(n)]

    def move(p: tuple[int, int]) -> None:
        out.extend((_zigzag(p[0] - cursor[0]), _zigzag(p[1] - cursor[1])))
        cursor[:] = p

    def path(ring: list[tuple[int, int]], close: bool) -> None:
        out.append(1 | 1 << 3)
        move(ring[0])
        out.append(2 | len(ring[1:]) << 3)
        for p in ring[1:]:
            move(p)
        if close:
            out.append(7 | 1 << 3)

    def geometry() -> None:
        nonlocal kind
        (little,) = take("B")
        order = "<" if little else ">"
        (code,) = take(order + "I")
        if code == 1:
            kind = kind or 1
            p = tuple(round(v) for v in take(order + "dd"))
            out.append(1 | 1 << 3)
            move(p)
        elif code == 2:
            kind = max(kind, 2)
            path(points(order), False)
        elif code == 3:
            kind = 3
            (n,) = take(order + "I")
            for i in range(n):
                ring = points(order)[:-1]
                # y points down: outer rings have a positive area, holes a negative one
                if (_area(ring) > 0) != (i == 0):
                    ring = ring[:1] + ring[:0:-1]
                path(ring, True)
        else:
            (n,) = take(order + "I")
            for _ in range(n):
                geometry()

    geometry()
    return kind, out


def _value(v: object) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(6 << 3) + _varint(v << 1 if v >= 0 else (-v << 1) - 1)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def encode_layer(name: str, rows: list[tuple[bytes, dict]]) -> bytes:
    """A tile with one layer of (WKB on the grid, properties): strings, numbers and truth values keep their kind."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    features = b""
    for wkb, properties in rows:
        kind, numbers = commands(wkb)
        tags = [x for k, v in properties.items() if v is not None for x in (keys.setdefault(k, len(keys)), values.setdefault(_value(v), len(values)))]
        body = _field(2, b"".join(map(_varint, tags))) + _varint(3 << 3) + _varint(kind) + _field(4, b"".join(map(_varint, numbers)))
        features += _field(2, body)
    layer = _varint(15 << 3) + _varint(2) + _field(1, name.encode()) + features
    layer += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values)
    return _field(3, layer + _varint(5 << 3) + _varint(4096))


def near_box(layer: DataFrame, box: tuple[float, float, float, float], stored: tuple[str, str, str, str] | None = None) -> DataFrame:
    """layer's rows whose bounding box shares a point with box, all in one system. With `stored`, columns that hold xmin, ymin, xmax
    and ymax, the filter reaches the scan and no geometry is read for it."""
    if stored:
        x0, y0, x1, y1 = (F.col(c) for c in stored)
    else:
        b = st.bounds("geom")
        x0, y0, x1, y1 = (b[i] for i in range(4))
    return layer.where((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]))


def _source_box(spark: SparkSession, z: int, x: int, y: int, srid: int, steps: int = 16) -> tuple[float, float, float, float]:
    """A box in srid that holds a tile, by points along its sides and a margin for their bow in between."""
    x0, y0, x1, y1 = st.tile_bounds(z, x, y)
    side = [(x0 + (x1 - x0) * i / steps, y0 + (y1 - y0) * j / steps) for i in range(steps + 1) for j in range(steps + 1) if i in (0, steps) or j in (0, steps)]
    moved = spark.createDataFrame(side, "px double, py double").select(st.bounds(st.transform(st.point("px", "py"), 3857, srid)).alias("b"))
    r = moved.agg(F.min(F.col("b")[0]), F.min(F.col("b")[1]), F.max(F.col("b")[2]), F.max(F.col("b")[3])).first()
    margin = max(r[2] - r[0], r[3] - r[1]) * 0.02
    return r[0] - margin, r[1] - margin, r[2] + margin, r[3] + margin


def tile(layer: DataFrame, name: str, z: int, x: int, y: int, properties: list[str], srid: int = 27700, version: int = 1, stored: tuple[str, str, str, str] | None = None) -> DataFrame:
    """One row (z, x, y, tile, features, etag): the features of layer (geom in srid) that touch the tile; no row if none does.

    Features far from the tile go by their boxes, before any geometry is transformed; see near_box() for `stored`."""
    spark = layer.sparkSession
    close = near_box(layer, _source_box(spark, z, x, y, srid), stored)
    one = spark.range(1).select(st.box(*[F.lit(v) for v in st.tile_bounds(z, x, y)]).alias("t_geom"))
    rows = spatial_join(close.select(*properties, st.transform("geom", srid, 3857).alias("geom")), one, "geom", "t_geom")
    rows = rows.select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"), st.tile_geometry("geom", z, x, y).alias("g"), *properties).where("g is not null")

    def encode(table: pa.Table) -> pa.Table:
        body = [(r["g"], {p: r[p] for p in properties}) for r in table.to_pylist()]
        body.sort(key=lambda r: ([str(v) for v in r[1].values()], r[0]))
        return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "tile": pa.array([encode_layer(name, body)], pa.binary()), "features": pa.array([len(body)], pa.int64())})

    # a tile is what one browser request loads, so its features fit one task
    tiles = rows.groupBy("z", "x", "y").applyInArrow(encode, "z int, x int, y int, tile binary, features long")
    return tiles.withColumn("etag", tile_etag(name, "z", "x", "y", version))


def _tile_box(z: Column, x: Column, y: Column, margin: float = 0.0) -> Column:
    side = F.lit(WORLD) / F.pow(F.lit(2.0), z)
    m = side * margin
    left, top = F.lit(-WORLD / 2) + x * side, F.lit(WORLD / 2) - y * side
    return st.box(left - m, top - side - m, left + side + m, top + m)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, int], list[dict]]]:
    """Rows that follow each other with the same z, x, y and part."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = (r["z"], r["x"], r["y"], r["part"])
            if k != at:
                if rows:
                    yield at, rows
                at, rows = k, []
            rows.append(r)
    if rows:
        yield at, rows


def _encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with h, g and properties (JSON text of an object) to partial layers with dictionaries of their own, features in order of h."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.binary())]
    for k, rows in _grouped(batches):
        rows.sort(key=lambda r: (r["h"], r["properties"], r["g"]))
        given = [{n.encode(): _value(v) for n, v in json.loads(r["properties"]).items() if v is not None} for r in rows]
        names, shown = sorted({n for o in given for n in o}), sorted({v for o in given for v in o.values()})
        key, value = {n: i for i, n in enumerate(names)}, {v: i for i, v in enumerate(shown)}
        tags = [[i for n, v in o.items() for i in (key[n], value[v])] for o in given]
        bodies = []
        for r in rows:
            kind, numbers = commands(r["g"])
            bodies.append(_varint(3 << 3) + _varint(kind) + _field(4, b"".join(map(_varint, numbers))))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*k, names, shown, tags, bodies), kinds, strict=True)], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _piece(z: int, x: int, y: int, place: int, piece: bytes, features: int) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((z, x, y, place, piece, features), kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])


def _feature_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial layers with the tile's numbers of their keys and values (`to_key`, `to_value`) to the bytes of their features."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            key, value = r["to_key"] or [], r["to_value"] or []
            tags = (b"".join([_varint(n) for k, v in zip(t[::2], t[1::2], strict=True) for n in (key[k], value[v])]) for t in r["tags"])
            piece = b"".join([_field(2, _field(2, t) + body) for t, body in zip(tags, r["bodies"], strict=True)])
            yield _piece(r["z"], r["x"], r["y"], r["part"], piece, len(r["bodies"]))


def _entry_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of dictionaries in order, with their number at in the tile, to bytes; of each run of entries together."""
    key, first, last, out = None, 0, 0, []
    for b in batches:
        for z, x, y, kind, v, at in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "kind", "v", "at")), strict=True):
            if (z, x, y, kind) != key or at != last + 1 or len(out) == PART_FEATURES * FAN:
                if out:
                    yield _piece(*key[:3], first + (VALUES_AT if key[3] else KEYS_AT), b"".join(out), 0)
                key, first, out = (z, x, y, kind), at, []
            out.append(_field(4 if kind else 3, v))
            last = at
    if out:
        yield _piece(*key[:3], first + (VALUES_AT if key[3] else KEYS_AT), b"".join(out), 0)


def _entries_numbered(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct entries (keys, v), which are in order within a part of the table, and at: their places among those of equal keys, from 0."""
    spark, order = entries.sparkSession, [*keys, "v"]
    table = written(entries.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # ranges follow each other, so a place is that in the range and the rows of the ranges before
    held = table.groupBy(F.shiftright("_at", 33).alias("_range"), *keys).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(held.withColumn("_base", before - F.col("_low")).select("_range", *keys, "_base"))
    return table.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts) if _few(starts) else starts, ["_range", *keys]).select(*order, (F.col("_at") + F.col("_base")).alias("at"))


def _few(df: DataFrame) -> bool:
    return df.count() <= 100_000


def _varint_of(n: Column) -> Column:
    """The bytes of _varint() for whole numbers below 2**35."""
    def byte(i: int, more: int) -> Column:
        return F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * i).bitwiseAND(127).bitwiseOR(more)), 2, "0"))

    sizes = [F.concat(*[byte(i, 128) for i in range(size - 1)], byte(size - 1, 0)) for size in range(1, 6)]
    out = F.when(n < 1 << 7, sizes[0])
    for size in range(2, 5):
        out = out.when(n < 1 << 7 * size, sizes[size - 1])
    return out.otherwise(sizes[4])


def pyramid(layer: DataFrame, name: str, zooms: tuple[int, int], properties: list[str], srid: int = 27700, version: int = 1) -> DataFrame:
    """(z, x, y, tile, features, etag) for every tile of the zooms from the first to the last that a feature of layer (geom in srid)
    touches.

    Features are dealt to the tiles of the first zoom by their boxes and cut there; the tiles of each further zoom take what is left in
    the one above, so that a feature costs what of it is in a tile. A tile's features are encoded in parts of about PART_FEATURES with
    dictionaries of their own; the tile's dictionaries are numbered over all its parts, and each part is written with these numbers. Only
    the bytes of a tile come together in one task, and none of them in Python. What is smaller than a step of a tile's grid goes. Null
    geometries are in no tile; an empty layer has none.
    """
    low, high = zooms
    margin = 64 / 4096
    rows = spread(layer).select(F.to_json(F.struct(*properties)).alias("properties"), st.transform("geom", srid, 3857).alias("geom")).where("geom is not null")
    b, side = st.bounds("geom"), WORLD / 2**low
    rows = rows.withColumn("_b", b).where(F.col("_b").isNotNull())

    def across(v: Column, first: bool, down: bool) -> Column:
        at = (F.lit(WORLD / 2) - v if down else v + WORLD / 2) / side
        return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(2**low - 1)).cast("int")

    rows = rows.withColumn("x", F.explode(F.sequence(across(F.col("_b")[0], True, False), across(F.col("_b")[2], False, False))))
    rows = rows.withColumn("y", F.explode(F.sequence(across(F.col("_b")[3], True, True), across(F.col("_b")[1], False, True))))
    z, x, y = F.col("z"), F.col("x"), F.col("y")

    def cut(df: DataFrame) -> DataFrame:
        here = df.where(st.intersects("geom", _tile_box(z, x, y)))
        return written(here.select("z", "x", "y", "properties", st.shared("geom", _tile_box(z, x, y, margin)).alias("geom")))

    levels = [cut(rows.withColumn("z", F.lit(low)))]
    for zoom in range(low + 1, high + 1):
        four = levels[-1].withColumn("_c", F.explode(F.array(*[F.struct((x * 2 + i).cast("int").alias("x"), (y * 2 + j).cast("int").alias("y")) for i in (0, 1) for j in (0, 1)])))
        levels.append(cut(four.select(F.lit(zoom).alias("z"), "_c.x", "_c.y", "properties", "geom")))
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    every = written(every.select("z", "x", "y", "properties", st.tile_geometry_at("geom", z, x, y).alias("g")).where("g is not null"))
    keys = ["z", "x", "y"]
    sizes = every.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_FEATURES).alias("parts"))
    # parts follow each other in the order of a hash, so a tile is the same however many it has
    every = every.join(sizes, keys).withColumn("h", F.shiftrightunsigned(F.xxhash64("properties", "g"), 33))
    every = every.withColumn("part", F.shiftright(F.col("h") * F.col("parts"), 31)).drop("parts")
    by = [*keys, "part"]
    made = written(every.repartition(*by).sortWithinPartitions(*by).mapInArrow(_encode_parts, PARTIAL))
    entries = made.select(*by, F.lit(0).alias("kind"), F.posexplode("names").alias("i", "v")).union(made.select(*by, F.lit(1), F.posexplode("shown")))
    numbered = written(_entries_numbered(entries, [*keys, "kind"]))
    own = entries.join(numbered, [*keys, "kind", "v"]).groupBy(*by)

    def numbers(kind: int) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", "at"))))
        return F.transform(pairs, lambda p: p["at"])

    own = own.agg(numbers(0).alias("to_key"), numbers(1).alias("to_value"))
    pieces = made.drop("names", "shown").join(own, by, "left").mapInArrow(_feature_pieces, PIECE)
    pieces = pieces.union(numbered.sortWithinPartitions(*keys, "kind", "at").mapInArrow(_entry_pieces, PIECE))
    # a tile is far more bytes than Spark expects, so tiles are not put together into few tasks
    tasks = max(4 * layer.sparkSession.sparkContext.defaultParallelism, int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = pieces.repartition(tasks, *keys).groupBy(*keys).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY place)").alias("_layer"), F.sum("features").alias("features"))
    begin, end = _varint(15 << 3) + _varint(2) + _field(1, name.encode()), _varint(5 << 3) + _varint(4096)
    size = F.length("_layer") + len(begin) + len(end)
    whole = whole.select(*keys, F.concat(F.lit(_varint(3 << 3 | 2)), _varint_of(size), F.lit(begin), "_layer", F.lit(end)).alias("tile"), "features")
    return whole.withColumn("etag", tile_etag(name, "z", "x", "y", version))


def _places(raw: memoryview) -> Iterator[tuple[int, int, int | None, int]]:
    """Number, start, end of each field of a message; where it holds a whole number, that instead of the start, and no end. The last is
    the kind on the wire."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number(), None, 0
            continue
        size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, at, at + size, tag & 7
        at += size


def _fields(raw: memoryview) -> Iterator[tuple[int, memoryview | int]]:
    """Number and value of each field of a message: bytes, or a whole number."""
    for n, start, end, _ in _places(raw):
        yield n, start if end is None else raw[start:end]


def decoded(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, kind, properties): a row for each feature of tiles (z, x, y, tile). kind is point, line or polygon; properties
    is an array of key and value as text. Values that are text or numbers are read; others are null. Of a tile, its bytes and the places
    of its values are held, and PART_FEATURES features at a time."""

    def value(raw: memoryview) -> str | None:
        for n, v in _fields(raw):
            if n == 1:
                return bytes(v).decode()
            if n == 3:
                return repr(struct.unpack("<d", v)[0])
            if n == 6:
                return str(v >> 1 ^ -(v & 1))
        return None

    kinds = [pa.int32()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["z", "x", "y", "layer", "kind", "properties"])

    def features(layer: memoryview) -> Iterator[tuple[str, str | None, list[dict]]]:
        name, keys, starts, ends = "", [], array("q"), array("q")
        for n, start, end, _ in _places(layer):
            if n == 1:
                name = bytes(layer[start:end]).decode()
            elif n == 3:
                keys.append(bytes(layer[start:end]).decode())
            elif n == 4:
                starts.append(start)
                ends.append(end)
        for n, start, end, _ in _places(layer):
            if n != 2:
                continue
            own, tags, t, shift = dict(_fields(layer[start:end])), [], 0, 0
            for byte in own.get(2, b""):
                t |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    tags.append(t)
                    t = shift = 0
            given = [{"key": keys[k], "value": value(layer[starts[v] : ends[v]])} for k, v in zip(tags[::2], tags[1::2], strict=True)]
            yield name, {1: "point", 2: "line", 3: "polygon"}.get(own.get(3)), given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                z, x, y = (b.column(c)[i].as_py() for c in range(3))
                out = []
                for _, layer in _fields(memoryview(b.column(3)[i].as_buffer()).cast("B")):
                    for f in features(layer):
                        out.append((z, x, y, *f))
                        if len(out) == PART_FEATURES:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)

    return tiles.select("z", "x", "y", "tile").mapInArrow(run, "z int, x int, y int, layer string, kind string, properties array<struct<key: string, value: string>>")
