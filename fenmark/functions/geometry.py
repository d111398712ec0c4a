"""Column functions over WKB geometries. A null argument gives null. Call session.ensure_spatial(spark) first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _call(name: str, *args: ColumnOrName) -> Column:
    return F.call_function(f"fm_{name}", *[F.col(a) if isinstance(a, str) else a for a in args])


def area(g: ColumnOrName) -> Column:
    return _call("area", g)


def length(g: ColumnOrName) -> Column:
    return _call("length", g)


def intersection(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _call("intersection", a, b)


def intersection_area(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The area of the intersection, without making its bytes."""
    return _call("intersection_area", a, b)


def shared(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The intersection, or null where they share no point."""
    return _call("shared", a, b)


def shared_area(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The area of the intersection, 0 where only boundaries meet, or null where they share no point."""
    return _call("shared_area", a, b)


def difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a without b; a where b is null."""
    return _call("difference", a, b)


def intersects(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whether they share a point; boundaries count."""
    return _call("intersects", a, b)


def distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _call("distance", a, b)


def buffer(g: ColumnOrName, d: Column | float) -> Column:
    """All points within d; 16 segments a quarter circle."""
    return _call("buffer", g, d if isinstance(d, Column) else F.lit(float(d)))


def packed(many: ColumnOrName) -> Column:
    """An array of geometries as one block, for the functions below; a block's rows are named by their places from 0."""
    return _call("pack", many)


#: The cell in which a pair counts, as grid.blocks() gives it.
_CELL = ("_cx", "_cy", "_s")


def block_hits(g: ColumnOrName, block: ColumnOrName, first: bool = False) -> Column:
    """Places in block of all that share a point with g, or of one of them."""
    return _call("any" if first else "hits", g, block, *_CELL)


def block_most(g: ColumnOrName, block: ColumnOrName) -> Column:
    """[place, area] of what shares most with g, the first of equals; empty where nothing shares a point."""
    return _call("most", g, block, *_CELL)


def block_near(g: ColumnOrName, block: ColumnOrName, most: float, few: int = 0) -> Column:
    """Places of all that are at most `most` away from g, then their distances; with few only so many, the nearest, the first of equals."""
    return _call("near", g, block, F.lit(float(most)), F.lit(few), *_CELL)


def union(many: ColumnOrName) -> Column:
    """The union of an array of geometries."""
    return _call("union", many)


def union_agg(g: ColumnOrName) -> Column:
    return union(F.collect_list(g))


def reduce_precision(g: ColumnOrName, grid: float) -> Column:
    return _call("reduce_precision", g, F.lit(float(grid)))


def make_valid(g: ColumnOrName, linework: bool = False) -> Column:
    """A valid geometry. With linework, polygons by the even-odd rule over all their rings: parts that overlap twice become holes."""
    return _call("linework" if linework else "make_valid", g)


def is_valid(g: ColumnOrName) -> Column:
    return _call("is_valid", g)


def is_empty(g: ColumnOrName) -> Column:
    return _call("is_empty", g)


def geometry_type(g: ColumnOrName) -> Column:
    return _call("type", g)


def holes(g: ColumnOrName) -> Column:
    return _call("holes", g)


def repeats_vertex(g: ColumnOrName) -> Column:
    return _call("repeats_vertex", g)


def polygons(g: ColumnOrName) -> Column:
    """The polygons of a collection only."""
    return _call("polygons", g)


def centroid(g: ColumnOrName) -> Column:
    return _call("centroid", g)


def bounds(g: ColumnOrName) -> Column:
    """[xmin, ymin, xmax, ymax]."""
    return _call("bounds", g)


def box(x0: ColumnOrName, y0: ColumnOrName, x1: ColumnOrName, y1: ColumnOrName) -> Column:
    return _call("box", *[(F.col(v) if isinstance(v, str) else v).cast("double") for v in (x0, y0, x1, y1)])


def point(x: ColumnOrName, y: ColumnOrName) -> Column:
    return _call("point", *[(F.col(v) if isinstance(v, str) else v).cast("double") for v in (x, y)])


def from_text(s: ColumnOrName) -> Column:
    return _call("from_text", s)


def try_from_text(s: ColumnOrName) -> Column:
    """A geometry from WKT; null where that is damaged."""
    return _call("try_text", s)


def from_geojson(s: ColumnOrName) -> Column:
    """A geometry from the text of a GeoJSON geometry or feature, in two dimensions; null where that is damaged."""
    return _call("from_geojson", s)


def sound(g: ColumnOrName) -> Column:
    """WKB as it is; null where it cannot be read."""
    return _call("try_geometry", g)


def hilbert(x: ColumnOrName, y: ColumnOrName, box: tuple[float, float, float, float]) -> Column:
    """The place of a point on Hilbert's curve through box (xmin, ymin, xmax, ymax) in 32,768 cells a side; points outside count as at
    its edge."""
    x0, y0, x1, y1 = box

    def cell(v: ColumnOrName, low: float, high: float) -> Column:
        v = (F.col(v) if isinstance(v, str) else v).cast("double")
        return F.floor(F.least(F.greatest((v - low) / max(high - low, 1e-9), F.lit(0.0)), F.lit(1.0)) * 32767).cast("int")

    return _call("hilbert", cell(x, x0, x1), cell(y, y0, y1))


def as_text(g: ColumnOrName) -> Column:
    return _call("as_text", g)


def as_geojson(g: ColumnOrName) -> Column:
    return _call("as_geojson", g)


def transform(g: ColumnOrName, source: Column | int, target: int) -> Column:
    """Coordinates from one of EPSG 27700, 4326 and 3857 to another; 27700 is right to some metres."""
    return _call("transform", g, source if isinstance(source, Column) else F.lit(source), F.lit(target))


def shifted(g: ColumnOrName, source: int, target: int, grid: str) -> Column:
    """Coordinates between EPSG 27700 and 4326 by a file of local shifts (NTv2, of at most 256 MB) at path grid, which every worker
    reads once; so right to what the file holds, centimetres for the national one. Outside of its grids as transform()."""
    return _call("shift", g, F.lit(source), F.lit(target), F.lit(grid))


def tile_geometry(g: ColumnOrName, z: int, x: int, y: int) -> Column:
    """A web Mercator geometry on a tile's grid of 4096 with a margin of 64; null outside."""
    return tile_geometry_at(g, F.lit(z), F.lit(x), F.lit(y))


def tile_geometry_at(g: ColumnOrName, z: Column, x: Column, y: Column) -> Column:
    """tile_geometry() for a tile that differs from row to row."""
    return _call("tile_geometry", g, z, x, y)


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax of a tile in web Mercator."""
    world = 2 * 3.141592653589793 * 6378137.0
    side = world / 2**z
    return -world / 2 + x * side, world / 2 - (y + 1) * side, -world / 2 + (x + 1) * side, world / 2 - y * side


def hash_key(g: ColumnOrName) -> Column:
    """A name for a geometry by its bytes: equal geometries have the same."""
    return F.sha2(F.col(g) if isinstance(g, str) else g, 256)


def epsg(text: str) -> int:
    """27700 from EPSG:27700 in any of its spellings; ValueError for others."""
    found = re.fullmatch(r"(?i)(?:urn:ogc:def:crs:)?EPSG:{1,2}(\d+)", text.strip())
    if not found:
        raise ValueError(f"no EPSG code: {text}")
    return int(found[1])
