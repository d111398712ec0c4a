"""Checks of an uploaded boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.functions.numeric import round_exact

#: Square metres an acre, metres a mile.
ACRE, MILE = 4_046.856, 1_609.344


def first_error(g: str = "geom") -> Column:
    """The first code of what is wrong with a boundary, null if nothing is."""
    return F.coalesce(
        F.when(F.col(g).isNull() | st.is_empty(g), "invalid_geometry"),
        F.when(~st.geometry_type(g).isin("Polygon", "MultiPolygon"), "unsupported_geometry_type"),
        F.when(~st.is_valid(g), "self_intersecting_geometry"),
        F.when(st.holes(g) > 0, "geometry_has_holes"),
        F.when(st.repeats_vertex(g), "duplicate_vertices"),
    )


def metadata(g: str = "geom", srid: int = 27700) -> Column:
    """Area, perimeter, the middle of the bounding box and its corners."""
    b = st.bounds(st.transform(g, srid, 4326))
    x0, y0, x1, y1 = (round_exact(b[i], 6) for i in range(4))
    return F.struct(
        F.struct(round_exact(st.area(g) / 10_000.0, 4).alias("hectares"), round_exact(st.area(g) / ACRE, 4).alias("acres")).alias("area"),
        F.struct(round_exact(st.length(g) / 1_000.0, 4).alias("kilometres"), round_exact(st.length(g) / MILE, 4).alias("miles")).alias("perimeter"),
        F.array(round_exact((b[0] + b[2]) / 2, 6), round_exact((b[1] + b[3]) / 2, 6)).alias("centre"),
        F.struct(F.array(x0, y1).alias("topLeft"), F.array(x1, y1).alias("topRight"), F.array(x1, y0).alias("bottomRight"), F.array(x0, y0).alias("bottomLeft")).alias("bounds"),
    )
