"""What a session needs: the geometry functions, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

JAR = Path(__file__).parent / "jvm" / "geometry.jar"

#: SQL name -> (nested class of fenmark.Geo, or another class's, Spark type of the result)
FUNCTIONS = {
    "fm_area": ("Area", "double"),
    "fm_length": ("Length", "double"),
    "fm_intersection": ("Intersection", "binary"),
    "fm_intersection_area": ("IntersectionArea", "double"),
    "fm_shared": ("Shared", "binary"),
    "fm_shared_area": ("SharedArea", "double"),
    "fm_difference": ("Difference", "binary"),
    "fm_intersects": ("Intersects", "boolean"),
    "fm_distance": ("Distance", "double"),
    "fm_buffer": ("Buffer", "binary"),
    "fm_union": ("Union", "binary"),
    "fm_reduce_precision": ("ReducePrecision", "binary"),
    "fm_make_valid": ("MakeValid", "binary"),
    "fm_is_valid": ("IsValid", "boolean"),
    "fm_is_empty": ("IsEmpty", "boolean"),
    "fm_type": ("Type", "string"),
    "fm_holes": ("Holes", "int"),
    "fm_repeats_vertex": ("RepeatsVertex", "boolean"),
    "fm_polygons": ("Polygons", "binary"),
    "fm_centroid": ("Centroid", "binary"),
    "fm_bounds": ("Bounds", "array<double>"),
    "fm_box": ("Box", "binary"),
    "fm_point": ("Point", "binary"),
    "fm_from_text": ("FromText", "binary"),
    "fm_as_text": ("AsText", "string"),
    "fm_round_exact": ("RoundExact", "double"),
    "fm_transform": ("Crs$Transform", "binary"),
    "fm_as_geojson": ("Crs$AsGeoJson", "string"),
    "fm_shift": ("Shift$Transform", "binary"),
    "fm_from_geojson": ("Parse$FromGeoJson", "binary"),
    "fm_try_geometry": ("Parse$TryGeometry", "binary"),
    "fm_try_text": ("Parse$TryText", "binary"),
    "fm_linework": ("Shapes$Linework", "binary"),
    "fm_pack": ("Blocks$Pack", "binary"),
    "fm_hits": ("Blocks$Hits", "array<int>"),
    "fm_any": ("Blocks$Any", "array<int>"),
    "fm_most": ("Blocks$Most", "array<double>"),
    "fm_near": ("Blocks$Near", "array<double>"),
    "fm_hilbert": ("Shapes$Hilbert", "int"),
    "fm_tile_geometry": ("Crs$TileGeometry", "binary"),
}


def ensure_spatial(spark: SparkSession) -> SparkSession:
    """Adds the jar of geometry functions to a live session and registers them; once a session."""
    if not spark.catalog.functionExists("fm_area"):
        spark.sql(f"ADD JAR '{JAR}'")
        for name, (cls, kind) in FUNCTIONS.items():
            spark.udf.registerJavaFunction(name, f"fenmark.{cls}" if "$" in cls else f"fenmark.Geo${cls}", kind)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one stands in, as in tests; a session with
    a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


#: Paths of the tables scopes that are open, innermost last; each thread has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextlib.contextmanager
def tables_go(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside (by written(), or below shared_folder()) go at the end of the block, so results must be taken
    before. Without a block they go when the driver ends."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            remove(spark, path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed at the end of the tables_go() block around it, or when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone already
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and what follows does not depend on lost executors."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
