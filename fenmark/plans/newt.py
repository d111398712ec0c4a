"""The newt assessment: habitat impact by risk zone and pond frequency, for one site or many (a site column) in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.functions.loads import highest_zone
from fenmark.operators.grid import box_pairs, spatial_join
from fenmark.operators.overlay import union_by
from fenmark.session import written


@dataclass(frozen=True)
class Settings:
    buffer_m: float = 250.0
    pond_buffer_m: float = 250.0
    grid: float = 1e-4


def _within_sites(left: DataFrame, right: DataFrame, lgeom: str, rgeom: str) -> DataFrame:
    """Pairs of rows of one site whose geometries share a point, by grid cells: a site with very many rows is no task of its own."""
    other = right.withColumnRenamed("site", "_site")
    met = box_pairs(left, other, lgeom, rgeom).where(F.col("site") == F.col("_site")).drop("_site")
    return met.where(st.intersects(lgeom, rgeom))


def assess(sites: DataFrame, zones: DataFrame, ponds: DataFrame, surveyed: bool = False, s: Settings = Settings()) -> dict[str, DataFrame]:
    """habitat_impact (site, Area, RZ, Shape_Area: a row for each part and zone piece) and pond_frequency (site, PANS, Area, MaxZone,
    TmpImp, FREQUENCY). sites: site, geom; zones: rz, geom; ponds: geom, and if surveyed PANS and perhaps TmpImp.

    The buffer holds the site itself too. Ponds that touch a site count there, cut to it; others in the buffer. A site that meets no
    zone has no rows.
    """
    if surveyed and "PANS" not in ponds.columns:
        raise ValueError("survey ponds must have a PANS column")
    state = ponds.withColumn("PANS", F.col("PANS") if surveyed else F.lit("NS"))
    state = state.withColumn("TmpImp", F.col("TmpImp") if surveyed and "TmpImp" in ponds.columns else F.lit("F")).select("PANS", "TmpImp", "geom")

    # sites of equal shapes have equal results, and so have equal ponds: each is computed once and counts as often as it is there
    shaped = sites.where("geom is not null").select("site", "geom", st.hash_key("geom").alias("_gk"))
    named = shaped.groupBy("site").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_gk")), ","), 256).alias("_shape"))
    named = written(named.join(named.groupBy("_shape").agg(F.min("site").alias("_first")), "_shape").select("site", "_first"))
    state = state.groupBy("PANS", "TmpImp", "geom").agg(F.count(F.lit(1)).alias("n"))
    site = shaped.drop("_gk").join(named.where("site = _first").select("site"), "site").select("site", st.make_valid("geom").alias("geom")).where("geom is not null")

    def all_sites(found: DataFrame) -> DataFrame:
        columns = found.columns
        return found.withColumnRenamed("site", "_first").join(named, "_first").select(*columns)

    # unions go by cells first, so that no task gets all parts of a large site
    around = union_by(site.withColumn("geom", st.buffer("geom", s.buffer_m)), ["site"], "geom", "_all").select("site", st.reduce_precision("_all", s.grid).alias("geom"))
    parts = written(site.withColumn("Area", F.lit("RLB")).unionByName(around.withColumn("Area", F.lit("Buffer"))))
    extent = union_by(parts, ["site"], "geom", "m_geom")
    own = union_by(site, ["site"], "geom", "m_geom")

    extent = written(extent)
    zone = written(spatial_join(zones.select("rz", "geom"), extent, "geom", "m_geom").withColumn("geom", st.intersection("geom", "m_geom")).drop("m_geom").where(~st.is_empty("geom")))
    pond = spatial_join(state, extent, "geom", "m_geom").withColumn("geom", st.intersection("geom", "m_geom")).drop("m_geom").where(~st.is_empty("geom"))
    pond = pond.join(own.withColumnRenamed("m_geom", "own"), "site")
    inside = st.intersects("geom", "own")
    pond = pond.withColumn("Area", F.when(inside, "RLB").otherwise("Buffer")).withColumn("geom", F.when(inside, st.intersection("geom", "own")).otherwise(F.col("geom"))).drop("own")
    pond = pond.withColumn("pond", F.xxhash64("site", "geom", "PANS", "TmpImp", "Area"))
    pond = written(pond.groupBy("site", "pond", "PANS", "TmpImp", "Area", "geom").agg(F.sum("n").alias("n")))  # equal ponds have equal zones

    reach = union_by(pond.withColumn("geom", st.buffer("geom", s.pond_buffer_m)), ["site"], "geom", "_all").select("site", st.reduce_precision("_all", s.grid).alias("m_geom"))
    near = _within_sites(zone, reach, "geom", "m_geom").select("site", "rz", st.intersection("geom", "m_geom").alias("z_geom")).where(~st.is_empty("z_geom"))
    met = _within_sites(parts, written(near), "geom", "z_geom")
    shape = st.reduce_precision(st.intersection(st.reduce_precision("geom", s.grid), st.reduce_precision("z_geom", s.grid)), s.grid)
    habitat = met.select("site", "Area", F.col("rz").alias("RZ"), st.area(shape).alias("Shape_Area")).where("Shape_Area > 0")

    touched = _within_sites(pond, zone.withColumnRenamed("geom", "z_geom"), "geom", "z_geom")
    worst = touched.where("PANS is not null and TmpImp is not null and rz is not null").groupBy("site", "pond", "PANS", "TmpImp", "Area").agg(highest_zone(F.array_sort(F.collect_set("rz"))).alias("MaxZone"), F.first("n").alias("n"))
    frequency = worst.groupBy("site", "PANS", "Area", "MaxZone", "TmpImp").agg(F.sum("n").alias("FREQUENCY"))
    return {"habitat_impact": all_sites(habitat), "pond_frequency": all_sites(frequency)}
