"""The nutrient assessment of developments as one plan. What its joins read again is written to the shared folder on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.functions.loads import Settings, daily_water, land_use_uplift, suds_mitigation, wastewater_load, with_buffer
from fenmark.functions.numeric import ratio, round_half_even, sum_or_zero, to_number
from fenmark.operators.numbering import number_rows
from fenmark.operators.overlay import land_use_pieces, majority_overlap
from fenmark.session import written

PACKAGE_PLANT = "Package Treatment Plant default"
GRID = 27700
#: Older input names and the present ones.
LEGACY_NAMES = {"Name": "name", "Dwel_Cat": "dwelling_category", "Source": "source", "Dwellings": "dwellings", "Shape_Area": "shape_area"}
REQUIRED = ["id", "name", "dwelling_category", "source", "dwellings", "geom"]


@dataclass
class Reference:
    """Layers (geom, version-resolved) and lookups."""

    coefficients: DataFrame
    catchments: DataFrame
    works: DataFrame
    planning: DataFrame
    subcatchments: DataFrame
    rates: DataFrame
    works_lookup: DataFrame


def prepare(sites: DataFrame, order: str = "id", job: str | None = None) -> DataFrame:
    """Present names, the expected columns only, rlb_id from 1 in the given order (within each job, if there are several) and site
    areas. The order column may be of any type that can be ordered; it should be unique. Where sites have a column srid (an EPSG code;
    null: the grid's), geometries are moved to the national grid."""
    have = set(sites.columns)
    sites = sites.withColumnsRenamed({a: b for a, b in LEGACY_NAMES.items() if a in have and b not in have})
    missing = [c for c in REQUIRED if c not in sites.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if "srid" in have:
        sites = sites.withColumn("geom", st.transform("geom", F.coalesce(F.col("srid").cast("int"), F.lit(GRID)), GRID))
    sites = sites.select(*dict.fromkeys([*REQUIRED, order, *([job] if job else [])]))
    if job:
        sites = sites.withColumn("rlb_id", F.row_number().over(Window.partitionBy(job).orderBy(order)))
    else:
        sites = number_rows(sites, order, "rlb_id")
    return sites.withColumn("shape_area", st.area("geom")).withColumn("dev_area_ha", round_half_even(F.col("shape_area") / 10_000.0))


def assess(sites: DataFrame, ref: Reference, s: Settings = Settings(), key: str = "rlb_id", job: str | None = None) -> DataFrame:
    """impact_summary: one row for each development in scope. sites come from prepare(); key must be unique over all jobs.

    The joins' levels and two tables are computed while the plan is built; a tables_go() block around it and the use of its result
    removes the tables. Uplifts are summed as decimals, so that totals do not depend on the order of rows.
    """
    sites = written(sites)  # the joins below read them four times
    out = majority_overlap(
        sites,
        {"majority_wwtw_id": (ref.works, "code", "id", str(s.fallback_works)), "majority_name": (ref.planning, "name", "id", "UNKNOWN"), "majority_opcat_name": (ref.subcatchments, "name", "id", None)},
        key,
    ).withColumn("majority_wwtw_id", F.coalesce(to_number("majority_wwtw_id", "int"), F.lit(s.fallback_works)))

    # what a site of some shape takes of coefficients is the same for all sites of that shape, and equal coefficients count n times
    shape = st.hash_key("geom")
    values = ["lu_curr_n_coeff", "n_resi_coeff", "lu_curr_p_coeff", "p_resi_coeff"]
    equal = ref.coefficients.where("geom is not null").groupBy(shape.alias("_ck"), *values).agg(F.count(F.lit(1)).cast("decimal(10,0)").alias("_n"))
    shapes = sites.where("geom is not null").select(shape.alias("_gk"), F.col("dev_area_ha").alias("_site")).distinct()
    met = land_use_pieces(sites, ref.coefficients.select("geom"), ref.catchments).join(shapes, "_gk").join(equal, "_ck")
    site, area = F.col("_site"), F.col("area_in_nn_catchment_ha")
    met = met.withColumn("n_lu_uplift", land_use_uplift(area, site, to_number("lu_curr_n_coeff"), to_number("n_resi_coeff"), s.greenspace.n_coeff, s.greenspace))
    met = met.withColumn("p_lu_uplift", land_use_uplift(area, site, to_number("lu_curr_p_coeff"), to_number("p_resi_coeff"), s.greenspace.p_coeff, s.greenspace))
    entry = F.when(F.col("oid").isNotNull() & F.col("n2k_site_n").isNotNull(), F.struct("oid", "n2k_site_n"))
    sums = met.groupBy("_gk", "_site").agg(
        # areas are summed in any order, so noise far below a square millimetre is cut before rounding
        F.round(sum_or_zero(area * F.col("_n").cast("double")), 9).alias("area_in_nn_catchment_ha"),
        *[sum_or_zero(F.col(c).try_cast("decimal(20,2)") * F.col("_n")).cast("double").alias(c) for c in ("n_lu_uplift", "p_lu_uplift")],
        F.array_join(F.array_sort(F.collect_set("n2k_site_n")), "; ").alias("nn_catchment"),
        F.array_sort(F.collect_set(entry)).alias("nn_catchment_entries"),
    )
    sums = sums.withColumn("nn_catchment_entries", F.when(F.size("nn_catchment_entries") > 0, F.col("nn_catchment_entries")))
    sums = sums.withColumnsRenamed({"_gk": "_shape"})
    out = out.withColumn("_gk", shape)
    out = out.join(sums, (out["_gk"] == sums["_shape"]) & (out["dev_area_ha"] == sums["_site"]), "left").drop("_gk", "_shape", "_site")
    for e in ("n", "p"):
        out = out.withColumn(f"{e}_lu_post_suds", suds_mitigation(F.col(f"{e}_lu_uplift"), F.col("dwellings"), s.suds))

    rates = ref.rates.groupBy("nn_catchment").agg(F.min_by(F.struct("occupancy_rate", "water_usage"), "pos").alias("r")).select(F.col("nn_catchment").alias("_nn"), "r.*")
    out = out.join(rates, out["nn_catchment"].eqNullSafe(rates["_nn"]), "left").drop("_nn")
    # means are aggregated and joined back, as a works that very many sites share must not become one task
    group = [*([job] if job else []), "majority_wwtw_id"]
    rated = written(out)
    means = rated.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.avg("occupancy_rate").alias("_occupancy"), F.avg("water_usage").alias("_usage"))
    out = rated.join(means, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], "left").drop(*[f"_{c}" for c in group])
    out = out.withColumns({"occupancy_rate": F.coalesce("occupancy_rate", "_occupancy"), "water_usage": F.coalesce("water_usage", "_usage")}).drop("_occupancy", "_usage")
    out = out.withColumn("daily_water_usage_L", daily_water(F.col("dwellings"), F.col("occupancy_rate"), F.col("water_usage")))

    facts = ["wwtw_name", "wwtw_subcatchment", "n_conc_2025", "n_conc_2030", "p_conc_2025", "p_conc_2030"]
    works = ref.works_lookup.withColumn("_code", to_number("wwtw_code", "int")).groupBy("_code").agg(F.min_by(F.struct(*facts), "pos").alias("w")).select("_code", "w.*")
    out = out.join(works, out["majority_wwtw_id"] == works["_code"], "left").drop("_code")
    out = out.withColumn("wwtw_subcatchment", F.when((F.col("majority_wwtw_id") == s.fallback_works) & F.col("wwtw_subcatchment").isNull(), F.col("majority_opcat_name")).otherwise(F.col("wwtw_subcatchment")))
    zero = F.lit(0.0)
    for when, year in (("temp", "2025"), ("perm", "2030")):
        for e in ("n", "p"):
            load = wastewater_load(F.col("dwellings"), F.coalesce("occupancy_rate", zero), F.coalesce("water_usage", zero), F.coalesce(F.col(f"{e}_conc_{year}"), zero), s)
            out = out.withColumn(f"{e}_wwtw_{when}", load)
    for e in ("n", "p"):
        out = out.withColumn(f"{e}_total", with_buffer(F.coalesce(F.col(f"{e}_lu_post_suds"), zero), F.coalesce(F.col(f"{e}_wwtw_perm"), zero), s.buffer_percent))
    out = out.withColumn("dwelling_density", ratio("dwellings", "dev_area_ha"))
    for c in ("area_in_nn_catchment_ha", "n_wwtw_temp", "p_wwtw_temp", "n_wwtw_perm", "p_wwtw_perm", "n_total", "p_total"):
        out = out.withColumn(c, round_half_even(c))
    return in_scope(out).drop("geom")


def in_scope(out: DataFrame) -> DataFrame:
    """Rows without any area in a catchment go, unless a works of its own that is no package plant serves them."""
    outside = F.col("area_in_nn_catchment_ha").isNull()
    return out.where(~(outside & F.col("wwtw_name").isNull())).where(~(outside & F.col("wwtw_name").eqNullSafe(PACKAGE_PLANT)))
