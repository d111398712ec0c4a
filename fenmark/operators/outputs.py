"""Result shapes: the fixed CSV, JSON records, the nested payloads, dumps, and the callback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.functions.loads import band
from fenmark.functions.numeric import round_exact

#: The CSV's columns in order, and where each comes from.
CSV_COLUMNS = {
    "RLB_ID": "rlb_id",
    "id": "id",
    "Name": "name",
    "Dwel_Cat": "dwelling_category",
    "Source": "source",
    "Dwellings": "dwellings",
    "Dev_Area_Ha": "dev_area_ha",
    "AreaInNNCatchment": "area_in_nn_catchment_ha",
    "NN_Catchment": "nn_catchment",
    "Dev_SubCatchment": "majority_opcat_name",
    "Majority_LPA": "majority_name",
    "Majority_WwTw_ID": "majority_wwtw_id",
    "WwTW_name": "wwtw_name",
    "WwTw_SubCatchment": "wwtw_subcatchment",
    "N_LU_Uplift": "n_lu_uplift",
    "P_LU_Uplift": "p_lu_uplift",
    "N_LU_postSuDS": "n_lu_post_suds",
    "P_LU_postSuDS": "p_lu_post_suds",
    "Occ_Rate": "occupancy_rate",
    "Water_Usage_L_Day": "water_usage",
    "Litres_used": "daily_water_usage_L",
    "Nitrogen_2025_2030": "n_conc_2025",
    "Nitrogen_2030_onwards": "n_conc_2030",
    "Phosphorus_2025_2030": "p_conc_2025",
    "Phosphorus_2030_onwards": "p_conc_2030",
    "N_WwTW_Temp": "n_wwtw_temp",
    "P_WwTW_Temp": "p_wwtw_temp",
    "N_WwTW_Perm": "n_wwtw_perm",
    "P_WwTW_Perm": "p_wwtw_perm",
    "N_Total": "n_total",
    "P_Total": "p_total",
}


def csv_projection(summary: DataFrame) -> DataFrame:
    return summary.select(*[F.col(c).alias(name) for name, c in CSV_COLUMNS.items()])


def write_csv(summary: DataFrame, path: str, separator: str = ",") -> None:
    """An empty result is an error."""
    if summary.isEmpty():
        raise ValueError("nothing to write")
    csv_projection(summary).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def payload(summary: DataFrame) -> DataFrame:
    """reference-ready JSON: totals with bands, rounded exactly, and the catchments as objects."""
    def load(e: str):
        t = F.col(f"{e}_total")
        return F.struct(round_exact(t, 2).alias("total"), band(t).alias("band"))

    entries = F.coalesce(F.transform("nn_catchment_entries", lambda x: F.struct(x["oid"].alias("id"), x["n2k_site_n"].alias("name"))), F.array().cast("array<struct<id:string,name:string>>"))
    within = F.coalesce(F.col("area_in_nn_catchment_ha") > 0, F.lit(False))
    body = F.struct(load("n").alias("nitrogen"), load("p").alias("phosphorus"), entries.alias("catchments"), F.col("wwtw_name").alias("wasteWaterTreatmentWorks"), within.alias("withinCatchment"))
    return summary.select("rlb_id", "id", F.to_json(body).alias("payload"))


def json_records(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One column `record`: each row as JSON without its geometry; null fields are kept."""
    return df.drop(geom).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def with_predicates(summary: DataFrame) -> DataFrame:
    """summary with within_nn_catchment (it meets a catchment), within_works_catchment (its works has a name) and
    requires_assessment (either)."""
    nn, works = F.coalesce(F.size("nn_catchment_entries") > 0, F.lit(False)), F.col("wwtw_name").isNotNull()
    return summary.withColumns({"within_nn_catchment": nn, "within_works_catchment": works, "requires_assessment": nn | works})


def newt_payload(habitat: DataFrame, frequency: DataFrame) -> DataFrame:
    """site, payload: the newt results of each site as JSON, with `habitatImpacts` (area, zone, squareMetres) and `pondFrequencies`
    (pans, area, zone, impact, frequency), both in order. A site with one kind of rows only has an empty list of the other."""
    impacts = habitat.groupBy("site", "Area", "RZ").agg(F.round(F.sum("Shape_Area"), 1).alias("m2"))  # pieces of a zone as one
    impacts = impacts.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(F.col("Area").alias("area"), F.col("RZ").alias("zone"), F.col("m2").alias("squareMetres")))).alias("h"))
    ponds = F.struct(F.col("PANS").alias("pans"), F.col("Area").alias("area"), F.col("MaxZone").alias("zone"), F.col("TmpImp").alias("impact"), F.col("FREQUENCY").alias("frequency"))
    both = impacts.join(frequency.groupBy("site").agg(F.array_sort(F.collect_list(ponds)).alias("p")), "site", "full")
    none = F.array()
    body = F.struct(F.coalesce("h", none.cast(both.schema["h"].dataType)).alias("habitatImpacts"), F.coalesce("p", none.cast(both.schema["p"].dataType)).alias("pondFrequencies"))
    return both.select("site", F.to_json(body).alias("payload"))


def dump(results: dict[str, DataFrame], folder: str, codec: str = "gzip") -> None:
    """Each result as compressed Parquet parts below folder/name; for looking at stages, and as a backup that Spark reads again."""
    for name, df in results.items():
        df.write.mode("overwrite").option("compression", codec).parquet(f"{folder.rstrip('/')}/{name}")


#: Answers that say that sending again is of no use.
FINAL_STATUS = (400, 404)


def send(rows: DataFrame, post: Callable[[str, str], int], key: str = "id", body: str = "payload", retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, status, attempts: each row handed to post(key, body), which gives a status or raises OSError where nothing answers.

    Statuses but successes, 400 and 404 are tried again after 1, 2, 4 .. seconds, and so is no answer. No answer at all is status 0. A
    task that runs again sends again, so a receiver must take a key twice. Lazy: take the result once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, attempts = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in range(retries + 1):
                    try:
                        got = post(k, v)
                    except OSError:
                        got = 0
                    if 200 <= got < 300 or got in FINAL_STATUS or n == retries:
                        break
                    wait(2.0**n)
                status.append(got)
                attempts.append(n + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.int32()), pa.array(attempts, pa.int32())], names=[key, "status", "attempts"])

    return rows.select(F.col(key).cast("string"), F.col(body).cast("string")).mapInArrow(run, f"`{key}` string, status int, attempts int")


def tile_etag(layer: str, z: Column | str, x: Column | str, y: Column | str, version: int) -> Column:
    """The tag of a tile: the same as long as layer, tile and version are."""
    return F.sha2(F.concat_ws(":", F.lit(layer), z, x, y, F.lit(version)), 256)
