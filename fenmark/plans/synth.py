"""Layers and lookups derived from the star-schema tables by integer formulas, for queries with a closed-form twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.plans.nutrient import PACKAGE_PLANT, Reference
from fenmark.session import ensure_spatial

#: Each layer as SELECT id, x0, y0, x1, y1, attributes; read by Spark and DuckDB alike.
RECTANGLES = {
    "dev": "SELECT c_custkey AS id, (c_custkey * 7919) % 99000 AS x0, (c_custkey * 104729) % 99000 AS y0, (c_custkey * 7919) % 99000 + 50 + (c_custkey * 13) % 400 AS x1, (c_custkey * 104729) % 99000 + 50 + (c_custkey * 29) % 400 AS y1, c_name AS name, c_mktsegment AS dwelling_category, CAST(1 + c_custkey % 120 AS INT) AS dwellings FROM customer",
    "coef": "SELECT p_partkey AS id, (p_partkey % 2500 % 50) * 2000 + (p_partkey * 17) % 500 AS x0, CAST(floor(p_partkey % 2500 / 50.0) AS BIGINT) * 2000 + (p_partkey * 31) % 500 AS y0, (p_partkey % 2500 % 50) * 2000 + (p_partkey * 17) % 500 + 1500 AS x1, CAST(floor(p_partkey % 2500 / 50.0) AS BIGINT) * 2000 + (p_partkey * 31) % 500 + 1500 AS y1, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS lu_curr_n_coeff, CAST(10 + p_partkey % 20 AS DOUBLE) AS n_resi_coeff, CAST(p_size AS DOUBLE) / CAST(10 AS DOUBLE) AS lu_curr_p_coeff, CAST(1 + p_partkey % 5 AS DOUBLE) AS p_resi_coeff FROM part",
    "nnc": "SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) * 20000 AS x0, CAST(0 AS BIGINT) AS y0, CAST(r_regionkey AS BIGINT) * 20000 + 15000 AS x1, CAST(100000 AS BIGINT) AS y1, r_name AS n2k_site_n, CAST(r_regionkey AS STRING) AS oid FROM region",
    "lpa": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) % 5 * 20000 AS x0, CAST(floor(n_nationkey / 5.0) AS BIGINT) * 20000 AS y0, CAST(n_nationkey AS BIGINT) % 5 * 20000 + 20000 AS x1, CAST(floor(n_nationkey / 5.0) AS BIGINT) * 20000 + 20000 AS y1, n_name AS name, CASE CAST(n_nationkey AS BIGINT) % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'Amber' ELSE 'Green' END AS rz FROM nation",
    "works": "SELECT s_suppkey AS id, (s_suppkey * 6007) % 80000 AS x0, (s_suppkey * 9001) % 80000 AS y0, (s_suppkey * 6007) % 80000 + 12000 AS x1, (s_suppkey * 9001) % 80000 + 12000 AS y1, CAST(s_suppkey AS STRING) AS code FROM supplier",
    "ponds": "SELECT p_partkey AS id, (p_partkey * 7001) % 100000 AS x0, (p_partkey * 3001) % 100000 AS y0, (p_partkey * 7001) % 100000 AS x1, (p_partkey * 3001) % 100000 AS y1, CASE p_partkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'A' ELSE 'NS' END AS pans, CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'F' END AS tmpimp FROM part",
}
LOOKUPS = {
    "rates": "SELECT r_name AS nn_catchment, CAST(2.0 + r_regionkey * 0.25 AS DOUBLE) AS occupancy_rate, CAST(100.0 + r_regionkey * 10 AS DOUBLE) AS water_usage, r_regionkey AS pos FROM region",
    "works_lookup": f"SELECT CAST(s_suppkey AS STRING) AS wwtw_code, CASE WHEN s_suppkey % 13 = 0 THEN '{PACKAGE_PLANT}' ELSE concat('W', CAST(s_suppkey AS STRING)) END AS wwtw_name, CASE WHEN s_suppkey % 5 <> 0 THEN concat('S', CAST(s_suppkey AS STRING)) END AS wwtw_subcatchment, CAST(10 + s_suppkey % 10 AS DOUBLE) AS n_conc_2025, CAST(8 + s_suppkey % 5 AS DOUBLE) AS n_conc_2030, CAST(1 + s_suppkey % 3 AS DOUBLE) AS p_conc_2025, CAST(0.5 + s_suppkey % 2 AS DOUBLE) AS p_conc_2030, s_suppkey AS pos FROM supplier WHERE s_suppkey % 7 <> 0",
}


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over the one table it names last."""
    table = text.split(" FROM ")[-1].split()[0]
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A layer of rectangles (points for ponds) with real geometries; the corner columns go."""
    ensure_spatial(spark)
    df = _sql(spark, sf_dir, RECTANGLES[name])
    geom = st.point("x0", "y0") if name == "ponds" else st.box("x0", "y0", "x1", "y1")
    return df.withColumn("geom", geom).drop("x0", "y0", "x1", "y1")


def lookup(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _sql(spark, sf_dir, LOOKUPS[name])


def reference(spark: SparkSession, sf_dir: str) -> Reference:
    coef = layer(spark, sf_dir, "coef")
    planning = layer(spark, sf_dir, "lpa")
    return Reference(
        coef.select("geom", "lu_curr_n_coeff", "n_resi_coeff", "lu_curr_p_coeff", "p_resi_coeff"),
        layer(spark, sf_dir, "nnc").select("geom", "n2k_site_n", "oid"),
        layer(spark, sf_dir, "works"),
        planning,
        planning,
        lookup(spark, sf_dir, "rates"),
        lookup(spark, sf_dir, "works_lookup"),
    )


def developments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "dev").withColumn("source", F.lit("synthetic"))
