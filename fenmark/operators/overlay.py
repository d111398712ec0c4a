"""Assignments and overlays on top of the grid join. Ties go to the smaller feature id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.operators.grid import BASE, LOWEST, STEP, blocks, box_pairs, classes, levels, measured, met, spatial_join, spread
from fenmark.session import written

#: Tasks over which pairs with one shape are dealt.
DEALT = 8


def _feature(layer: DataFrame, attr: str, fid: str) -> DataFrame:
    return layer.select(F.col("geom").alias("r_geom"), F.col(fid).alias("_fid"), F.col(attr).cast("string").alias("_attr"))


def _shapes(left: DataFrame) -> DataFrame:
    """left's distinct geometries with a name each, _gk: what holds for a geometry is computed once for all rows that have it."""
    return spread(left.where(F.col("geom").isNotNull()).select("geom")).select(st.hash_key("geom").alias("_gk"), "geom").dropDuplicates(["_gk"])


def _with_shape(left: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    return left.withColumn("_gk", st.hash_key("geom")).join(found, "_gk", how).drop("_gk")


def majority_overlap(left: DataFrame, layers: dict[str, tuple[DataFrame, str, str, object]], key: str, touching: bool = True) -> DataFrame:
    """left with a column for each of layers {name: (layer, attribute, feature id, default)}: the attribute of the feature that
    overlaps most. The default stands where nothing does, or where the winner's attribute is null.

    All layers go through one join and one grouping. touching: a shared boundary (area 0) counts. Feature ids may be numbers or
    strings; in layers of different kinds they are compared as strings.
    """
    if len({layer.schema[fid].dataType for layer, _, fid, _ in layers.values()}) > 1:
        layers = {name: (layer.withColumn(fid, F.col(fid).cast("string")), attr, fid, default) for name, (layer, attr, fid, default) in layers.items()}
    tagged = reduce(DataFrame.unionByName, [_feature(layer, attr, fid).withColumn("_layer", F.lit(name)) for name, (layer, attr, fid, _) in layers.items()])
    # of equal features the one with the smallest id can win only
    tagged = tagged.groupBy("_layer", "r_geom").agg(F.min_by(F.struct("_fid", "_attr"), "_fid").alias("_f")).select("_layer", "r_geom", "_f.*")
    pairs = measured(blocks(_shapes(left), tagged, ["_fid", "_attr"], by=["_layer"]), st.block_most("geom", "_block"), "_area")
    pairs = pairs.select("_gk", "_layer", "_row", "_area")
    pairs = pairs if touching else pairs.where("_area > 0")
    best = F.struct((-F.col("_area")).alias("_area"), F.col("_row._fid"))
    won = pairs.groupBy("_gk").agg(*[F.min_by(F.struct("_row._attr"), F.when(F.col("_layer") == name, best)).alias(name) for name in layers])
    # min_by passes over rows of other layers, whose order is null
    won = won.select("_gk", *[F.col(f"{name}._attr").alias(name) for name in layers])
    out = _with_shape(left, won)
    for name, (_, _, _, default) in layers.items():
        if default is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


def land_use_pieces(sites: DataFrame, coefficients: DataFrame, catchments: DataFrame) -> DataFrame:
    """Distinct site shape (_gk) x distinct coefficient shape (_ck) x catchment where all three share area, with the catchment's columns
    and area_in_nn_catchment_ha. Geometry columns: geom in each."""
    c = _shapes(coefficients).select(F.col("_gk").alias("_ck"), F.col("geom").alias("c_geom")).withColumn("r_geom", F.col("c_geom"))
    n = catchments.withColumnRenamed("geom", "n_geom")
    two = met(blocks(_shapes(sites), c, ["_ck", "c_geom"])).select("_gk", "geom", "_row.*")
    # a catchment must meet both; their pair is narrowed first
    two = two.withColumn("cut", st.shared("geom", "c_geom")).where("cut is not null").drop("geom", "c_geom")
    # a cut is no larger than its site, so the first join need not run to tell its levels
    most = max(levels(sites), default=LOWEST)
    three = box_pairs(two, n, "cut", "n_geom", known=list(range(LOWEST, most + 1))).withColumn("area_in_nn_catchment_ha", st.shared_area("cut", "n_geom") / 10_000.0)
    return three.where("area_in_nn_catchment_ha > 0").drop("cut", "n_geom")


def land_use_intersections(sites: DataFrame, coefficients: DataFrame, catchments: DataFrame, key: str) -> DataFrame:
    """Site x coefficient x catchment where all three share area, with area_in_nn_catchment_ha. Geometry columns: geom in each. Rows of
    equal shapes are measured once, and what comes out is as many rows as there are."""
    spark = sites.sparkSession
    own = [c for c in coefficients.columns if c != "geom"]
    theirs = [c for c in catchments.columns if c != "geom"]
    pieces = land_use_pieces(sites, coefficients, catchments)
    mine = classes(sites, [key], name="_sites").select(st.hash_key("geom").alias("_gk"), "_sites")
    coef = classes(coefficients, own, name="_coefs").select(st.hash_key("geom").alias("_ck"), "_coefs")
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = pieces.join(mine, "_gk").drop("_gk").repartition(tasks, "_ck").join(coef, "_ck").drop("_ck")
    both = both.select("_coefs", *theirs, "area_in_nn_catchment_ha", F.explode("_sites").alias("_site"))
    both = both.select(F.col(f"_site.{key}").alias(key), *theirs, "area_in_nn_catchment_ha", F.explode("_coefs").alias("_coef"))
    return both.select(key, *[F.col(f"_coef.{c}").alias(c) for c in own], *theirs, "area_in_nn_catchment_ha")


def union_by(df: DataFrame, keys: list[str], geom: str, name: str) -> DataFrame:
    """keys and the union of each group's geometries as `name`. Geometries are united by small cells first, then by larger ones, so
    that no task gets a whole large group as it came."""
    df = df.select(*keys, F.col(geom).alias(name)).where(F.col(name).isNotNull())
    for level in (2, 5):
        s = BASE * STEP**level
        b = st.bounds(name)
        df = df.withColumn("_b", b).groupBy(*keys, F.floor(F.col("_b")[0] / s).alias("_cx"), F.floor(F.col("_b")[1] / s).alias("_cy")).agg(st.union_agg(name).alias(name))
    return df.groupBy(*keys).agg(st.union_agg(name).alias(name))


def clip(layer: DataFrame, mask: DataFrame, geom: str = "geom") -> DataFrame:
    """layer's rows that meet the union of mask's geometries, cut to it; what gets empty goes. A row is cut by what it meets only,
    and rows of equal geometries are cut once."""
    rows = layer.withColumnRenamed(geom, "geom")
    masks = mask.where("geom is not null").select(F.col("geom").alias("m_geom")).dropDuplicates(["m_geom"]).withColumn("r_geom", F.col("m_geom"))
    shapes = written(_shapes(rows))
    found = met(blocks(shapes, masks, ["m_geom"])).select("_gk", "_row.m_geom")
    cut = shapes.join(union_by(found, ["_gk"], "m_geom", "_mask"), "_gk").select("_gk", st.shared("geom", "_mask").alias("_cut"))
    out = _with_shape(rows, cut, "inner").where("_cut is not null").drop("geom").withColumnRenamed("_cut", geom)
    return out.select(*layer.columns)


def overlay_intersection(left: DataFrame, right: DataFrame, grid: float | None = 1e-4, keep_all: bool = False, area: str | None = None) -> DataFrame:
    """Pairs with both sides' columns and the shared geometry in geom; right's geometry is r_geom before. With a grid, coordinates
    are snapped before and after. Without keep_all, shared points and lines go. With `area`, a
    column of that name has the area. Pairs of equal geometries are cut once."""

    def snap(g: Column | str) -> Column:
        return st.reduce_precision(g, grid) if grid else (F.col(g) if isinstance(g, str) else g)

    lcols, rcols = [c for c in left.columns if c != "geom"], [c for c in right.columns if c != "r_geom"]
    clash = set(lcols) & set(rcols)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    # blocks hold names of shapes only: lists of rows in them would be copied for every pair of a shape and a block
    shapes = _shapes(right.withColumnRenamed("r_geom", "geom")).select(F.col("_gk").alias("_ck"), snap("geom").alias("_shape")).withColumn("r_geom", F.col("_shape"))
    found = met(blocks(_shapes(left).withColumn("geom", snap("geom")), shapes, ["_ck", "_shape"])).select("_gk", "geom", "_row.*")
    found = found.withColumn("geom", snap(st.intersection("geom", "_shape"))).drop("_shape").withColumn("_area", st.area("geom"))
    found = found.where(~st.is_empty("geom") if keep_all else F.col("_area") > 0)
    found = _expanded(found.withColumnRenamed("_area", area) if area else found.drop("_area"), left, lcols, right, rcols)
    return found.select(*lcols, "geom", *rcols, *([area] if area else []))


def _expanded(pairs: DataFrame, lefts: DataFrame, lcols: list[str], rights: DataFrame, rcols: list[str]) -> DataFrame:
    """pairs of shapes (_gk, _ck and others) as pairs of the rows that have them. A pair of rows goes through no shuffle; a shape that
    very many others meet is dealt over DEALT tasks."""
    spark = pairs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mine = classes(lefts, lcols, name="_lefts").select(st.hash_key("geom").alias("_gk"), "_lefts")
    theirs = classes(rights, rcols, "r_geom", "_rights").select(st.hash_key("r_geom").alias("_ck"), "_rights")
    theirs = theirs.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    both = pairs.join(mine, "_gk").withColumn("_deal", F.pmod(F.xxhash64("_gk"), F.lit(DEALT)).cast("int")).drop("_gk")
    both = both.repartition(tasks, "_ck", "_deal").join(theirs, ["_ck", "_deal"]).drop("_ck", "_deal")
    rest = [c for c in both.columns if c not in ("_lefts", "_rights")]
    both = both.select("_rights", *rest, F.explode("_lefts").alias("_left"))
    both = both.select(*[F.col(f"_left.{c}").alias(c) for c in lcols], *rest, F.explode("_rights").alias("_right"))
    return both.select(*lcols, *rest, *[F.col(f"_right.{c}").alias(c) for c in rcols])


def overlay_difference(left: DataFrame, right: DataFrame, key: str, grid: float | None = 1e-4) -> DataFrame:
    """left without what right's geometries cover; what gets empty goes. right has r_geom."""
    cover = union_by(spatial_join(left.select(key, "geom"), right.select("r_geom")), [key], "r_geom", "_cover")
    out = left.join(cover, key, "left").withColumn("geom", st.difference("geom", "_cover")).drop("_cover")
    if grid:
        out = out.withColumn("geom", st.reduce_precision("geom", grid))
    return out.where(~st.is_empty("geom"))


def any_intersection(left: DataFrame, layer: DataFrame, attr: str, fid: str, key: str, name: str) -> DataFrame:
    """left with the sorted distinct attributes of all features it meets; an empty list where it meets none."""
    met = spatial_join(left.select(key, "geom"), _feature(layer, attr, fid)).groupBy(key).agg(F.array_sort(F.collect_set("_attr")).alias(name))
    return left.join(met, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))


def nearest(left: DataFrame, layer: DataFrame, attr: str, fid: str, key: str, name: str, most: float | None = None, start: float = 2_000.0) -> DataFrame:
    """left with the attribute of the nearest feature and its distance_m, null where none is within `most`.

    Rings are widened fourfold for rows that found nothing yet, up to the distance that holds both layers. A hit inside a ring is the
    nearest: what is outside is farther. The rows that are left after a ring are written, so that no ring is searched again.
    """
    todo, found, radius = written(_shapes(left)), None, start
    feature = _feature(layer, attr, fid).groupBy("r_geom").agg(F.min_by(F.struct("_fid", "_attr"), "_fid").alias("_f"))
    feature = written(feature.select("r_geom", "_f.*"))
    both = todo.select("geom").union(feature.select("r_geom")).select(st.bounds("geom").alias("b"))
    x0, y0, x1, y1 = both.agg(*[f(F.col("b")[i]) for i, f in enumerate((F.min, F.min, F.max, F.max))]).first()
    limit = 0.0 if x0 is None else ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 + 1.0
    limit = limit if most is None else min(limit, most)
    while True:
        radius = min(radius, limit)
        near = measured(blocks(todo, feature, ["_fid", "_attr"], within=radius), st.block_near("geom", "_block", radius, 1), "distance_m")
        near = near.select("_gk", "_row", "distance_m")
        hit = written(near.groupBy("_gk").agg(F.min_by(F.struct("_row._attr", "distance_m"), F.struct("distance_m", "_row._fid")).alias("_n")))
        found = hit if found is None else found.unionByName(hit)
        if radius >= limit:
            break
        todo = written(todo.join(hit.select("_gk"), "_gk", "left_anti"))
        if todo.isEmpty():
            break
        radius *= 4
    return _with_shape(left, found).withColumn(name, F.col("_n._attr")).withColumn("distance_m", F.col("_n.distance_m")).drop("_n")


def nearest_few(left: DataFrame, layer: DataFrame, fid: str, few: int, most: float) -> DataFrame:
    """left (geom) with fid, distance_m and rank of the `few` nearest of layer's rows (r_geom, fid) within `most`, ties by fid; rows of
    left without any go. Each block gives its own nearest, so no more pairs than that are ranked."""
    near = measured(blocks(_shapes(left), layer.select(fid, "r_geom"), [fid], within=most), st.block_near("geom", "_block", most, few), "distance_m")
    near = by_distance(near.select("_gk", F.col(f"_row.{fid}").alias(fid), "distance_m"), "_gk", fid, few)
    return _with_shape(left, near, "inner")


def by_distance(pairs: DataFrame, key: str, fid: str, most: int | None = None) -> DataFrame:
    """Pairs of within_distance() with their rank for each `key`, nearest first, ties by feature id; the first `most` only if given.
    Rows come in that order for each key."""
    order = Window.partitionBy(key).orderBy("distance_m", fid)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def semi(left: DataFrame, right: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """left's rows that meet any of right's r_geom (left_semi) or none (left_anti)."""
    one = right.where("r_geom is not null").dropDuplicates(["r_geom"]).select("r_geom", F.lit(0).alias("_n"))
    found = met(blocks(_shapes(left), one, ["_n"]), first=True).select("_gk").distinct()
    return _with_shape(left, found, how)
