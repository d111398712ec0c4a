"""Spatial joins as equi-joins on grid cells.

A row's level is the smallest whose cells are at least as wide as its bounding box, so that it covers four cells at most, however
large it is. Two rows meet at the larger of their levels, in one cell only: the one that holds the lower left corner of what their
boxes share. So pairs come once, without a distinct, and neither small parcels nor huge catchments multiply rows.

Cells shrink with the rows, down to two metres, so that many small features close together share few cells. A cell of a huge row may
still hold very many small ones. Rows that are lifted by `FAR` levels or more are dealt over shares of the cell, and the rows of that
size are repeated as often: the fewer they are against the small ones, the more shares, so that what is repeated stays a fraction of
what is dealt. Rows are counted by level for that, in the job that finds the levels in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.functions import geometry as st

#: Cells of a level are BASE * STEP**level wide.
BASE, STEP, LOWEST, HIGHEST = 500.0, 4.0, -4, 12
FAR = 3
#: Most shares of a cell; its shares where rows cannot be counted; how many times fewer the repeated rows are than the dealt ones.
MOST_SHARES, SHARES, FEWER = 1024, 16, 8
#: Stands for all shares of a cell.
EVERY = -2
#: Inputs of fewer bytes are dealt over all cores first.
SPREAD_BYTES = 32 << 20
#: Rows of a block and of a class; a geometry of more bytes is a block of its own; large rows that are repeated for shares at most.
BLOCK_ROWS_LOG2, CLASS_ROWS_LOG2, BLOCK_BYTES, REPEATED = 9, 10, 1 << 14, 1 << 20
#: Rows of a class on the left and on the right where all pairs come out: a task holds the rows that one class makes of one block.
LEFT_LOG2, RIGHT_LOG2 = 6, 4


def spread(df: DataFrame) -> DataFrame:
    """A small df dealt over all cores: geometries cost far more than their bytes tell, so Spark would give them to one task. Larger
    ones, and those whose size Spark cannot tell, have parts enough and stay."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SPREAD_BYTES else df


def with_box(df: DataFrame, geom: str, name: str, grow: float = 0.0) -> DataFrame:
    """df with the bounding box of geom as a struct column; rows with a null or empty geometry go."""
    b = st.bounds(geom)
    df = df.withColumn(name, b).where(F.col(name).isNotNull())
    return df.withColumn(name, F.struct((F.col(name)[0] - grow).alias("x0"), (F.col(name)[1] - grow).alias("y0"), (F.col(name)[2] + grow).alias("x1"), (F.col(name)[3] + grow).alias("y1")))


def _level(box: str) -> Column:
    side = F.greatest(F.col(f"{box}.x1") - F.col(f"{box}.x0"), F.col(f"{box}.y1") - F.col(f"{box}.y0"))
    return F.least(F.greatest(F.ceil(F.log(STEP, F.greatest(side, F.lit(1e-9)) / BASE)), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")


def _size(level: Column) -> Column:
    return F.lit(BASE) * F.pow(F.lit(STEP), level)


def _levels(a: DataFrame, b: DataFrame | None) -> tuple[dict[int, int], dict[int, int]]:
    """The levels in use on either side with their numbers of rows, at most HIGHEST - LOWEST + 1 each."""
    both = a.select(F.lit(0).alias("side"), _level("_box").alias("level"))
    both = both if b is None else both.union(b.select(F.lit(1), _level("_box")))
    found: tuple[dict[int, int], dict[int, int]] = {}, {}
    for r in both.groupBy("side", "level").count().collect():
        found[r["side"]][r["level"]] = r["count"]
    return found


def _shares(large: dict[int, int | None], small: dict[int, int | None], blocks: bool = False, far: int = FAR) -> dict[int, int]:
    """Into how many shares cells of each of large's levels are dealt for rows of small that are `far` levels smaller or more: a power of
    two, 1 where there are none. Unknown numbers of rows are None. In blocks large rows are cheap to repeat, so there are SHARES at least
    where they are few enough."""
    out = {}
    for level, n in large.items():
        below = [count for at, count in small.items() if level - at >= far]
        if not below:
            out[level] = 1
        elif n is None or None in below:
            out[level] = SHARES
        else:
            out[level] = min(1 << max(sum(below) // (FEWER * n), 1).bit_length() - 1, MOST_SHARES)
            if blocks and n * SHARES <= REPEATED * 4:
                out[level] = max(out[level], SHARES)
    return out


def _by_level(level: Column, values: dict[int, int]) -> Column:
    return F.coalesce(*[F.when(level == at, v) for at, v in values.items()], F.lit(1))


def _celled(df: DataFrame, own: str, other: str, mine: dict[int, int | None], met: dict[int, int | None], blocks: bool = False, later: bool = False, far: int = FAR) -> DataFrame:
    """df once for each cell it covers at its own level, and at each larger level in met; mine and met are the levels in use on this
    side and on the other. Column _part tells who meets there: both sides at their own level, or one side's rows (`own` or `other`) at
    theirs with smaller ones of the other side. later: a row that goes to all shares of a cell comes once, with EVERY as its _salt."""
    df = df.withColumn("_own", _level("_box"))
    level, none = F.col("_own"), F.array().cast("array<struct<_level:int,_part:string,_salt:int>>")

    def key(at: Column, part: str, salt: Column) -> Column:
        return F.struct(at.cast("int").alias("_level"), F.lit(part).alias("_part"), salt.cast("int").alias("_salt"))

    def alone(at: Column, part: str, salt: Column) -> Column:
        return F.array(key(at, part, salt))

    keys = [alone(level, "=", F.lit(-1))]
    if met:
        # a row is met by smaller ones in its cell as it is, and by much smaller ones in each share of it
        keys.append(F.when(level > min(met), alone(level, own, F.lit(-1))).otherwise(none))
        shares = {at: n for at, n in _shares(mine, met, blocks, far).items() if n > 1}
        if shares:
            n = _by_level(level, shares)
            every = alone(level, own, F.lit(EVERY)) if later else F.transform(F.sequence(F.lit(0), n - 1), lambda i: key(level, own, i))
            keys.append(F.when(n > 1, every).otherwise(none))
        for at, n in _shares(met, mine, blocks, far).items():
            salt = F.lit(-1) if n == 1 else F.when(at - level >= far, F.pmod(F.xxhash64("_box"), F.lit(n))).otherwise(-1)
            keys.append(F.when(level < at, alone(F.lit(at), other, salt)).otherwise(none))
    df = df.withColumn("_key", F.explode(F.concat(*keys))).drop("_own")
    df = df.withColumns({c: F.col(f"_key.{c}") for c in ("_level", "_part", "_salt")}).drop("_key")
    s = _size(F.col("_level"))
    for axis in ("x", "y"):
        df = df.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(f"_box.{axis}0") / s), F.floor(F.col(f"_box.{axis}1") / s))))
    return df


def levels(df: DataFrame, geom: str = "geom") -> list[int]:
    """The levels in use in df."""
    return sorted(_levels(with_box(df.select(geom), geom, "_box"), None)[0])


def box_pairs(left: DataFrame, right: DataFrame, lgeom: str = "geom", rgeom: str = "r_geom", within: float = 0.0, known: list[int] | None = None) -> DataFrame:
    """Pairs of rows whose bounding boxes, the left one grown by `within`, share a point. Column names must differ between the sides.
    `known` are levels that hold all of left's, where left is costly to look at: it is not computed for them then."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    a, b = with_box(spread(left), lgeom, "_box", within), with_box(right, rgeom, "_box")
    on_left, on_right = _levels(a, b) if known is None else (dict.fromkeys(known), _levels(b, None)[0])
    a, b = _celled(a, "l", "r", on_left, on_right).withColumnRenamed("_box", "_lbox"), _celled(b, "r", "l", on_right, on_left).withColumnRenamed("_box", "_rbox")
    pairs = a.join(b, ["_level", "_part", "_salt", "_cx", "_cy"])
    s = _size(F.col("_level"))
    for axis in ("x", "y"):
        low = F.greatest(f"_lbox.{axis}0", f"_rbox.{axis}0")
        pairs = pairs.where((low <= F.least(f"_lbox.{axis}1", f"_rbox.{axis}1")) & (F.floor(low / s) == F.col(f"_c{axis}")))
    return pairs.drop("_level", "_part", "_salt", "_cx", "_cy", "_lbox", "_rbox")


def blocks(left: DataFrame, right: DataFrame, keep: list[str], lgeom: str = "geom", rgeom: str = "r_geom", within: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Rows of left beside blocks of right's rows whose boxes may come within `within`, for the block functions of geometry: left's
    columns, `by` (rows that differ in it are in different blocks), _block, _rows (structs of keep, in its order) and the cell.

    The work of a pair is a comparison of boxes in one place of memory: no row is made of a pair before it is known to count."""
    by, key = by or [], ["_level", "_part", "_salt", "_cx", "_cy"]
    a, b = with_box(spread(left), lgeom, "_box", within), with_box(right, rgeom, "_box")
    on_left, on_right = _levels(a, b)
    # rows grown by a distance are as large as those they meet, and yet very many may stand in a cell
    far = 1 if within else FAR
    a, b = _celled(a, "l", "r", on_left, on_right, True, far=far), _celled(b, "r", "l", on_right, on_left, True, later=True, far=far)
    s = _size(F.col("_level"))
    # a row is no wider than its cell, so its middle is half a cell outside at most
    middle = [(F.col(f"_box.{axis}0") + F.col(f"_box.{axis}1")) / 2 / s - F.col(f"_c{axis}") for axis in ("x", "y")]
    b = b.select(*key, *by, st.hilbert(*middle, (-0.5, -0.5, 1.5, 1.5)).alias("_place"), F.struct(*keep).alias("_row"), F.col(rgeom).alias("_g"), F.col("_box").alias("_b"))
    # a cell's rows lie side by side in a few parts, neighbours together, and are cut into blocks there
    b = b.repartition(*key, F.pmod(F.xxhash64("_g"), F.lit(4))).sortWithinPartitions(*key, *by, "_place", "_row", "_g").withColumn("_at", F.monotonically_increasing_id())
    b = b.withColumn("_at", F.when(F.length("_g") > BLOCK_BYTES, -F.col("_at") - 1).otherwise(F.shiftright("_at", BLOCK_ROWS_LOG2)))
    extent = [f(f"_b.{c}").alias(f"_b{c}") for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    b = b.groupBy(*key, *by, "_at").agg(F.array_sort(F.collect_list(F.struct("_row", "_g"))).alias("_l"), *extent)
    sides = ["_bx0", "_by0", "_bx1", "_by1"]
    b = b.select(*key, *by, *sides, st.packed(F.transform("_l", lambda x: x["_g"])).alias("_block"), F.transform("_l", lambda x: x["_row"]).alias("_rows"))
    # blocks are made once and then repeated for the shares
    shares = _by_level(F.col("_level"), _shares(on_right, on_left, True, far))
    salts = F.when(F.col("_salt") == EVERY, F.sequence(F.lit(0), shares - 1)).otherwise(F.array("_salt"))
    b = b.withColumn("_salt", F.explode(salts))
    # a few bytes stand for much work, so the number of tasks is told
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Spark takes blocks for a few bytes each and would send them to the driver
    both = a.repartition(tasks, *key).join(b.hint("merge"), key)
    # most blocks of a large cell are not near a small row: they go before their bytes are copied
    for axis in ("x", "y"):
        both = both.where((F.col(f"_box.{axis}0") <= F.col(f"_b{axis}1")) & (F.col(f"_box.{axis}1") >= F.col(f"_b{axis}0")))
    return both.withColumn("_s", s).drop("_level", "_part", "_salt", "_box", *sides)


def measured(df: DataFrame, hits: Column, name: str) -> DataFrame:
    """df of blocks() with _row and `name` for each place and number that block_most() or block_near() gives."""
    df = df.withColumn("_found", hits)
    n = (F.size("_found") / 2).cast("int")
    df = df.select("*", F.posexplode(F.slice("_found", F.lit(1), n)).alias("_p", "_i"))
    return df.withColumns({"_row": F.get("_rows", F.col("_i").cast("int")), name: F.get("_found", F.col("_p") + n)}).drop("_block", "_rows", "_found", "_p", "_i", "_cx", "_cy", "_s")


def met(df: DataFrame, first: bool = False, geom: str = "geom") -> DataFrame:
    """df of blocks() with _row for each row of right (or one at most of each block) that shares a point."""
    df = df.select("*", F.explode(st.block_hits(geom, "_block", first)).alias("_i"))
    return df.withColumn("_row", F.get("_rows", F.col("_i"))).drop("_block", "_rows", "_i", "_cx", "_cy", "_s")


def classes(df: DataFrame, columns: list[str], geom: str = "geom", name: str = "_all", rows_log2: int = CLASS_ROWS_LOG2) -> DataFrame:
    """One row for each distinct geometry of df: geom and `name`, structs of the columns of its rows. Where very many rows are equal
    there are several, of so many rows at most that a row stays small. Null geometries go."""
    rows = spread(df.where(F.col(geom).isNotNull()).select(F.col(geom), F.struct(*columns).alias("_c"))).withColumn("_gk", st.hash_key(geom))
    rows = rows.repartition("_gk").sortWithinPartitions("_gk").withColumn("_at", F.shiftright(F.monotonically_increasing_id(), rows_log2))
    return rows.groupBy("_gk", "_at").agg(F.first(geom).alias(geom), F.collect_list("_c").alias(name)).drop("_gk", "_at")


def clustered(df: DataFrame, geom: str = "geom", files: int | None = None) -> DataFrame:
    """df with columns x0, y0, x1, y1 (the bounding box), level (from 0) and place, in order of place: the middle of the box on Hilbert's curve
    through the whole layer. Written as it is, files and their row groups hold neighbours, and a filter on the box columns (see
    tiles.near_box) reads few of them. Rows without a box come last, with nulls. One pass finds the layer's extent."""
    b = st.bounds(geom)
    boxed = df.withColumn("_b", b).withColumns({c: F.col("_b")[i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}).drop("_b")
    extent = boxed.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if extent[0] is None:
        return boxed.withColumns({"level": F.lit(None).cast("int"), "place": F.lit(None).cast("int")})
    boxed = boxed.withColumn("_box", F.struct("x0", "y0", "x1", "y1")).withColumn("level", F.when(F.col("x0").isNotNull(), F.greatest(_level("_box"), F.lit(0)))).drop("_box")
    boxed = boxed.withColumn("place", st.hilbert((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, tuple(extent)))
    order = F.col("place").asc_nulls_last()
    parted = boxed.repartitionByRange(files, order) if files else boxed.repartitionByRange(order)
    return parted.sortWithinPartitions(order)


def spatial_join(left: DataFrame, right: DataFrame, lgeom: str = "geom", rgeom: str = "r_geom") -> DataFrame:
    """Pairs of rows whose geometries share a point (boundaries count)."""
    return box_pairs(left, right, lgeom, rgeom).where(st.intersects(lgeom, rgeom))


def ids_within(left: DataFrame, right: DataFrame, most: float, lkeep: list[str], rkeep: list[str], from_centre: bool = False) -> DataFrame:
    """Pairs as of within_distance(), without geometries: lkeep, rkeep and distance_m, rounded to a micrometre. Rows of equal geometries,
    on either side, are measured once. As many rows as pairs come out, but none of them goes through a shuffle, and what the rows of two
    geometries share is not made for each of them."""
    rows = classes(left, lkeep, rows_log2=LEFT_LOG2).withColumn("geom", st.centroid("geom") if from_centre else F.col("geom"))
    shapes = classes(right, rkeep, "r_geom", "_others", RIGHT_LOG2)
    found = measured(blocks(rows, shapes, ["_others"], within=most), st.block_near("geom", "_block", most), "distance_m")
    # halves of metres stay what they are, and rounding is slow
    d = F.col("distance_m")
    d = F.when(d * 2 == F.floor(d * 2), d).otherwise(F.round(d, 6))
    # Spark puts a column's making off to where it is used, which is each row; what an inline() gives is made there
    found = found.select("_all", F.inline(F.array(F.struct(d.alias("distance_m"), F.col("_row._others").alias("_others")))))
    found = found.select("_all", "distance_m", F.inline("_others"))
    return found.select(*rkeep, "distance_m", F.inline("_all")).select(*lkeep, *rkeep, "distance_m")


def within_distance(left: DataFrame, right: DataFrame, most: float, lgeom: str = "geom", rgeom: str = "r_geom", from_centre: bool = False) -> DataFrame:
    """Pairs at most `most` apart, with their distance_m. from_centre: the left geometry counts as its centroid alone, as when a site is
    a place to look from; it is kept as it is."""
    if from_centre:
        found = within_distance(left.withColumn("_centre", st.centroid(lgeom)), right, most, "_centre", rgeom)
        return found.drop("_centre")
    return box_pairs(left, right, lgeom, rgeom, most).withColumn("distance_m", st.distance(lgeom, rgeom)).where(F.col("distance_m") <= most)
