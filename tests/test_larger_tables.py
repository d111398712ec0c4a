"""What only showed on larger tables: equal rows, sites by the grid's origin, references that come again with other contents."""

import json
import random
import re

from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.operators import grid, overlay, tiles, validation
from fenmark.plans import incremental
from fenmark.streaming import jobs
from tests.test_spatial import box, layer, sp  # noqa: F401
from tests.test_streaming import message


def test_site_by_the_origin_is_not_in_degrees(sp):  # noqa: F811
    rows = layer(sp, [(1, box(0, 0, 50, 50)), (2, box(0.5, 50, 0.6, 51)), (3, box(-9, 49, 2, 61))])
    got = {r.id: r.e for r in rows.select("id", validation.geometry_errors().alias("e")).collect()}
    assert got == {1: [], 2: ["degrees"], 3: ["degrees"]}


def test_job_by_the_origin_completes(sp, tmp_path):  # noqa: F811
    ring = [[[0, 0], [50, 0], [50, 50], [0, 50], [0, 0]]]
    lines = sp.createDataFrame([(message("NRF-000001", boundary={"coordinates": ring}),)], "value string")
    assert jobs.parse_sites(lines).first().error is None


def test_equal_sites_count_each(sp, tmp_path):  # noqa: F811
    store = incremental.ResultStore(sp, f"file://{tmp_path}/store")
    rows = layer(sp, [(i, box(0, 0, 10 + i % 2, 10)) for i in range(6)])
    seen = []

    def assess(todo):
        seen.append(todo.count())
        return todo.select("key", st.area("geom").alias("a"))

    found, n = store.assess(rows, [], assess, {}, "g")
    assert n == 6 and found.count() == 6 and seen == [2]
    assert store.assess(rows, [], assess, {}, "g")[1] == 0


def test_revisions_of_a_reference_all_come(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [message("NRF-000001", housingUnits=n) for n in (3, 9, 4, 9)]
    assert json.loads(lines[1])["housingUnits"] == 9
    (src / "a.txt").write_text("\n".join(lines))
    jobs.run(spark, str(src), str(tmp_path / "cp"), lambda df: df.select("reference", "housingUnits"), str(tmp_path / "out"), str(tmp_path / "bad"), revision="housingUnits")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.housingUnits for r in got.collect()) == [3, 4, 9]
    assert got.agg(F.max("housingUnits")).first()[0] == 9


def _shapes(n, seed, size):
    """Rectangles, triangles and points, every third one there twice."""
    r, out = random.Random(seed), []
    for _ in range(n):
        x, y, w = r.randrange(20_000), r.randrange(20_000), r.randrange(1, size)
        g = r.choice([box(x, y, x + w, y + w), f"POLYGON (({x} {y}, {x + w} {y}, {x} {y + w}, {x} {y}))", f"POINT ({x} {y})"])
        out += [g] * (2 if len(out) % 3 == 0 else 1)
    return list(enumerate(out))


def _sides(sp):
    left, right = layer(sp, _shapes(60, 1, 400)), layer(sp, _shapes(1500, 2, 6000))
    return left.select("id", "geom"), right.select(F.col("id").alias("other"), F.col("geom").alias("r_geom"))


def test_blocks_give_what_pairs_give(sp):  # noqa: F811
    left, right = _sides(sp)
    all_pairs = left.crossJoin(right).select("id", "other", st.shared_area("geom", "r_geom").alias("a"), F.round(st.distance("geom", "r_geom"), 6).alias("d")).collect()
    near = grid.ids_within(left, right, 500.0, ["id"], ["other"])
    assert sorted(map(tuple, near.collect())) == sorted((p.id, p.other, p.d) for p in all_pairs if p.d <= 500)
    few = overlay.nearest_few(left, right, "other", 3, 500.0).select("id", "other", "rank").collect()
    want = {}
    for p in sorted(all_pairs, key=lambda p: (p.d, p.other)):
        if p.d <= 500 and len(want.setdefault(p.id, [])) < 3:
            want[p.id].append(p.other)
    assert sorted(map(tuple, few)) == sorted((i, o, n + 1) for i, found in want.items() for n, o in enumerate(found))
    met = {p.id for p in all_pairs if p.a is not None}
    assert {r.id for r in overlay.semi(left, right, "id").collect()} == met
    assert {r.id for r in overlay.semi(left, right, "id", "left_anti").collect()} == {p.id for p in all_pairs} - met
    features = right.select(F.col("other").alias("id"), F.col("other").cast("string").alias("code"), F.col("r_geom").alias("geom"))
    got = {r.id: r.v for r in overlay.majority_overlap(left, {"v": (features, "code", "id", "none")}, "id").collect()}
    best = {}
    for p in all_pairs:
        if p.a is not None:
            best[p.id] = min(best.get(p.id, (1.0, 0)), (-round(p.a, 6), p.other))
    assert got == {p.id: str(best[p.id][1]) if p.id in best else "none" for p in all_pairs}


def test_equal_rows_are_measured_once_and_all_come(sp):  # noqa: F811
    left = layer(sp, [(i, box(0, 0, 100, 100)) for i in range(3000)]).select("id", "geom")
    right = layer(sp, [(i, box(50, 50, 200, 200)) for i in range(5)]).select(F.col("id").alias("other"), F.col("geom").alias("r_geom"))
    assert grid.classes(left, ["id"]).count() < 10
    got = overlay.overlay_intersection(left, right, area="area")
    assert got.count() == 15_000 and got.where("area = 2500").select("id", "other").distinct().count() == 15_000
    cut = overlay.clip(left, right.select(F.col("r_geom").alias("geom")))
    assert cut.count() == 3000 and cut.select(st.area("geom").alias("a")).distinct().collect()[0].a == 2500
    coef = right.select("other", F.col("r_geom").alias("geom"))
    found = overlay.land_use_intersections(left, coef, right.where("other = 0").select(F.lit("c").alias("oid"), F.col("r_geom").alias("geom")), "id")
    assert found.columns == ["id", "other", "oid", "area_in_nn_catchment_ha"] and found.distinct().count() == 15_000


def test_blocks_hold_no_lists_of_rows(sp, monkeypatch):  # noqa: F811
    left, right = _sides(sp)
    seen, blocks = [], overlay.blocks

    def watched(a, b, keep, *more, **named):
        seen.extend(b.schema[c].dataType.typeName() for c in keep)
        return blocks(a, b, keep, *more, **named)

    monkeypatch.setattr(overlay, "blocks", watched)
    got = overlay.overlay_intersection(left, right, area="area")
    assert seen and "array" not in seen
    want = left.crossJoin(right).select("id", "other", F.round(st.shared_area("geom", "r_geom"), 3).alias("a")).where("a > 0.001")
    got = got.select("id", "other", F.round("area", 3).alias("a")).where("a > 0.001")
    assert sorted((r.id, r.other, round(r.a, 1)) for r in got.collect()) == sorted((r.id, r.other, round(r.a, 1)) for r in want.collect())


def test_blocks_are_not_broadcast_and_far_ones_meet_nothing(sp, monkeypatch):  # noqa: F811
    """Small sites among many large features of one cell: blocks hold neighbours, and only near ones reach a comparison."""
    monkeypatch.setattr(grid, "BLOCK_ROWS_LOG2", 4)
    left = layer(sp, [(i, box(i * 700, i * 650, i * 700 + 20, i * 650 + 20)) for i in range(40)]).select("id", "geom")
    right = layer(sp, [(i, box(i % 40 * 780, i // 40 * 780, i % 40 * 780 + 9000, i // 40 * 780 + 9000)) for i in range(1600)]).select(F.col("id").alias("other"), F.col("geom").alias("r_geom"))
    both = grid.blocks(left, right, ["other"])
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    met = {(r.id, r.other) for r in grid.met(both).select("id", "_row.other").collect()}
    want = {(r.id, r.other) for r in left.crossJoin(right).where(st.intersects("geom", "r_geom")).select("id", "other").collect()}
    assert met == want and len(want) > 1000
    # each of the 40 sites would meet all blocks of its cell, 100 of 16 rows at least
    assert both.count() < 40 * 100 * 0.6


def test_equal_rows_of_either_side_are_measured_once_within_a_distance(sp, monkeypatch):  # noqa: F811
    monkeypatch.setattr(grid, "LEFT_LOG2", 3, raising=False)
    monkeypatch.setattr(grid, "RIGHT_LOG2", 2, raising=False)
    left = layer(sp, [(i, box(i % 6 * 900, 0, i % 6 * 900 + 101, 77)) for i in range(120)]).select("id", "geom")
    right = layer(sp, [(i, box(i % 9 * 1300, 333, i % 9 * 1300 + 12_000, 9000)) for i in range(63)]).select(F.col("id").alias("other"), F.col("id").cast("string").alias("name"), F.col("geom").alias("r_geom"))
    seen, blocks = [], grid.blocks

    def watched(a, b, *more, **named):
        seen.append((a.count(), b.count()))
        return blocks(a, b, *more, **named)

    monkeypatch.setattr(grid, "blocks", watched)
    for centre in (False, True):
        got = sorted(map(tuple, grid.ids_within(left, right, 3000.0, ["id"], ["other", "name"], from_centre=centre).select("id", "other", "name", "distance_m").collect()))
        gap = F.round(st.distance(st.centroid("geom") if centre else "geom", "r_geom"), 6).alias("d")
        want = left.crossJoin(right).select("id", "other", "name", gap).where("d <= 3000").collect()
        assert got == sorted(map(tuple, want)) and len({d for *_, d in got}) > 5
    # not 63 rows on the right, but 9 shapes of 7 rows in parts of 4 at most
    assert all(a < 40 and b < 30 for a, b in seen)


def test_a_cell_with_very_many_sites_and_works_is_dealt_over_shares(sp):  # noqa: F811
    """Sites with their search distance are nearly as large as works, and few cells hold all: each was one task."""
    left = layer(sp, [(i, box(i * 50, i * 50, i * 50 + 20, i * 50 + 20)) for i in range(400)]).select("id", "geom")
    right = layer(sp, [(i, box(i * 200, i * 200, i * 200 + 12_000, i * 200 + 12_000)) for i in range(80)]).select(F.col("id").alias("other"), F.col("geom").alias("r_geom"))
    both = grid.blocks(left, right, ["other"], within=3000.0)
    assert both.select("_s", "_cx", "_cy").distinct().count() < 8
    assert both.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    assert both.rdd.getNumPartitions() >= 16


def test_a_batch_without_messages_is_not_assessed(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.txt").write_text(message("NRF-000001"))

    def assess(df):
        seen.append(df.count())
        return df.select("reference")

    jobs.run(spark, str(src), str(tmp_path / "cp"), assess, str(tmp_path / "out"), str(tmp_path / "bad"))
    assert seen == [1] and spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_no_python_worker_makes_a_whole_tile(sp, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tiles, "PART_FEATURES", 16)
    rows = layer(sp, [(i, box(1000 + i % 20 * 100, 1000 + i // 20 * 100, 1090 + i % 20 * 100, 1090 + i // 20 * 100)) for i in range(400)]).select("id", "geom")
    rows = rows.withColumns({"kind": F.when(F.col("id") % 3 > 0, "same"), "below": -F.col("id")}).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    made = tiles.pyramid(rows, "plans", (10, 11), ["id", "kind", "below"], srid=3857)
    assert not re.search(r"MapInArrow [^\n]*\btile#", made._jdf.queryExecution().optimizedPlan().toString())
    want = sorted((str(r.id) if r.id else "", r.kind or "", str(r.below)) for r in rows.collect())
    for z in (10, 11):
        got = [{p.key: p.value for p in r.properties} for r in tiles.decoded(made.where(F.col("z") == z)).collect()]
        assert sorted((g.get("id", ""), g.get("kind", ""), g["below"]) for g in got) == want and len(got) == 400
    bare = tiles.pyramid(rows.select(F.lit(None).cast("int").alias("id"), "geom"), "plans", (10, 10), ["id"], srid=3857)
    assert bare.agg(F.sum("features")).first()[0] == 400 and all(not r.properties for r in tiles.decoded(bare).collect())
