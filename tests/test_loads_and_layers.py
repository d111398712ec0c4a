import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.operators import grid, quality_gate, tiles, validation
from fenmark.plans import incremental, nutrient
from fenmark.session import shared_folder, tables_go, written
from fenmark.sources.catalog import Busy, Catalog, Manifest, Stale
from fenmark.streaming import jobs
from tests.test_spatial import box, layer, one, sp  # noqa: F401


def message(ref, units=3, coordinates=((0, 0), (100, 0), (100, 100), (0, 100), (0, 0)), crs=None):
    boundary = {"type": "Polygon", "coordinates": [coordinates]} | ({"crs": {"properties": {"name": crs}}} if crs else {})
    return json.dumps({"reference": f"NRF-{ref:06d}", "boundaryGeojson": {"boundaryGeometryOriginal": json.dumps(boundary)}, "housingUnits": units})


def test_geojson_of_all_kinds_and_damage(sp):  # noqa: F811
    good = {
        '{"type":"Point","coordinates":[1,2,9]}': "POINT (1 2)",
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1.5]]}}': "LINESTRING (0 0, 1 1.5)",
        '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[1,0.5],[2,0.5],[2,1],[1,0.5]]]}': "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))",
        '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}': "MULTIPOINT ((1 2), (3 4))",
        '{"type":"MultiLineString","coordinates":[[[0,0],[1,1]]]}': "MULTILINESTRING ((0 0, 1 1))",
        '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}': "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}': "GEOMETRYCOLLECTION (POINT (1 2))",
        '{"type":"Polygon","coordinates":[]}': "POLYGON EMPTY",
    }
    bad = ["", "nonsense", "[]", "{}", "null", '{"type":"Polygon","coordinates":[[[0,0],[1,1],[2,2]]]}', '{"type":"Point","coordinates":["a",1]}', '{"type":"Point","coordinates":[1e999,1]}', '{"type":"Circle","coordinates":[1,2]}', '{"type":"Point"}', '{"type":"MultiPolygon","coordinates":[1]}', '{"type":"Feature","geometry":null}', None]
    rows = sp.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", st.as_text(st.from_geojson("t")).alias("wkt")).collect()
    assert {r.t: r.wkt for r in rows} == good | dict.fromkeys(bad)
    assert one(sp, st.try_from_text(F.lit("POLYGON ((0 0"))).asDict().popitem()[1] is None
    damaged = sp.createDataFrame([(bytearray(b"\x01\x03\x00"),), (None,)], "geom binary").select(validation.geometry_errors().alias("e")).collect()
    assert [r.e for r in damaged] == [["damaged_geometry"], ["null_geometry"]]


def test_repair_by_linework(sp):  # noqa: F811
    fixed = lambda wkt: one(sp, st.area(st.make_valid(st.from_text(F.lit(wkt)), linework=True)).alias("a")).a
    assert fixed("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))") == 2.0  # a bow-tie
    assert fixed("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((2 2, 6 2, 6 6, 2 6, 2 2)))") == 24.0  # what both cover is a hole
    assert fixed("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 12 2, 12 4, 2 4, 2 2))") == 81 - 14 + 6
    assert fixed("POLYGON ((0 0, 5 0, 0 0, 0 0))") == 0.0 and fixed("POLYGON ((0 0, 1 0, 1 1, 0 0))") == 0.5


def test_a_corrected_message_counts(sp, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    paths = {k: f"file://{tmp_path}/{k}" for k in ("in", "c", "out", "bad")}
    go = lambda: jobs.run(sp, paths["in"], paths["c"], lambda df: df.select("reference", "housingUnits", st.area("geom").alias("area")), paths["out"], paths["bad"], read=jobs.parse_sites)
    torn = message(3).replace("Polygon", "Poly")
    (tmp_path / "in" / "a.json").write_text("\n".join([message(1, 0), message(2), torn, message(4, crs="urn:ogc:def:crs:EPSG::4326", coordinates=((-2, 52), (-1.99, 52), (-1.99, 52.01), (-2, 52))), message(5, coordinates=((0, 0), (900, 900), (900, 0), (0, 900), (0, 0)))]))
    go()
    (tmp_path / "in" / "b.json").write_text("\n".join([message(1, 5), message(2, 7), message(3), message(3)]))
    go()
    done = {r.reference: (r.housingUnits, round(r.area)) for r in sp.read.parquet(paths["out"]).collect()}
    assert set(done) == {"NRF-000001", "NRF-000002", "NRF-000003", "NRF-000004"} and done["NRF-000001"] == (5, 10_000) and done["NRF-000002"][0] == 3
    assert 350_000 < done["NRF-000004"][1] < 420_000  # half of 687 m by 1,113 m, moved from degrees
    assert sorted(r.error for r in sp.read.parquet(paths["bad"]).collect()) == ["bad_housing_units", "damaged_boundary", "invalid_geometry"]


def test_one_job_in_a_hundred_fails(sp, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    paths = {k: f"file://{tmp_path}/{k}" for k in ("in", "c", "out", "bad", "failed")}
    (tmp_path / "in" / "a.json").write_text("\n".join(message(i) for i in range(100)))
    calls = []

    def assess(df):
        calls.append(1)
        poison = F.when(F.col("reference") == "NRF-000042", F.raise_error(F.lit("no plan for this one")).cast("int")).otherwise(1)
        return df.select("reference", poison.alias("ok"))

    jobs.run(sp, paths["in"], paths["c"], assess, paths["out"], paths["bad"], failed=paths["failed"], attempts=3)
    assert sorted(r.reference for r in sp.read.parquet(paths["out"]).collect()) == [f"NRF-{i:06d}" for i in range(100) if i != 42]
    (dead,) = sp.read.parquet(paths["failed"]).collect()
    assert dead.reference == "NRF-000042" and dead.attempts == 3 and "no plan for this one" in dead.error and json.loads(dead.value)["housingUnits"] == 3
    assert len(calls) < 40
    # a fault that is no job's is raised, and nothing is set apart
    rows = jobs.parse(sp.createDataFrame([(message(i),) for i in range(4)], "value string"))
    with pytest.raises(Exception, match="away"):
        jobs.settle(rows, lambda df: df.select(F.raise_error(F.lit("away")).alias("x")).unionByName(sp.sql("select raise_error('away') as x")), paths["out"] + "2", paths["failed"] + "2")


def test_tables_go_after_a_block(sp):  # noqa: F811
    with tables_go(sp):
        path = shared_folder(sp, "x")
        sp.range(3).write.parquet(path)
        assert written(sp.range(2)).count() == 2 and sp.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sp.read.parquet(path)


def test_sites_are_moved_to_the_grid(sp):  # noqa: F811
    rows = layer(sp, [(1, "POLYGON ((-2 52, -1.99 52, -1.99 52.01, -2 52))", 4326), (2, box(400000, 200000, 400100, 200100), None)], "id long, wkt string, srid int")
    rows = rows.select("id", F.lit("n").alias("name"), F.lit("c").alias("dwelling_category"), F.lit("s").alias("source"), F.lit(1).alias("dwellings"), "geom", "srid")
    got = {r.id: (r.shape_area, r.x) for r in nutrient.prepare(rows).select("id", "shape_area", st.bounds("geom")[0].alias("x")).collect()}
    assert 350_000 < got[1][0] < 420_000 and abs(got[1][1] - 400_000) < 200 and got[2] == (10_000.0, 400_000.0)


def test_a_stale_load_cannot_move_the_pointer(sp, tmp_path):  # noqa: F811
    cat, rows = Catalog(sp, f"file://{tmp_path}/cat"), sp.range(4)
    cat.promote({"a": rows})
    slow = Catalog(sp, cat.root)
    calls = []

    def check(name, new, old):
        # while this load checks its rows, its lock is taken for lost and another load goes through
        if not calls:
            calls.append(1)
            with cat.single_flight(stale_after_s=-1) as token:
                cat._promote(token, {"a": rows.limit(2)}, None, {}, {}, "v2", None)
        return []

    with pytest.raises(Stale):
        slow.promote({"a": rows.limit(1)}, check)
    assert cat.read("a").count() == 2 and cat.history().where("status = 'failed'").count() == 1
    with pytest.raises(Stale):
        cat._point({"a": 1}, 0, None, "")
    with cat.single_flight():
        for blocked in (lambda: cat.rollback(["a"]), lambda: cat.note_etag("a", "x"), lambda: cat.promote({"a": rows})):
            with pytest.raises(Busy):
                blocked()
    cat.note_etag("a", "x")
    assert not cat.needs_reload("a", "x")


def test_rows_that_were_not_checked_are_not_served(sp, tmp_path):  # noqa: F811
    cat = Catalog(sp, f"file://{tmp_path}/cat")

    def broken(*_):
        assert cat.versions("a") == []
        raise RuntimeError("the check broke")

    with pytest.raises(RuntimeError):
        cat.promote({"a": sp.range(3)}, broken)
    assert cat.pointer() == {} and cat.versions("a") == [] and [(r.status, r.detail) for r in cat.history().collect()] == [("failed", "the check broke")]
    # a load that was lost on the way: its rows stay hidden, and the next load clears them away
    sp.range(9).write.parquet(f"{cat.root}/a/version=1")
    (tmp_path / "cat" / "a" / ".loading-1").write_text("")
    assert cat.versions("a") == [] and cat.status(["a"]).first().n is None
    cat.promote({"a": sp.range(3)}, data_version="v1")
    assert cat.read("a").count() == 3 and cat.versions("a") == [2]


def test_rules_between_new_versions_and_provenance(sp, tmp_path):  # noqa: F811
    cat = Catalog(sp, f"file://{tmp_path}/cat")
    rules = quality_gate.load_rules('{"tables": {"b": {"key": "id", "row_floor_percent": 0, "references": {"id": {"table": "a", "allow_null": false}}}}}', by_name=True)
    gate = quality_gate.gate(rules)
    cat.promote({"a": sp.range(3), "b": sp.range(3)}, gate, data_version="v1")
    with pytest.raises(ValueError, match="reference_id detail=2 rows"):
        cat.promote({"a": sp.range(3), "b": sp.range(5)}, gate, data_version="v2")
    cat.promote({"a": sp.range(5), "b": sp.range(5)}, gate, data_version="v2")
    assert {(r.table, r.version, r.data_version) for r in cat.provenance(["a", "b", "c"]).collect()} == {("a", 2, "v2"), ("b", 2, "v2"), ("c", None, None)}
    assert not cat.needs_reload(Manifest("v2", {"a": "x", "b": "y"})) and cat.stale_tables(Manifest("v3", {"a": "x"})) == ["a"]
    cat.rollback(["a"])
    assert cat.needs_reload(Manifest("v2", {"a": "x", "b": "y"})) and not cat.needs_reload(Manifest("v1", {"a": "x"}))
    stamped = cat.stamped(sp.range(1), ["a", "b"]).first().provenance
    assert [(p.table, p.version, p.data_version) for p in stamped] == [("a", 1, "v1"), ("b", 2, "v2")]


def test_incremental_results(sp, tmp_path):  # noqa: F811
    store, seen = incremental.ResultStore(sp, f"file://{tmp_path}/store"), []

    def assess(rows):
        seen.append(rows.count())
        return rows.where(st.area("geom") < 500).select("key", (st.area("geom") * F.col("units")).alias("load"))

    make = lambda ids: layer(sp, [(i, box(0, 0, 10 + i % 5, 10)) for i in ids]).withColumn("units", (F.col("id") % 2).cast("int"))
    big = layer(sp, [(99, box(0, 0, 100, 100))]).withColumn("units", F.lit(1))
    found, n = store.assess(make(range(6)).union(big), ["units"], assess, {"s": 1}, "g1")
    assert n == 7 and {(r.id, r.load) for r in found.collect()} == {(i, (10.0 + i % 5) * 10 * (i % 2)) for i in range(6)}
    again, n = store.assess(make(range(12)).union(big), ["units"], assess, {"s": 1}, "g1")
    assert n == 4 and again.count() == 12 and seen == [7, 4]  # geometry and units of ids 10 and 11 were known, and the one out of scope
    assert store.assess(make(range(3)), ["units"], assess, {"s": 2}, "g1")[1] == 3 and store.assess(make(range(3)), ["units"], assess, {"s": 1}, "g2")[1] == 3
    store.forget([({"s": 1}, "g2")])
    assert store.assess(make(range(3)), ["units"], assess, {"s": 1}, "g2")[1] == 0 and store.assess(make(range(3)), ["units"], assess, {"s": 1}, "g1")[1] == 3
    # results of a run that was lost before its keys were written are not read
    assess(make(range(3)).withColumn("key", F.lit("k"))).write.parquet(f"{store._folder({'s': 1}, 'g2')}/results/run=lost")
    assert store.assess(make(range(3)), ["units"], assess, {"s": 1}, "g2")[0].count() == 3


def test_pyramid_merges_parts_and_equals_single_tiles(sp, monkeypatch):  # noqa: F811
    rows = layer(sp, [(i, box(400000 + i * 40, 200000, 400030 + i * 40, 230000)) for i in range(60)] + [(60, None)], "id long, wkt string").withColumn("name", F.concat(F.lit("n"), (F.col("id") % 7).cast("string"))).withColumn("share", F.col("id") / 4)
    read = lambda df: sorted((r.z, r.x, r.y, r.layer, r.kind, sorted((p.key, p.value) for p in r.properties)) for r in tiles.decoded(df).collect())
    whole = tiles.pyramid(rows, "plans", (7, 9), ["id", "name", "share"])
    found = read(whole)
    monkeypatch.setattr(tiles, "PART_FEATURES", 4)
    monkeypatch.setattr(tiles, "FAN", 2)
    parts = tiles.pyramid(rows, "plans", (7, 9), ["id", "name", "share"])
    assert read(parts) == found and found[0][4] == "polygon" and len(found[0][5]) == 3
    assert {(r.z, r.x, r.y): bytes(r.tile) for r in parts.collect()} == {(r.z, r.x, r.y): bytes(r.tile) for r in whole.collect()}
    for z, x, y in sorted({f[:3] for f in found}):
        alone = tiles.tile(rows.where("geom is not null"), "plans", z, x, y, ["id", "name", "share"])
        assert read(alone) == [f for f in found if f[:3] == (z, x, y)]
    assert tiles.pyramid(rows.where("id > 99"), "plans", (7, 8), ["id"]).count() == 0


def test_a_box_reads_few_row_groups_of_a_clustered_layer(sp, tmp_path):  # noqa: F811
    rows = sp.range(40_000).select("id", st.box(F.col("id") % 200 * 100, F.floor(F.col("id") / 200) * 100, F.col("id") % 200 * 100 + 90, F.floor(F.col("id") / 200) * 100 + 90).alias("geom")).repartition(3, F.xxhash64("id"))
    grid.clustered(rows, files=2).write.option("parquet.block.size", 1 << 15).parquet(str(tmp_path / "layer"))
    box_, total, read = (5000.0, 5000.0, 6000.0, 6000.0), 0, 0
    for f in (tmp_path / "layer").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            s = {n: meta.row_group(g).column(names.index(n)).statistics for n in ("x0", "y0", "x1", "y1")}
            total += 1
            read += s["x0"].min <= box_[2] and s["x1"].max >= box_[0] and s["y0"].min <= box_[3] and s["y1"].max >= box_[1]
    assert total >= 20 and read <= total / 4
    stored = sp.read.parquet(str(tmp_path / "layer"))
    near = tiles.near_box(stored, box_, ("x0", "y0", "x1", "y1"))
    assert near.count() == tiles.near_box(rows, box_).count() and "PushedFilters: [IsNotNull(x0)" in near._jdf.queryExecution().toString()
    assert {r.level for r in stored.select("level").distinct().collect()} == {0} and grid.clustered(rows.limit(0)).count() == 0


def ntv2(path, order, grids):
    """A shift file: grids of (south, north, east, west, step) in seconds, longitudes positive west, and functions of both shifts."""
    import struct

    word = lambda name, form, v: name.ljust(8).encode() + struct.pack(order + form, v).ljust(8, b"\0")
    text = lambda name, v: name.ljust(8).encode() + v.ljust(8).encode()
    raw = word("NUM_OREC", "i", 11) + word("NUM_SREC", "i", 11) + word("NUM_FILE", "i", len(grids)) + text("GS_TYPE", "SECONDS") + b"".join(text(n, "x") for n in ("VERSION", "SYSTEM_F", "SYSTEM_T"))
    raw += b"".join(word(n, "d", 1.0) for n in ("MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T"))
    for south, north, east, west, step, f in grids:
        nodes = [(f(south + j * step, east + i * step)) for j in range(int((north - south) / step) + 1) for i in range(int((west - east) / step) + 1)]
        raw += b"".join(text(n, "x") for n in ("SUB_NAME", "PARENT", "CREATED", "UPDATED")) + b"".join(word(n, "d", float(v)) for n, v in zip(("S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC"), (south, north, east, west, step, step), strict=True))
        raw += word("GS_COUNT", "i", len(nodes)) + b"".join(struct.pack(order + "4f", a, b, 0, 0) for a, b in nodes)
    path.write_bytes(raw)
    return f"file://{path}"


@pytest.mark.parametrize("order", ["<", ">"])
def test_local_shifts_go_both_ways(sp, tmp_path, order):  # noqa: F811
    # one coarse grid over a part of the country, and a finer one in it with other shifts
    coarse = (51 * 3600, 53 * 3600, 0, 4 * 3600, 600, lambda lat, west: (1.5 + (lat - 51 * 3600) * 1e-4, 4.0 + west * 2e-4))
    fine = (52 * 3600, 52 * 3600 + 600, 3600, 4200, 60, lambda lat, west: (3.0, 7.0))
    grid = ntv2(tmp_path / f"g{ord(order)}.gsb", order, [coarse, fine])
    there = lambda x, y: one(sp, st.bounds(st.shifted(st.point(F.lit(x), F.lit(y)), 27700, 4326, grid)).alias("b")).b[:2]
    back = lambda x, y: one(sp, st.bounds(st.shifted(st.point(F.lit(x), F.lit(y)), 4326, 27700, grid)).alias("b")).b[:2]
    for x, y in ((400_000.0, 200_000.0), (451_234.5, 187_654.3), (462_000.0, 240_000.0)):
        lon, lat = there(x, y)
        e, n = back(lon, lat)
        assert abs(e - x) < 0.01 and abs(n - y) < 0.01
    # what the file says, against the plain projection: on the middle meridian 200 km north the shifts are linear, so exact
    plain = one(sp, st.bounds(st.transform(st.point(F.lit(400_000.0), F.lit(200_000.0)), 27700, 4326)).alias("b")).b
    lon, lat = there(400_000.0, 200_000.0)
    assert abs(lon - plain[0]) < 0.005 and abs(lat - plain[1]) < 0.005 and (lon, lat) != tuple(plain[:2])
    # the grid's own longitude there is -2 exactly: 4 + 7200 * 2e-4 seconds further east
    assert abs(lon - (-2 - (4.0 + 7200 * 2e-4) / 3600)) < 1e-9
    # in the finer grid its shift counts; outside of all grids the seven parameters do
    alone = ntv2(tmp_path / f"f{ord(order)}.gsb", order, [fine])
    by_fine = one(sp, st.bounds(st.shifted(st.point(F.lit(462_000.0), F.lit(240_000.0)), 27700, 4326, alone)).alias("b")).b[:2]
    by_coarse = one(sp, st.bounds(st.shifted(st.point(F.lit(462_000.0), F.lit(240_000.0)), 27700, 4326, ntv2(tmp_path / f"c{ord(order)}.gsb", order, [coarse]))).alias("b")).b[:2]
    assert there(462_000.0, 240_000.0) == by_fine and by_fine[0] - by_coarse[0] < -1.5 / 3600 and by_fine[1] - by_coarse[1] > 1.0 / 3600
    far = one(sp, st.bounds(st.transform(st.point(F.lit(400_000.0), F.lit(700_000.0)), 27700, 4326)).alias("b")).b[:2]
    assert there(400_000.0, 700_000.0) == far
    (tmp_path / "bad.gsb").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="NTv2"):
        one(sp, st.shifted(st.point(F.lit(1.0), F.lit(1.0)), 27700, 4326, f"file://{tmp_path}/bad.gsb"))
