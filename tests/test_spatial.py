import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.functions import loads, numeric
from fenmark.operators import grid, overlay, quality_gate, tiles
from fenmark.operators.numbering import number_rows
from fenmark.operators.outputs import CSV_COLUMNS, csv_projection, payload, write_csv
from fenmark.plans import boundary, newt, nutrient
from fenmark.session import checkpoint_dir, ensure_spatial
from fenmark.sources import tabular, vector
from fenmark.sources.catalog import Catalog


@pytest.fixture(scope="session")
def sp(spark):
    return ensure_spatial(spark)


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def layer(sp, rows, columns="id long, wkt string", **more):
    df = sp.createDataFrame(rows, columns)
    return df.withColumn("geom", st.from_text("wkt")).drop("wkt")


def one(sp, *columns):
    return sp.range(1).select(*columns).first()


def test_grid_join_equals_brute_force(sp):
    import random

    r = random.Random(5)
    made = []
    for i in range(260):
        s = r.choice([3, 40, 700, 30_000])
        x, y = r.randrange(-20_000, 20_000, 100), r.randrange(-20_000, 20_000, 100)
        made.append((i, x, y, x + r.randrange(1, s + 1), y + r.randrange(1, s + 1)))
    a, b = made[:130], made[130:]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    frames = [layer(sp, [(p[0], box(*p[1:])) for p in side]) for side in (a, b)]
    got = grid.spatial_join(frames[0], frames[1].select(F.col("id").alias("other"), F.col("geom").alias("r_geom"))).select("id", "other").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_majority_ties_defaults_and_nulls(sp):
    sites = layer(sp, [(1, box(0, 0, 10, 10)), (2, box(100, 100, 110, 110)), (3, box(20, 0, 30, 10)), (4, None)])
    works = layer(sp, [(7, box(0, 0, 5, 10), "a"), (8, box(5, 0, 10, 10), "b"), (9, box(20, 0, 30, 10), None), (10, box(30, 0, 40, 10), "c")], "id long, wkt string, code string")
    got = overlay.majority_overlap(sites, {"w": (works, "code", "id", "none")}, "id").select("id", "w").collect()
    assert dict(map(tuple, got)) == {1: "a", 2: "none", 3: "none", 4: "none"}


def test_difference_clip_nearest_and_lists(sp):
    left = layer(sp, [(1, box(0, 0, 10, 10)), (2, box(0, 0, 2, 2))])
    right = layer(sp, [(5, box(0, 0, 5, 10), "x"), (6, box(400, 0, 410, 10), "y")], "id long, wkt string, name string")
    out = overlay.overlay_difference(left, right.select(F.col("geom").alias("r_geom")), "id").select("id", st.area("geom").alias("a")).collect()
    assert [tuple(r) for r in out] == [(1, 50.0)]
    assert overlay.clip(right, left).select("id", st.area("geom")).collect()[0][1] == 50.0
    lists = overlay.any_intersection(left.union(layer(sp, [(3, box(900, 900, 901, 901))])), right, "name", "id", "id", "names").select("id", "names").collect()
    assert {r.id: r.names for r in lists} == {1: ["x"], 2: ["x"], 3: []}
    far = layer(sp, [(1, "POINT (200 5)"), (2, "POINT (50000 5)")])
    got = {r.id: (r.n, r.distance_m) for r in overlay.nearest(far, right, "name", "id", "id", "n", start=10.0).collect()}
    assert got == {1: ("x", 195.0), 2: ("y", 49590.0)}
    near = {r.id: r.n for r in overlay.nearest(far, right, "name", "id", "id", "n", most=1000.0).collect()}
    assert near == {1: "x", 2: None}


def test_formulas(sp):
    f = F.lit
    row = one(
        sp,
        loads.land_use_uplift(f(1.5), f(0.5), f(10.0), f(25.0), 3.0),
        loads.land_use_uplift(f(1.5), f(3.0), f(10.0), f(25.0), 3.0),
        loads.suds_mitigation(f(15.9), f(60)),
        loads.suds_mitigation(f(3.06), f(60)),
        loads.suds_mitigation(f(-20.0), f(60)),
        F.round(loads.wastewater_load(f(100), f(2.4), f(110.0), f(10.0)), 4),
        F.round(loads.with_buffer(f(-37.5), f(96.53)), 3),
        loads.band(f(0.25)),
        loads.band(f(5.1)),
        numeric.round_exact(f(10.505), 2),
        numeric.round_exact(f(2.675), 2),
        numeric.ratio(f(3), f(0)),
        numeric.to_number(f("x")),
        numeric.to_number(f("NaN")),
        loads.highest_zone(F.array(f("Green"), f("Red"))),
    )
    assert list(row) == [22.5, 15.9, 11.92, 2.3, -25.0, 86.7834, 70.836, 1, 4, 10.51, 2.67, float("inf"), None, None, "Red"]


def reference(sp):
    square = box(450000, 100000, 450400, 100200)
    coef = layer(sp, [(box(450000, 100000, 450100, 100100), 5.0, 10.0, 0.5, 1.0), (box(450200, 100000, 450300, 100100), 3.0, 10.0, 0.3, 1.0)], "wkt string, lu_curr_n_coeff double, n_resi_coeff double, lu_curr_p_coeff double, p_resi_coeff double")
    catchments = layer(sp, [(square, "Solent", "1")], "wkt string, n2k_site_n string, oid string")
    works = layer(sp, [(1, box(450000, 100000, 450150, 100100), "123")], "id long, wkt string, code string")
    named = layer(sp, [(1, square, "Somewhere")], "id long, wkt string, name string")
    rates = sp.createDataFrame([("Solent", 2.4, 150.0, 0)], "nn_catchment string, occupancy_rate double, water_usage double, pos int")
    lookup = sp.createDataFrame([("123", "Works", None, 10.0, 8.0, 1.0, 0.8, 0), ("123", "Later", None, 1.0, 1.0, 1.0, 1.0, 1)], "wwtw_code string, wwtw_name string, wwtw_subcatchment string, n_conc_2025 double, n_conc_2030 double, p_conc_2025 double, p_conc_2030 double, pos int")
    return nutrient.Reference(coef, catchments, works, named, named, rates, lookup)


def sites(sp):
    rows = [(10, box(450000, 100000, 450100, 100100), "A", "c", "s", 10), (20, box(450200, 100000, 450300, 100100), "B", "c", "s", 60), (30, box(900000, 900000, 900100, 900100), "C", "c", "s", 5)]
    return layer(sp, rows, "id long, wkt string, Name string, Dwel_Cat string, Source string, Dwellings int")


def test_nutrient_assessment(sp, tmp_path):
    out = nutrient.assess(nutrient.prepare(sites(sp)), reference(sp)).orderBy("rlb_id")
    a, b = out.collect()  # the third lies outside everything
    assert (a.rlb_id, a.dev_area_ha, a.n_lu_uplift, a.p_lu_uplift, a.n_lu_post_suds) == (1, 1.0, 3.6, 0.34, 3.6)
    assert (a.majority_wwtw_id, a.wwtw_name, a.nn_catchment, a.nn_catchment_entries[0].oid) == (123, "Works", "Solent", "1")
    assert a.n_wwtw_perm == round(10 * 2.4 * 150 * 365.25 * 8 / 1e6 * 0.9, 2)
    assert a.n_total == round((3.6 + 10 * 2.4 * 150 * 365.25 * 8 / 1e6 * 0.9) * 1.2, 2)
    assert (b.majority_wwtw_id, b.wwtw_name, b.n_lu_post_suds) == (141, None, 4.2)
    assert csv_projection(out).columns == list(CSV_COLUMNS) and len(CSV_COLUMNS) == 31
    body = json.loads(payload(out).first().payload)
    assert body["catchments"] == [{"id": "1", "name": "Solent"}] and body["nitrogen"]["band"] == 4
    write_csv(out, str(tmp_path / "csv"))
    with pytest.raises(ValueError):
        write_csv(out.where("false"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="dwellings"):
        nutrient.prepare(sites(sp).drop("Dwellings"))


def test_newt_assessment(sp):
    site = layer(sp, [("s", box(0, 0, 100, 100))], "site string, wkt string")
    zones = layer(sp, [("Red", box(-50, -50, 50, 150)), ("Amber", box(50, -50, 400, 150))], "rz string, wkt string")
    ponds = layer(sp, [(box(40, 40, 60, 60),), (box(200, 50, 210, 60),), (box(5000, 0, 5001, 1),)], "wkt string")
    out = newt.assess(site, zones, ponds)
    freq = {(r.Area, r.MaxZone): (r.PANS, r.TmpImp, r.FREQUENCY) for r in out["pond_frequency"].collect()}
    assert freq == {("RLB", "Red"): ("NS", "F", 1), ("Buffer", "Amber"): ("NS", "F", 1)}
    habitat = {(r.Area, r.RZ): r.Shape_Area for r in out["habitat_impact"].collect()}
    assert habitat["RLB", "Red"] == pytest.approx(5000) and habitat["RLB", "Amber"] == pytest.approx(5000)
    assert habitat["Buffer", "Red"] > 5000
    with pytest.raises(ValueError):
        newt.assess(site, zones, ponds, surveyed=True)


def test_boundary_checks(sp):
    cases = {
        box(0, 0, 10, 10): None,
        "POINT (1 1)": "unsupported_geometry_type",
        "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))": "self_intersecting_geometry",
        "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))": "geometry_has_holes",
        "POLYGON ((0 0, 9 0, 9 0, 9 9, 0 9, 0 0))": "duplicate_vertices",
        None: "invalid_geometry",
    }
    got = layer(sp, [(k,) for k in cases], "wkt string")
    rows = sp.createDataFrame([(k,) for k in cases], "wkt string").withColumn("geom", st.from_text("wkt")).withColumn("e", boundary.first_error()).collect()
    assert {r.wkt: r.e for r in rows} == cases
    m = got.limit(1).select(boundary.metadata().alias("m")).first().m
    assert m.area.hectares == 0.01 and m.perimeter.kilometres == 0.04


def test_transform_control_point(sp):
    # the published worked example of the national grid: 651409.792 E, 313177.448 N is 52 39 28.8282 N 1 42 57.8663 E; some metres are allowed
    row = one(sp, st.bounds(st.transform(st.point(F.lit(651409.792), F.lit(313177.448)), 27700, 4326)).alias("b"))
    lon, lat = row.b[:2]
    assert abs(lat - (52 + 39 / 60 + 28.8282 / 3600)) < 5e-5 and abs(lon - (1 + 42 / 60 + 57.8663 / 3600)) < 5e-5
    back = one(sp, st.bounds(st.transform(st.transform(st.point(F.lit(450000.0), F.lit(100000.0)), 27700, 4326), 4326, 27700)).alias("b")).b
    assert abs(back[0] - 450000) < 0.05 and abs(back[1] - 100000) < 0.05


def test_tile_is_decodable(sp):
    rows = layer(sp, [("a", box(400000, 200000, 500000, 300000))], "name string, wkt string")
    got = tiles.tile(rows, "plans", 5, 15, 10, ["name"]).collect()
    body = bytes(got[0].tile)
    assert got[0].features == 1 and body[0] == 0x1A and b"plans" in body and b"name" in body
    kind, numbers = tiles.commands(vector.wkb({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}))
    assert kind == 3 and numbers == [9, 0, 0, 26, 20, 0, 0, 20, 19, 0, 15]


def test_readers(sp, tmp_path):
    doc = {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::27700"}}, "features": [{"type": "Feature", "properties": {"n": "é"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 5], [4, 0, 5], [4, 4, 5], [0, 0, 5]]]}}, {"type": "Feature", "properties": None, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    got = vector.read_vector(sp, str(tmp_path / "a.geojson")).select("attributes", "srid", st.area("geom").alias("a")).collect()
    assert [(r.srid, r.a) for r in got] == [(27700, 8.0), (27700, None)] and json.loads(got[0].attributes) == {"n": "é"}

    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>p</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>'
    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 1, 65, 9) + b"ID".ljust(11, b"\0") + b"N" + bytes(4) + bytes([8, 0]) + bytes(14) + b"\x0d" + b" " + b"7".rjust(8)
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    body = struct.pack("<I4dII", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<I", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    shp = bytes(100) + struct.pack(">II", 1, len(body) // 2) + body
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for name, raw in {"x/s.shp": shp, "x/s.dbf": dbf, "x/s.shx": b"", "x/s.prj": b'PROJCS["British_National_Grid"]', "k.kml": kml.encode()}.items():
            z.writestr(name, raw)
    got = vector.read_vector(sp, str(tmp_path / "b.zip")).select("attributes", "srid", st.area("geom").alias("a")).first()
    assert (json.loads(got.attributes), got.srid, got.a) == ({"ID": 7}, 27700, 4.0)
    assert vector.read_vector(sp, str(tmp_path / "b.zip"), entry="k.kml").select(st.area("geom")).first()[0] == 0.5
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.shp", b"")
    with pytest.raises(ValueError, match="unsafe"):
        vector.features("bad.zip", (tmp_path / "bad.zip").read_bytes())

    db = sqlite3.connect(tmp_path / "l.sqlite")
    db.execute("CREATE TABLE rates (a TEXT, b REAL)")
    db.execute("INSERT INTO rates VALUES ('x', 1.5), (NULL, 2)")
    db.commit()
    assert sorted(map(tuple, tabular.read_sqlite(sp, str(tmp_path / "l.sqlite"), "rates", ["a", "b"]).collect()), key=str) == [("x", "1.5"), (None, "2.0")]
    (tmp_path / "d.sql").write_text("--\nCOPY public.t (a, b) FROM stdin;\n1\tx\\ty\n2\t\\N\n\\.\n")
    assert sorted(map(tuple, tabular.read_dump(sp, str(tmp_path / "d.sql"), ["a", "b"]).collect())) == [("1", "x\ty"), ("2", None)]
    lookups = sp.createDataFrame([("r", 1, '[{"k": "a", "v": 2}]')], "name string, version int, data string")
    assert tabular.explode_lookup(lookups, "r", 1, "k: string, v: int").collect()[0][:] == (0, "a", 2)
    with pytest.raises(ValueError):
        tabular.explode_lookup(lookups, "r", 2, "k: string")


def test_catalog_promotes_all_or_nothing_and_rolls_back(sp, tmp_path):
    cat = Catalog(sp, f"file://{tmp_path}/cat")
    rules = quality_gate.Rules(key=["id"], unique=True, ranges={"v": (0, 50)}, allowed={"rz": ["Red"]}, row_floor_percent=90)
    gate = lambda name, new, old: quality_gate.check(name, new, rules, old)
    good = sp.createDataFrame([(1, 1.0, "Red"), (2, None, None)], "id long, v double, rz string")
    cat.promote({"a": good, "b": good}, gate)
    cat.promote({"a": good.where("id < 3")}, gate)
    assert cat.active("a") == 2 and cat.read("a").count() == 2
    bad = sp.createDataFrame([(1, 999.0, "Purple"), (1, 1.0, "Red")], "id long, v double, rz string")
    with pytest.raises(ValueError) as e:
        cat.promote({"a": good, "b": bad}, gate)
    assert all(x in str(e.value) for x in ("rule=range_v", "rule=allowed_rz", "rule=unique_key"))
    assert cat.pointer() == {"a": 2, "b": 1} and cat.versions("a") == [1, 2]
    assert cat.rollback(["a", "b"]) == ({"a": 1}, {"b": "version 0 is not there"})
    assert cat.active("a") == 1 and cat.history().where("status = 'failed'").count() == 2
    assert cat.needs_reload("a", "x")
    cat.note_etag("a", "x")
    assert not cat.needs_reload("a", "x")


def test_row_numbers(sp):
    rows = number_rows(sp.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k")), "k", "n").collect()
    assert all(r.n == r.k + 1 for r in rows)


def test_majority_and_row_numbers_with_uuid_ids(sp):
    sites = layer(sp, [("b1", box(0, 0, 10, 10)), ("a2", box(100, 100, 110, 110)), ("c3", box(20, 0, 30, 10))], "id string, wkt string")
    works = layer(sp, [("f0-7", box(0, 0, 5, 10), "a"), ("e9-8", box(5, 0, 10, 10), "b"), ("00-1", box(20, 0, 30, 10), None)], "id string, wkt string, code string")
    numbered = layer(sp, [(3, box(0, 0, 1, 1), "n")], "id long, wkt string, name string")
    got = overlay.majority_overlap(sites, {"w": (works, "code", "id", "none"), "n": (numbered, "name", "id", None)}, "id").select("id", "w", "n").collect()
    assert {r.id: (r.w, r.n) for r in got} == {"b1": ("b", "n"), "a2": ("none", None), "c3": ("none", None)}
    rows = number_rows(sp.range(0, 3000, 1, 7).select(F.sha2(F.col("id").cast("string"), 256).alias("k")), "k", "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.k)] == list(range(1, 3001))
    few = number_rows(sp.createDataFrame([("b",), (None,), ("a",)], "k string"), "k", "n").collect()
    assert {r.k: r.n for r in few} == {None: 1, "a": 2, "b": 3} and number_rows(sp.createDataFrame([], "k string"), "k", "n").count() == 0


def test_small_boundaries_touch_and_parts_of_large_features(sp):
    left = layer(sp, [(1, box(0, 0, 10, 10)), (2, box(60_000, 60_000, 60_010, 60_010)), (3, box(-5, -5, -1, -1))])
    ring = "POLYGON ((0 0, 100000 0, 100000 100000, 0 100000, 0 0), (50000 50000, 70000 50000, 70000 70000, 50000 70000, 50000 50000))"
    right = layer(sp, [(9, ring)]).select(F.col("id").alias("o"), F.col("geom").alias("r_geom"))
    assert [tuple(r) for r in grid.spatial_join(left, right).select("id", "o").collect()] == [(1, 9)]
    assert [r[0] for r in grid.spatial_join(left, right).select(st.shared_area("geom", "r_geom")).collect()] == [100.0]
    touch = one(sp, st.shared_area(st.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), st.box(F.lit(1), F.lit(0), F.lit(2), F.lit(1))), st.shared_area(st.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), st.box(F.lit(3), F.lit(0), F.lit(4), F.lit(1))))
    assert list(touch) == [0.0, None]


def test_clip_by_many_masks(sp):
    rows = layer(sp, [(1, box(0, 0, 100, 100)), (1, box(0, 0, 100, 100)), (2, box(500, 500, 600, 600))])
    masks = layer(sp, [(i, box(i * 10, 0, i * 10 + 15, 50)) for i in range(8)])
    got = sorted((r.id, r.a) for r in overlay.clip(rows, masks).select("id", st.area("geom").alias("a")).collect())
    assert got == [(1, 85 * 50.0), (1, 85 * 50.0)]


def test_gate_reports_text_that_is_no_number(sp):
    rows = sp.createDataFrame([('{"v": "x", "o": "q"}',), ('{"v": 7, "o": 1}',), ('{"v": 99}',), (None,)], "attributes string")
    rules = quality_gate.Rules(ranges={"attributes.v": (0, 50)}, references={"attributes.o": (sp.range(3), "id", True)})
    got = quality_gate.check("t", rows, rules)
    assert got == ["table=t rule=range_attributes.v detail=1 rows", "table=t rule=number_attributes.v detail=1 rows", "table=t rule=reference_attributes.o detail=1 rows"]
    assert quality_gate.parse_failure(got[0]) == {"table": "t", "rule": "range_attributes.v", "detail": "1 rows"} and quality_gate.parse_failure("boom")["rule"] == "unknown"
    by = quality_gate.failures_by_table(sp.createDataFrame([(g,) for g in got] + [("boom",), (None,)], "failure string"))
    assert {r.table: (r.n, r.detail) for r in by.collect()} == {"t": (3, "number_attributes.v: 1 rows; range_attributes.v: 1 rows; reference_attributes.o: 1 rows"), "": (1, "unknown: boom")}


def test_rules_from_text(sp):
    text = '{"tables": {"a": {"key": "id", "unique": true, "ranges": {"v": [0, 5]}, "references": {"o": {"table": "b"}}}}}'
    rules = quality_gate.load_rules(text, {"b": sp.range(2)})["a"]
    assert rules.key == ["id"] and rules.ranges == {"v": (0.0, 5.0)} and rules.references["o"][1:] == ("id", True)
    for bad in ("{}", '{"tables": {"a": {"key": "id", "nope": 1}}}', '{"tables": {"a": {}}}', text):
        with pytest.raises(ValueError):
            quality_gate.load_rules(bad)


def test_checkpoint_dir_is_the_sessions(spark):
    assert checkpoint_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/")

    class Far:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Far)


def test_dense_cells_are_small_and_huge_rows_deal_what_they_hold(sp):
    # 4,000 boxes of two metres and some larger ones within one cell of 500 m, and one row that holds all
    tiny = sp.range(4000).select("id", st.box(F.col("id") % 80 * 6, F.floor(F.col("id") / 80) * 6, F.col("id") % 80 * 6 + 2, F.floor(F.col("id") / 80) * 6 + 2).alias("geom"))
    wide = sp.range(5).select((F.col("id") + 10_000).alias("id"), st.box(F.col("id") * 90, F.lit(0), F.col("id") * 90 + 100, F.lit(290)).alias("geom"))
    huge = sp.range(1).select(F.lit(20_000).cast("long").alias("id"), st.box(F.lit(-50_000), F.lit(-50_000), F.lit(50_000), F.lit(50_000)).alias("geom"))
    rows = tiny.union(wide).union(huge)
    other = rows.select(F.col("id").alias("r_id"), F.col("geom").alias("r_geom"))
    found = {tuple(r) for r in grid.spatial_join(rows, other).select("id", "r_id").collect()}
    boxes = {r.id: tuple(r.b) for r in rows.select("id", st.bounds("geom").alias("b")).collect()}
    large = [i for i in boxes if i >= 10_000]
    meet = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    brute = {(i, i) for i in boxes if i < 10_000} | {(i, j) for i in large for j in boxes if meet(boxes[i], boxes[j])}
    brute |= {(j, i) for i, j in brute}
    assert found == brute

    boxed = grid.with_box(tiny, "geom", "_box")
    mine, _ = grid._levels(boxed, None)
    most = grid._celled(boxed, "l", "r", mine, mine).groupBy("_level", "_part", "_salt", "_cx", "_cy").count().agg(F.max("count")).first()[0]
    assert most <= 4
    # the one huge row is repeated once for so many of the small ones, and dealt rows never come less often than repeated ones
    assert grid._shares({6: 1}, {-4: 4000}) == {6: 256} and grid._shares({6: 1}, {-4: 10**9}) == {6: grid.MOST_SHARES}
    assert grid._shares({2: 1000}, {-4: 1000, 1: 10**9}) == {2: 1} and grid._shares({2: None}, {-4: 7}) == {2: grid.SHARES}
