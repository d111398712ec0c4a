import json
import math
import sqlite3
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from fenmark.functions import geometry as st
from fenmark.functions import loads, numeric
from fenmark.operators import outputs, tiles, validation
from fenmark.plans import extract, nutrient, queries, registry, synth
from fenmark.sources import tabular, vector
from fenmark.sources.catalog import Busy, Catalog, Manifest
from fenmark.streaming import jobs, metrics
from tests.test_spatial import box, layer, one, reference, sites, sp  # noqa: F401


def test_upload_checks(sp):  # noqa: F811
    good = layer(sp, [(1, box(450000, 100000, 450100, 100100))])
    assert validation.upload_errors(good) == [] and validation.upload_errors(good.where("false")) == ["empty"]
    bow = "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))"
    many = layer(sp, [(1, None), (2, bow), (3, "POINT (1 1)")])
    assert validation.upload_errors(many) == ["null_geometry: 1", "invalid_geometry: 1", "not_polygonal: 1"]
    assert validation.upload_errors(layer(sp, [(1, box(0, 50, 1, 51))])) == ["degrees"]
    assert validation.upload_errors(layer(sp, [(1, box(0, 50, 1, 51)), (2, box(699_999, 0, 700_001, 9))])) == ["outside_grid"]
    rows = {r.id: r.e for r in many.select("id", validation.geometry_errors().alias("e")).collect()}
    assert rows == {1: ["null_geometry"], 2: ["invalid_geometry", "degrees"], 3: ["not_polygonal", "degrees"]}
    assert validation.attribute_errors(good) == ["missing_columns: Name, Dwel_Cat, Source, Dwellings, Shape_Area"]
    assert validation.first_polygon(layer(sp, [(1, "POINT (1 1)"), (2, box(0, 0, 1, 1)), (3, box(0, 0, 2, 2))]).withColumn("k", F.lit(7)), "k", "id").first().id == 2
    with pytest.raises(validation.EmptyReference, match="b, c"):
        validation.require_rows({"a": good, "b": good.where("false"), "c": good.where("false")})
    assert validation.identifier("nn_2") == "nn_2"
    for bad in ("a b", 'x"; drop', "", "2a"):
        with pytest.raises(ValueError):
            validation.identifier(bad)
    with pytest.raises(ValueError, match="1 keys"):
        validation.many_to_one(good, good.union(good), ["id"])


def test_registry_and_sinks(sp):  # noqa: F811
    got, r = [], registry.Registry()
    r.add("nutrient", lambda spark, s, ref: {"impact_summary": nutrient.assess(nutrient.prepare(s), ref)}, [lambda s: validation.upload_errors(s.limit(2))])
    r.add("broken", lambda *_: 1 / 0)
    r.add("wrong", lambda *_: {"x": 1})
    out = r.run("nutrient", sp, sites(sp), reference(sp), [lambda found, run: got.append((run, sorted(found)))], "r1")
    assert out["impact_summary"].count() == 2 and got == [("r1", ["impact_summary"])]
    with pytest.raises(KeyError):
        r.run("none", sp, sites(sp), None)
    for name in ("broken", "wrong"):
        with pytest.raises(ValueError):
            r.run(name, sp, sites(sp), None)
    with pytest.raises(ValueError, match="empty"):
        r.run("nutrient", sp, sites(sp).where("false"), reference(sp))
    with pytest.raises(ValueError, match="unknown assignment"):
        registry.assign("best", sites(sp), sites(sp), "Name", "id", "id", "x")
    left, right = layer(sp, [(1, box(0, 0, 10, 10))]), layer(sp, [(5, box(0, 0, 5, 10), "x")], "id long, wkt string, name string")
    assert registry.assign("nearest", left, right, "name", "id", "id", "n").first().n == "x"
    assert registry.assign("intersection", left, right, "name", "id", "id", "n").select("n", st.area("geom")).first()[:] == ("x", 50.0)


def test_catalog_locks_counts_and_keeps_the_active_version(sp, tmp_path):  # noqa: F811
    cat = Catalog(sp, f"file://{tmp_path}/cat")
    rows = sp.range(4)
    assert cat.generation() is None
    cat.promote({"a": rows})
    cat.promote({"a": rows})
    cat.rollback(["a"])
    cat.promote({"a": rows}, expected={"a": 4})
    assert cat.versions("a") == [1, 3] and cat.active("a") == 3  # what was active before stays
    with pytest.raises(ValueError, match="rows_written"):
        cat.promote({"a": rows}, expected={"a": 5})
    with cat.single_flight(), pytest.raises(Busy):
        cat.promote({"a": rows})
    with cat.single_flight(), cat.single_flight(stale_after_s=-1):
        pass
    cat.promote({"a": rows})
    first = cat.generation()
    assert first is not None and cat.reconcile() == []
    cat._replace("pointer.json", {"a": 3})
    assert cat.reconcile() == [] and {(r.table, r.version, r.n, r.empty) for r in cat.status(["a", "b"]).collect()} == {("a", 3, 4, False), ("b", None, None, True)}
    rows.write.parquet(f"{cat.root}/b/version=1")
    cat._replace("pointer.json", {"a": 3, "b": 1})
    assert cat.reconcile() == ["b"] and cat.reconcile() == []
    (tmp_path / "x").write_text("1")
    tag = cat.source_tag(f"file://{tmp_path}/x")
    time.sleep(0.01)
    (tmp_path / "x").write_text("22")
    assert cat.source_tag(f"file://{tmp_path}/x") != tag
    assert Manifest.parse('{"data_version": "v1", "tables": {"a": "a.sql.gz"}}').tables == {"a": "a.sql.gz"}
    for bad in ('{"data_version": "", "tables": {"a": "b"}}', '{"data_version": "v", "tables": {}}', '{"data_version": "v", "tables": {"a": ""}}', "{}"):
        with pytest.raises(ValueError):
            Manifest.parse(bad)


def test_dump_reader_takes_one_table(sp, tmp_path):  # noqa: F811
    text = "SET x = 1;\nCOPY public.t (a, \"b\", c) FROM stdin;\n1\tp\\\\tq\tx\n2\t\\N\ta\\tb\\\\\\\\n\n3\t\\\\N\t\n\\.\n\nCOPY public.u (a, b, c) FROM stdin;\n9\t9\t9\n\\.\n"
    (tmp_path / "d.sql").write_text(text)
    got = tabular.read_dump(sp, str(tmp_path / "d.sql"), ["c", "b"], "t").collect()
    assert [tuple(r) for r in got] == [("x", "p\\tq"), ("a\tb\\\\n", None), ("", "\\N")]
    import gzip

    (tmp_path / "d.sql.gz").write_bytes(gzip.compress(text.encode()))
    assert [r.a for r in tabular.read_dump(sp, str(tmp_path / "d.sql.gz"), ["a"], "public.u").collect()] == ["9"]
    for columns, table in ((["a"], None), (["a"], "v"), (["z"], "t")):
        with pytest.raises(ValueError):
            tabular.read_dump(sp, str(tmp_path / "d.sql"), columns, table)
    with pytest.raises(ValueError):
        tabular.read_sqlite(sp, "x", "t", ['a" FROM t; --'])


def test_more_vector_readers(sp, tmp_path):  # noqa: F811
    ring = lambda x: f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{x},0 {x + 1},0 {x + 1},1 {x},0</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    kml = f'<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>p</name><ExtendedData><Data name="k"><value>v</value></Data></ExtendedData><MultiGeometry>{ring(0)}{ring(5)}</MultiGeometry></Placemark><Placemark><MultiGeometry>{ring(0)}<Point><coordinates>1,2</coordinates></Point></MultiGeometry></Placemark><Placemark/></kml>'
    (tmp_path / "m.kml").write_text(kml)
    got = vector.read_vector(sp, str(tmp_path / "m.kml")).select("attributes", st.area("geom").alias("a"), st.geometry_type("geom").alias("t")).collect()
    assert [(r.a, r.t) for r in got] == [(1.0, "MultiPolygon"), (0.5, "GeometryCollection"), (None, None)] and json.loads(got[0].attributes) == {"Name": "p", "k": "v"}

    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 2, 65, 9) + b"ID".ljust(11, b"\0") + b"N" + bytes(4) + bytes([8, 0]) + bytes(14) + b"\x0d" + b"*" + b"6".rjust(8) + b" " + b"7".rjust(8)
    shape = struct.pack("<I4dI", 8, 0, 0, 2, 2, 2) + struct.pack("<4d", 0, 0, 2, 2)
    shp = bytes(100) + b"".join(struct.pack(">II", i, len(shape) // 2) + shape for i in (1, 2))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for name, raw in {"s.shp": shp, "s.dbf": dbf, "s.shx": b""}.items():
            z.writestr(name, raw)
    got = vector.read_vector(sp, str(tmp_path / "s.zip")).select("attributes", st.as_text("geom").alias("t")).collect()
    assert [(json.loads(r.attributes), r.t) for r in got] == [({"ID": 7}, "MULTIPOINT ((0 0), (2 2))")]

    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('plans', 'shape', 27700), ('other', 'shape', 4326)")
    for t in ("plans", "other"):
        db.execute(f"CREATE TABLE {t} (fid INTEGER, shape BLOB, n TEXT)")
    body = vector.wkb({"type": "Point", "coordinates": [3, 4]})
    db.execute("INSERT INTO plans VALUES (1, ?, 'a'), (2, NULL, 'b')", (b"GP\0\x03" + struct.pack("<i4d", 27700, 3, 3, 4, 4) + body,))
    db.commit()
    db.close()
    got = vector.read_vector(sp, str(tmp_path / "g.gpkg"), "plans").select("attributes", "srid", st.as_text("geom").alias("t")).collect()
    assert [(json.loads(r.attributes), r.srid, r.t) for r in got] == [({"fid": 1, "n": "a"}, 27700, "POINT (3 4)"), ({"fid": 2, "n": "b"}, 27700, None)]
    with pytest.raises(Exception, match="unsupported_crs"):
        vector.read_vector(sp, str(tmp_path / "g.gpkg"), "plans", declared=(4326,)).collect()


def test_callback_tries_again(sp):  # noqa: F811
    def post(key, body):
        n = int(body)
        if n < 0:
            raise OSError("nobody")
        return n

    rows = sp.createDataFrame([("a", "200"), ("b", "404"), ("c", "503"), ("d", "-1"), ("e", "400"), ("f", "429")], "id string, payload string")
    got = {r.id: (r.status, r.attempts) for r in outputs.send(rows, post, retries=2, wait=lambda s: None).collect()}
    assert got == {"a": (200, 1), "b": (404, 1), "c": (503, 3), "d": (0, 3), "e": (400, 1), "f": (429, 3)}


def test_dumps_settings_and_cleaners(sp, tmp_path):  # noqa: F811
    outputs.dump({"a": sp.range(3)}, f"file://{tmp_path}/dump")
    assert sp.read.parquet(f"file://{tmp_path}/dump/a").count() == 3
    s = loads.settings({"spark.fenmark.greenspace.share": "0.3", "spark.fenmark.fallbackWorks": "7", "spark.app.name": "x"})
    assert (s.greenspace.share, s.greenspace.n_coeff, s.fallback_works, s.buffer_percent) == (0.3, 3.0, 7, 20.0)
    with pytest.raises(ValueError):
        loads.settings({"spark.fenmark.nope": "1"})
    df = sp.sql("SELECT 1 AS k, double('NaN') AS a, array(1D, double('Infinity')) AS b, struct(float('NaN') AS c, 'x' AS d) AS e, map('k', double('NaN')) AS m, CAST(NULL AS STRUCT<c: DOUBLE>) AS n")
    r = numeric.cleaned(df).first()
    assert (r.k, r.a, r.b, r.e.c, r.e.d, r.m, r.n) == (1, None, [1.0, None], None, "x", {"k": None}, None)
    assert [st.epsg(x) for x in ("EPSG:27700", "urn:ogc:def:crs:EPSG::4326")] == [27700, 4326]
    with pytest.raises(ValueError):
        st.epsg("CRS84")
    assert one(sp, st.hash_key(st.point(F.lit(1), F.lit(2))), st.hash_key(st.point(F.lit(1), F.lit(2))))[0:1] == one(sp, st.hash_key(st.point(F.lit(1), F.lit(2))))[:]
    assert one(sp, numeric.unwrapped_json(F.lit('"{\\"a\\": 1}"')), numeric.unwrapped_json(F.lit("{}")))[:] == ('{"a": 1}', None)


def test_metric_rows_and_days(sp, tmp_path):  # noqa: F811
    stats = metrics.parse_stats(sp.createDataFrame([("c1|1.5%|1KiB / 2KiB|1kB / 0B",)], "value string"))
    assert {(r.metric, r.value) for r in metrics.long_metrics(stats).collect()} == {("cpu_percent", 1.5), ("memory_bytes", 1024.0), ("memory_limit_bytes", 2048.0), ("received_bytes", 1000.0), ("sent_bytes", 0.0)}
    sp.createDataFrame([(1, "2026-01-01"), (2, "2026-02-20")], "v int, day string").write.partitionBy("day").parquet(f"file://{tmp_path}/days")
    assert metrics.drop_old_days(sp, f"file://{tmp_path}/days", "2026-02-28") == ["day=2026-01-01"]
    assert [r.v for r in sp.read.parquet(f"file://{tmp_path}/days").collect()] == [2]


def test_a_job_comes_once_by_its_reference(sp, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    job = lambda ref, units: json.dumps({"reference": ref, "boundaryGeojson": {"boundaryGeometryOriginal": "{}"}, "housingUnits": units})
    (tmp_path / "in" / "a.json").write_text("\n".join([job("NRF-000001", 3), job("NRF-000001", 4), job("NRF-000002", 5), "junk", "other junk", "junk"]))
    jobs.run(sp, f"file://{tmp_path}/in", f"file://{tmp_path}/c", lambda df: df.select("reference", "housingUnits"), f"file://{tmp_path}/out", f"file://{tmp_path}/bad")
    assert sorted(r.reference for r in sp.read.parquet(f"file://{tmp_path}/out").collect()) == ["NRF-000001", "NRF-000002"]
    assert sp.read.parquet(f"file://{tmp_path}/bad").count() == 2


def test_tiles_keep_numbers_and_prune(sp):  # noqa: F811
    rows = layer(sp, [("a", 7, box(400000, 200000, 500000, 300000)), ("b", -3, box(0, 0, 10, 10))], "name string, n long, wkt string").withColumn("share", F.lit(0.5))
    got = tiles.tile(rows, "plans", 5, 15, 10, ["name", "n", "share"], version=2).first()
    body = bytes(got.tile)
    assert got.features == 1 and bytes([4, 0x22, 2, 6 << 3, 14])[1:] in body and struct.pack("<d", 0.5) in body
    assert got.etag != tiles.tile(rows, "plans", 5, 15, 10, ["name"], version=3).first().etag
    boxes = rows.select("name", "geom", *[st.bounds("geom")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    near = tiles.near_box(boxes, (-5.0, -5.0, 5.0, 5.0), ("x0", "y0", "x1", "y1"))
    assert [r.name for r in near.collect()] == ["b"] == [r.name for r in tiles.near_box(rows, (-5.0, -5.0, 5.0, 5.0)).collect()]


def test_newt_payload(sp):  # noqa: F811
    habitat = sp.createDataFrame([(1, "RLB", "Red", 2.0), (1, "RLB", "Red", 3.0), (2, "Buffer", "Green", 1.0)], "site long, Area string, RZ string, Shape_Area double")
    frequency = sp.createDataFrame([(1, "NS", "RLB", "Red", "F", 4), (3, "P", "Buffer", "Amber", "T", 1)], "site long, PANS string, Area string, MaxZone string, TmpImp string, FREQUENCY long")
    got = {r.site: json.loads(r.payload) for r in outputs.newt_payload(habitat, frequency).collect()}
    assert got[1]["habitatImpacts"] == [{"area": "RLB", "zone": "Red", "squareMetres": 5.0}] and got[1]["pondFrequencies"][0]["frequency"] == 4
    assert got[2]["pondFrequencies"] == [] and got[3]["habitatImpacts"] == []


def test_newt_payload_query_has_buffers(sp):  # noqa: F811
    """Sites far inside a zone and a catchment: their buffers are known, and ponds in them count."""
    got = {r.site: json.loads(r.payload) for r in queries.QUERIES["newt_payload"](sp, SMOKE_DIR).collect()}
    dev = synth._sql(sp, SMOKE_DIR, synth.RECTANGLES["dev"]).where("x0 % 20000 between 600 and 13500 and y0 % 20000 between 600 and 18500")
    dev = dev.withColumn("around", st.buffer(st.box("x0", "y0", "x1", "y1"), 250.0))
    ponds = synth.layer(sp, SMOKE_DIR, "ponds").select(F.col("geom").alias("pond"))
    near = {r.id: r.n for r in dev.crossJoin(ponds).where(st.intersects("around", "pond")).groupBy("id").agg(F.count("pond").alias("n")).collect()}
    rows = dev.select("id", "x0", "y0", "x1", "y1").collect()
    for r in rows:
        w, h = r.x1 - r.x0, r.y1 - r.y0
        found = {(x["area"], x["zone"]): x["squareMetres"] for x in got[r.id]["habitatImpacts"]}
        assert len(found) == 2 and min(found.values()) == pytest.approx(w * h)
        disc = 0.5 * 64 * 250.0**2 * math.sin(2 * math.pi / 64)
        assert max(found.values()) == pytest.approx(w * h + 500 * (w + h) + disc, abs=1.0)
        assert sum(p["frequency"] for p in got[r.id]["pondFrequencies"]) == 1 + near.get(r.id, 0)
    assert len(rows) > 30 and any(near.values())


def test_extract_around_sites(sp):  # noqa: F811
    near = layer(sp, [(1, box(0, 0, 10, 10))]), layer(sp, [(2, box(1000, 0, 1010, 10))])
    rows = layer(sp, [("a", box(0, 0, 100, 10)), ("b", box(500, 500, 600, 600)), ("c", box(1005, 0, 1300, 10))], "name string, wkt string")
    got = {r.name: r.a for r in extract.around(list(near), {"rows": rows}, 20.0)["rows"].select("name", st.area("geom").alias("a")).collect()}
    assert got.keys() == {"a", "c"} and got["a"] == pytest.approx(300) and got["c"] == pytest.approx(250)
    text = one(sp, st.as_geojson(st.box(F.lit(0), F.lit(0), F.lit(2), F.lit(1))))[0]
    assert json.loads(text)["type"] == "Polygon" and len(json.loads(text)["coordinates"][0]) == 5
