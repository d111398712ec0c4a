import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from fenmark.sources import split, vector
from fenmark.streaming import metrics
from tests.test_spatial import sp  # noqa: F401


def collection(path, n, crs=None, join=",\n", inner=False):
    r = random.Random(n)
    features = []
    for i in range(n):
        properties = {"i": i, "t": r.choice(["é\\", 'quote " {"type": "Feature", ', '{"type":"Feature"}', "日本", "x" * r.randrange(400)]), "n": None}
        if inner and i % 7 == 0:
            properties["held"] = {"type": "Feature", "properties": {}, "geometry": None}
        geometry = None if i % 11 == 0 else {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1 + r.random()], [i, 0]]]}
        features.append({"type": "Feature", "properties": properties, "geometry": geometry})
    head = {"type": "FeatureCollection"} | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})
    text = json.dumps(head, ensure_ascii=False)[:-1] + ', "features": [' + join.join(json.dumps(f, ensure_ascii=False, separators=r.choice([(",", ":"), (", ", ": ")])) for f in features) + "]}"
    path.write_text(text)
    return sorted(vector.geojson_features(text), key=str)


@pytest.mark.parametrize(("n", "size", "read"), [(400, 3000, 1000), (400, 700, 1 << 20), (400, 1 << 20, 300), (3, 40, 64), (0, 10, 64)])
def test_geojson_in_parts_equals_the_whole(sp, tmp_path, monkeypatch, n, size, read):  # noqa: F811
    want = collection(tmp_path / "a.geojson", n, "urn:ogc:def:crs:EPSG::27700" if n == 400 else None)
    monkeypatch.setattr(split, "READ_BYTES", read)
    reader = split.GeoJsonReader({"path": str(tmp_path / "a.geojson"), "splitBytes": str(size)})
    found = [row for part in reader.partitions() for row in reader.rows(part)]
    assert sorted(((json.dumps(a, ensure_ascii=False), g, s) for _, a, g, s in found), key=str) == want
    assert len({number for number, *_ in found}) == n


def test_a_feature_inside_another_is_its_own(tmp_path):
    want = collection(tmp_path / "a.geojson", 50, inner=True)
    reader = split.GeoJsonReader({"path": str(tmp_path / "a.geojson")})
    assert sorted(((json.dumps(a, ensure_ascii=False), g, s) for p in reader.partitions() for _, a, g, s in reader.rows(p)), key=str) == want


def test_a_large_file_is_read_by_several_tasks(sp, tmp_path):  # noqa: F811
    want = collection(tmp_path / "a.geojson", 3000)
    df = split.read_split(sp, f"file://{tmp_path}/a.geojson", split_bytes=100_000)
    assert df.rdd.getNumPartitions() >= 6
    assert sorted(((r.attributes, None if r.geom is None else bytes(r.geom), r.srid) for r in df.collect()), key=str) == want
    few = split.read_split(sp, f"file://{tmp_path}/a.geojson", ["i", "none"]).select("attributes").collect()
    assert {json.loads(r.attributes)["i"] for r in few} == set(range(3000)) and all(set(json.loads(r.attributes)) == {"i", "none"} for r in few)


def test_shapefiles_by_their_index(sp, tmp_path, monkeypatch):  # noqa: F811
    r = random.Random(2)
    shp, shx, dbf = bytes(100), bytes(100), b""
    for i in range(500):
        n = r.randrange(2, 9)
        body = struct.pack("<I4dI", 8, 0, 0, 9, 9, n) + struct.pack(f"<{2 * n}d", *[r.random() for _ in range(2 * n)]) if i % 9 else struct.pack("<I", 0)
        shx += struct.pack(">II", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">II", i + 1, len(body) // 2) + body
        dbf += (b"*" if i % 13 == 5 else b" ") + str(i).rjust(8).encode() + f"n{i}".ljust(6).encode()
    columns = b"".join(name.ljust(11, b"\0") + kind + bytes(4) + bytes([size, 0]) + bytes(14) for name, kind, size in ((b"ID", b"N", 8), (b"NAME", b"C", 6)))
    head = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 500, 32 + len(columns) + 1, 15) + columns + b"\x0d"
    for ending, raw in {"shp": shp, "shx": shx, "dbf": head + dbf, "prj": b'PROJCS["British_National_Grid"]'}.items():
        (tmp_path / f"s.{ending}").write_bytes(raw)
    want = sorted(vector.shapefile_features(shp, head + dbf, 'PROJCS["British_National_Grid"]'), key=str)
    df = split.read_split(sp, str(tmp_path / "s.shp"), split_bytes=5000)
    assert df.rdd.getNumPartitions() >= 5
    rows = df.collect()
    assert sorted(((x.attributes, None if x.geom is None else bytes(x.geom), x.srid) for x in rows), key=str) == want
    assert {x.number for x in rows} == {i for i in range(500) if i % 13 != 5} and {x.srid for x in rows} == {27700}
    monkeypatch.setattr(split, "READ_BYTES", 100)
    reader = split.ShapefileReader({"path": str(tmp_path / "s.shp")})
    assert sum(1 for p in reader.partitions() for _ in reader.rows(p)) == len(want)


def test_rates_of_a_stream_in_many_batches(sp, tmp_path):  # noqa: F811
    r, rows, at = random.Random(4), [], 1_700_000_000
    value = {"a": 0.0, "b": 100.0}
    for i in range(300):
        at += r.choice([0, 0, 1, 7])
        k = r.choice("ab")
        value[k] = 0.0 if r.random() < 0.05 else value[k] + r.random()
        rows.append((i, k, at, value[k]))
    make = lambda some: sp.createDataFrame(some, "event_id long, k string, s long, value double").select("event_id", "k", F.timestamp_seconds("s").alias("ts"), "value")
    want = sorted(map(tuple, metrics.counter_rates(make(rows), ["k"]).select("event_id", F.round("rate", 9)).collect()))
    for n in range(0, 300, 60):
        make(rows[n : n + 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sp.readStream.schema(make(rows[:1]).schema).parquet(str(tmp_path / "in"))
        q = metrics.counter_rates(stream, ["k"], idle="5 hours").writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, sp.read.parquet(str(tmp_path / "out")).select("event_id", F.round("rate", 9)).collect()))
    assert got == want and 150 < len(got) < 298


def test_a_stream_of_many_series_makes_few_calls(sp, tmp_path):  # noqa: F811
    made = sp.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 2000).cast("string").alias("k"), F.timestamp_seconds(F.col("id") + 86_400).alias("ts"), (F.col("id") * 2.0).alias("value"))
    made.withColumn("k", F.nullif("k", F.lit("7"))).write.parquet(str(tmp_path / "in"))
    stream = sp.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    q = metrics.counter_rates(stream, ["k"]).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    # states are of groups of series, at most, and not of each series
    assert q.recentProgress[0].stateOperators[0].numRowsTotal <= 1024
    got = sp.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4000 and got.select("rate").distinct().collect()[0].rate == 2.0 and got.where("k is null").count() == 2


def test_old_days_are_compacted_once_and_after_crashes(sp, tmp_path):  # noqa: F811
    root = tmp_path / "days"
    sp.range(60).select("id", (F.col("id") % 4).alias("k"), F.concat(F.lit("2024-01-0"), (F.col("id") % 6 + 1).cast("string")).alias("day")).write.partitionBy("day").parquet(str(root))
    ids = lambda: sorted(r.id for r in sp.read.parquet(str(root)).select("id").collect())
    go = lambda: metrics.compact_days(sp, f"file://{root}", "2024-01-06", ["k", "id"], days=2)
    # a crash between the two renames of a swap, and one before a swap
    (root / "day=2024-01-01").rename(root / "_old-day=2024-01-01")
    sp.read.parquet(str(root / "_old-day=2024-01-01")).write.parquet(str(root / "_new-day=2024-01-01"))
    (root / "_new-day=2024-01-01" / "_COMPACTED").write_text("")
    sp.range(3).write.parquet(str(root / "_new-day=2024-01-02"))
    assert go() == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"] and ids() == list(range(60))
    assert not list(root.glob("_*-day*")) and all((root / d / "_COMPACTED").exists() for d in ("day=2024-01-01", "day=2024-01-02", "day=2024-01-03")) and not (root / "day=2024-01-04" / "_COMPACTED").exists()
    files = {f.name for f in (root / "day=2024-01-03").glob("*.parquet")}
    assert go() and {f.name for f in (root / "day=2024-01-03").glob("*.parquet")} == files and all("zstd" in f for f in files)
    assert [(r.k, r.id) for r in sp.read.parquet(str(root / "day=2024-01-03")).collect()] == sorted((i % 4, i) for i in range(60) if i % 6 == 2)
