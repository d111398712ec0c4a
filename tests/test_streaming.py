import json

from pyspark.sql import functions as F

from fenmark.streaming import jobs, metrics


def message(ref, **more):
    boundary = json.dumps({"type": "Polygon", "coordinates": []} | more.pop("boundary", {}))
    return json.dumps({"reference": ref, "boundaryGeojson": {"boundaryGeometryOriginal": boundary}, "housingUnits": 3, "peopleCount": 4} | more)


def test_jobs_once_and_rejects(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = message("NRF-000001")
    lines = [good, good, json.dumps({"Message": message("NRF-000002")}), "nonsense", message("BAD"), message("NRF-000003", housingUnits=0), message("NRF-000004", boundary={"crs": {"properties": {"name": "EPSG:9999"}}})]
    (src / "a.txt").write_text("\n".join(lines))
    paths = {k: str(tmp_path / k) for k in ("cp", "out", "bad")}
    run = lambda: jobs.run(spark, str(src), paths["cp"], lambda df: df.select("reference", "housingUnits"), paths["out"], paths["bad"])
    run()
    run()
    assert sorted(r.reference for r in spark.read.parquet(paths["out"]).collect()) == ["NRF-000001", "NRF-000002"]
    assert sorted(r.error for r in spark.read.parquet(paths["bad"]).collect()) == ["bad_housing_units", "bad_reference", "not_json", "unsupported_crs"]


def test_stats_and_stream_equals_batch(spark, tmp_path):
    got = metrics.parse_stats(spark.createDataFrame([("web|12.5%|1.5MiB / 2GiB|3kB / 4B",), ("short",)], "value string")).first()
    assert list(got) == ["web", 12.5, 1572864.0, 2147483648.0, 3000.0, 4.0]
    path = str(tmp_path / "events")
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 40).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") * 1.5).alias("value"))
    rows.coalesce(1).write.parquet(path)
    stream = metrics.tumbling(spark.readStream.schema(rows.schema).parquet(path))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("buckets")) == key(metrics.tumbling(spark.read.parquet(path)))
