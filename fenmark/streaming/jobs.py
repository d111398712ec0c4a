"""Job messages as a stream: parse, validate, assess in batches, keep what is bad, and set apart the jobs that make a batch fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.functions.loads import Settings
from fenmark.operators import validation
from fenmark.plans import nutrient
from fenmark.session import ensure_spatial, remove, tables_go, written

MESSAGE = "reference string, boundaryGeojson struct<boundaryGeometryOriginal: string, intersectingEdps: array<struct<label: string, n2k_site_name: string>>>, developmentTypes array<string>, housingUnits int, peopleCount int, wasteWaterTreatmentWorksId string, traceId string"
SUPPORTED = ("27700", "4326")
GRID = 27700
#: Bits of a job's hash by which a batch that fails is halved.
BITS = 64


def _declared() -> Column:
    boundary = F.col("boundaryGeojson.boundaryGeometryOriginal")
    return F.regexp_extract(F.coalesce(F.get_json_object(boundary, "$.crs.properties.name"), F.lit("")), r"(?i)EPSG:{1,2}(\d+)$", 1)


def parse(messages: DataFrame, column: str = "value") -> DataFrame:
    """messages with the message's fields, and error: null, or the code of what is wrong. A notification envelope is opened."""
    inner = F.coalesce(F.get_json_object(column, "$.Message"), F.col(column))
    out = messages.withColumn("_m", F.from_json(inner, MESSAGE)).select("*", "_m.*").drop("_m")
    boundary, code = F.col("boundaryGeojson.boundaryGeometryOriginal"), _declared()
    bad: Column = F.coalesce(
        F.when(F.length(column) > 262_144, "oversize"),
        F.when(F.col("reference").isNull() & boundary.isNull(), "not_json"),
        F.when(~F.coalesce(F.col("reference"), F.lit("")).rlike(r"^NRF-\d{6}$"), "bad_reference"),
        F.when(boundary.isNull(), "no_boundary"),
        F.when((code != "") & ~code.isin(*SUPPORTED), "unsupported_crs"),
        F.when(F.coalesce(F.col("housingUnits"), F.lit(0)) < 1, "bad_housing_units"),
    )
    return out.withColumn("error", bad)


def parse_sites(messages: DataFrame, column: str = "value") -> DataFrame:
    """parse(), with the boundary as geom on the national grid. A boundary without a declared system is on the grid already. Further
    errors: damaged_boundary, and the codes of validation.geometry_errors(), joined by commas."""
    ensure_spatial(messages.sparkSession)
    code = _declared()
    out = parse(messages, column)
    read = F.when(F.col("error").isNull(), st.from_geojson("boundaryGeojson.boundaryGeometryOriginal"))
    out = out.withColumn("geom", st.transform(read, F.when(code == "", F.lit(GRID)).otherwise(code.cast("int")), GRID))
    found = F.array_join(validation.geometry_errors(), ",")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("geom").isNull(), "damaged_boundary"), F.nullif(found, F.lit(""))))


def sites(rows: DataFrame) -> DataFrame:
    """The sites of rows of parse_sites() without an error, one a job, as nutrient.prepare() takes them."""
    made = validation.with_job_fields(rows.where("error is null"), F.col("reference"), F.col("developmentTypes"), F.col("housingUnits"))
    return made.select("id", "name", "dwelling_category", "source", "dwellings", "geom")


def assess_nutrients(ref: nutrient.Reference, s: Settings = Settings()) -> Callable[[DataFrame], DataFrame]:
    """For run(): rows of parse_sites() to the impact summary, each job by itself."""
    return lambda rows: nutrient.assess(nutrient.prepare(sites(rows), job="id"), ref, s, key="id", job="id")


def settle(rows: DataFrame, assess: Callable[[DataFrame], DataFrame], sink: str, failed: str, attempts: int = 2) -> None:
    """assess(rows) written below sink. Where that fails, the jobs are halved by bits of their reference's hash until those at fault are
    alone; these are tried `attempts` times and then written below failed (reference, value, error, attempts), and all others complete.

    A job is at fault only if assess works without any rows: else the error is raised, as a store that is away is no job's fault. Both
    folders are made anew, so that a batch that is run again leaves its results once. For k jobs at fault among n some k * log2(n)
    parts are assessed.
    """
    spark = rows.sparkSession
    remove(spark, sink)
    remove(spark, failed)

    def tried(part: DataFrame, name: str) -> Exception | None:
        try:
            assess(part).write.mode("overwrite").parquet(f"{sink}/part={name}")
        except Exception as e:  # noqa: BLE001  whatever it was, it is told apart below
            remove(spark, f"{sink}/part={name}")
            return e
        return None

    todo = [("a", rows, 0)]
    while todo:
        name, part, depth = todo.pop()
        error = tried(part, name)
        if error is None:
            continue
        bit = F.shiftright(F.xxhash64("reference"), depth).bitwiseAND(1)
        count = part.agg(F.count_distinct("reference").alias("jobs"), F.count_if(bit == 1).alias("ones"), F.count_if(bit == 0).alias("zeros")).first()
        if count.jobs > 1 and depth < BITS:
            if count.ones and count.zeros:
                todo += [(f"{name}{b}", part.where(bit == b), depth + 1) for b in (0, 1)]
            else:
                todo.append((name, part, depth + 1))
            continue
        assess(part.limit(0)).write.format("noop").mode("overwrite").save()
        tries = 1
        while error is not None and tries < attempts:
            error, tries = tried(part, name), tries + 1
        if error is not None:
            text = str(error).strip().splitlines()[0][:1000] if str(error).strip() else type(error).__name__
            dead = part.select("reference", "value", F.lit(text).alias("error"), F.lit(tries).alias("attempts"))
            dead.write.mode("overwrite").parquet(f"{failed}/part={name}")


def run(
    spark: SparkSession,
    source: str,
    checkpoint: str,
    assess: Callable[[DataFrame], DataFrame],
    sink: str,
    rejected: str,
    redelivery: str = "1 hour",
    read: Callable[[DataFrame], DataFrame] = parse,
    failed: str | None = None,
    attempts: int = 2,
    poll: str | None = None,
    revision: str | None = None,
):
    """Consumes JSON lines below source: results of assess(valid rows) to sink, bad messages to rejected, jobs that make assess fail to
    `failed` (without it they end the query). Stops when nothing is left, or with poll (as "5 seconds") looks again for ever; gives the
    query.

    A message counts as done when its batch's checkpoint is written. A batch that is run again overwrites its own folders, so results
    come once. Of valid messages a reference that comes again within `redelivery` is passed over; a bad message does not stand in the
    way of its corrected form. With `revision`, a column of read(), messages of one reference that differ in it are all assessed, and who
    reads the sink chooses among them: which one comes first would be left open. Tables that assess writes on its way go after each batch.
    """
    rows = spark.readStream.schema("value string").text(source).withColumn("received_at", F.current_timestamp())
    named = [F.lit(" "), F.coalesce(F.col(revision).cast("string"), F.lit(""))] if revision else []
    # bad messages are told apart by their text
    job = F.when(F.col("error").isNull(), F.concat(F.lit("job "), "reference", *named)).otherwise(F.concat(F.lit("bad "), F.coalesce("value", F.lit(""))))
    rows = read(rows).withColumn("_job", job).withWatermark("received_at", redelivery).dropDuplicatesWithinWatermark(["_job"]).drop("_job")

    def batch(df: DataFrame, number: int) -> None:
        with tables_go(spark):
            df = written(df)
            if number and df.isEmpty():
                return  # the batch that ends a stream only moves its watermark; the first one gives the sinks their schema
            df.where("error is not null").select("value", "error").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = df.where("error is null")
            if failed:
                settle(good, assess, f"{sink}/batch={number}", f"{failed}/batch={number}", attempts)
            else:
                assess(good).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
    if not poll:
        query.awaitTermination()
    return query
