"""Container metrics: log text to numbers, tumbling buckets over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the unit names that container statistics use.
UNIT_BYTES = {"B": 1, "kB": 1_000, "MB": 1_000_000, "GB": 1_000_000_000, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}
#: Groups over which a stream's series are dealt.
DEALS = 1024


def to_bytes(text: Column) -> Column:
    """'12.5MiB' -> 13107200.0; null for what is no size."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(float(b))) for u, b in UNIT_BYTES.items()])
    return number * factor


def parse_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, cpu_percent, memory_bytes, memory_limit_bytes, received_bytes, sent_bytes of `name|cpu%|used / limit|in / out` lines."""
    p = F.split(F.col(column), r"\|", -1)

    def pair(i: int, j: int) -> Column:
        return to_bytes(F.get(F.split(F.get(p, F.lit(i)), " / "), j))

    return lines.where(F.size(p) >= 4).select(
        F.trim(F.get(p, F.lit(0))).alias("name"),
        F.replace(F.get(p, F.lit(1)), F.lit("%"), F.lit("")).try_cast("double").alias("cpu_percent"),
        pair(2, 0).alias("memory_bytes"),
        pair(2, 1).alias("memory_limit_bytes"),
        pair(3, 0).alias("received_bytes"),
        pair(3, 1).alias("sent_bytes"),
    )


def tumbling(events: DataFrame, width: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Mean, last value and count of each event_type in buckets of `width`; a stream drops what is later than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("bucket"), "event_type", "mean", "last_value", "n")


def counter_rates(events: DataFrame, series: list[str], value: str = "value", time: str = "ts", order: str = "event_id", late: str = "30 seconds", idle: str = "1 hour", deals: int = DEALS) -> DataFrame:
    """series..., order, time and rate: for each row of a growing counter, its rise a second since the row before in its series, by time,
    then order. Rows where the counter fell (it began anew) or no time went by have none and are left out.

    events may be a stream: then the last row of each series is kept between batches, for `idle` after it came. A row that is not later
    than the last one of its series that was seen is passed over, and `late` is how far behind the latest row a series may lie before
    its state can go. Series are dealt over `deals` groups, which a stream with a checkpoint must keep: a call costs milliseconds
    whatever it is given, so there is one for a group of series and not for each.
    """
    if not events.isStreaming:
        w = Window.partitionBy(*series).orderBy(time, order)
        seconds = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1_000_000.0
        rate = F.try_divide(F.col(value) - F.lag(value).over(w), F.nullif(seconds, F.lit(0.0)))
        return events.select(*series, order, time, rate.alias("rate")).where("rate >= 0")

    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    wait = pd.Timedelta(idle).value // 1_000_000
    columns = list(dict.fromkeys([*series, order, time, value]))

    def micros(rows: pd.DataFrame) -> np.ndarray:
        return rows[time].astype("datetime64[us]").astype("int64").to_numpy()

    def keep(state, last: pd.DataFrame, come: np.ndarray) -> None:
        """The last rows of a group's series, but for those that are idle and did not come now."""
        now, until = state.getCurrentWatermarkMs(), micros(last) // 1000 + wait
        stay = come | (until > now)
        if not stay.any():
            if state.exists:
                state.remove()
            return
        table = pa.Table.from_pandas(last[stay], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(until[stay].min()), now + 1))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        if state.hasTimedOut:
            keep(state, old, np.zeros(len(old), bool))
            return
        rows = pd.concat([p[columns] for p in parts], ignore_index=True)
        every = rows if old is None else pd.concat([old, rows], ignore_index=True)
        code, known = every.groupby(series, dropna=False, sort=False).ngroup().to_numpy(), len(every) - len(rows)
        at, fresh = micros(every), np.ones(len(every), bool)
        if known:
            place = np.full(code.max() + 1, -1)
            place[code[:known]] = np.arange(known)
            met = known + np.flatnonzero(place[code[known:]] >= 0)
            last, ids = place[code[met]], every[order].to_numpy()
            fresh[met] = (at[met] > at[last]) | (at[met] == at[last]) & (ids[met] > ids[last])
        every = every.assign(_code=code, _at=at, _new=np.arange(len(every)) >= known)[fresh].sort_values(["_code", "_at", order], kind="stable")
        code, at, v = every["_code"].to_numpy(), every["_at"].to_numpy(), every[value].to_numpy(dtype=float, na_value=np.nan)
        same = code[1:] == code[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.diff(v) / (np.diff(at) / 1_000_000.0)
        good = np.flatnonzero(same & np.isfinite(rate) & (rate >= 0))
        yield every.iloc[good + 1][list(dict.fromkeys([*series, order, time]))].assign(rate=rate[good])
        final = np.r_[~same, True]
        keep(state, every.loc[final, columns], np.isin(code[final], code[every["_new"].to_numpy()]))

    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*series, order, time]) + ", rate double"
    rows = events.select(*columns).where(F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*series), F.lit(deals)))
    return rows.groupBy("_deal").applyInPandasWithState(advance, schema, "last binary", "append", "EventTimeTimeout")


def retained(df: DataFrame, time: str, now: Column, days: int = 30) -> DataFrame:
    """Rows not older than `days` before now."""
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def long_metrics(stats: DataFrame) -> DataFrame:
    """name, metric, value: a row for each number of parse_stats()."""
    wide = [c for c in stats.columns if c != "name"]
    return stats.unpivot("name", wide, "metric", "value").where("value is not null")


def drop_old_days(spark, folder: str, last: str, days: int = 30) -> list[str]:
    """Removes `day=YYYY-MM-DD` partitions below folder that lie more than `days` before the day `last`; gives their names."""
    from datetime import date, timedelta

    least = (date.fromisoformat(last) - timedelta(days=days)).isoformat()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("day=") and n.removeprefix("day=") < least)
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}"), True)
    return old


def compact_days(spark: SparkSession, folder: str, last: str, order: list[str], days: int = 7, files: int = 1, level: int = 9) -> list[str]:
    """Rewrites the `day=YYYY-MM-DD` partitions below folder that lie more than `days` before the day `last`, in order of `order`, with a
    stronger codec; gives their names. Partitions that were rewritten already are left alone.

    A day is written aside, its rows are counted, and then the two folders change places. Safe to run again after a crash at any point:
    what was written aside but not swapped in is made anew, and a swap that was begun is ended. Only for the moment of the swap itself
    is a day not there for readers.
    """
    from datetime import date, timedelta

    least = (date.fromisoformat(last) - timedelta(days=days)).isoformat()
    jvm, root = spark._jvm, folder.rstrip("/")
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    names = {s.getPath().getName() for s in fs.listStatus(path(""))}
    # swaps that a crash cut off: the old folder was moved away first
    for old in sorted(n for n in names if n.startswith("_old-")):
        day = old.removeprefix("_old-")
        if day not in names:
            fs.rename(path(f"_new-{day}"), path(day))
            names.add(day)
        fs.delete(path(old), True)
    done = sorted(n for n in names if n.startswith("day=") and n.removeprefix("day=") < least)
    for day in done:
        if fs.exists(path(f"{day}/_COMPACTED")):
            continue
        fs.delete(path(f"_new-{day}"), True)
        rows = spark.read.parquet(f"{root}/{day}")
        made = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
        made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(f"{root}/_new-{day}")
        if spark.read.parquet(f"{root}/_new-{day}").count() != rows.count():
            raise ValueError(f"{day}: rows were lost on the way")
        fs.create(path(f"_new-{day}/_COMPACTED"), True).close()
        fs.rename(path(day), path(f"_old-{day}"))
        fs.rename(path(f"_new-{day}"), path(day))
        fs.delete(path(f"_old-{day}"), True)
    return done
