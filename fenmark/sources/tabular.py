"""Readers of lookup tables and table dumps."""

from __future__ import annotations

import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.operators.validation import identifier

#: Rows that a reader hands on at once.
BATCH_ROWS = 10_000


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """A table of SQLite files as string columns; SQLite types are per value, so callers cast."""
    for name in (table, *columns):
        identifier(name)

    def rows(batches):
        for b in batches:
            for raw in b.column("content"):
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:  # SQLite opens paths only; the file lives within this call
                    f.write(raw.as_py())
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    cursor = db.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM "{table}"')
                    while found := cursor.fetchmany(BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else str(r[i]) for r in found], pa.string()) for i in range(len(columns))], names=columns)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"`{c}` string" for c in columns))


#: What a backslash and a letter stand for in a COPY body.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unescaped(c: Column) -> Column:
    """A field of a COPY body: \\N is null, backslash escapes are resolved from left to right."""
    # pieces between double backslashes are resolved apart, so that none is read twice
    pieces = F.split(c, r"\\\\", -1)

    def piece(x: Column) -> Column:
        for letter, made in ESCAPES.items():
            x = F.replace(x, F.lit("\\" + letter), F.lit(made))
        return F.replace(x, F.lit("\\"), F.lit(""))  # before any other character it stands for that character

    return F.when(c != r"\N", F.array_join(F.transform(pieces, piece), "\\"))


def read_dump(spark: SparkSession, path: str, columns: list[str], table: str | None = None) -> DataFrame:
    """The COPY body of one table of a plain or gzipped table dump as string columns, in the order of `columns`.

    A dump holds one file's lines in order; the body is what stands between `COPY name (..) FROM stdin;` and `\\.`. Without a table
    the file must hold one. A file is read by one task, as a part of it would not know which table it is in: a gzipped one line by
    line, a plain one as one value of 2 GB at most. A table that is not there is an error, and so are columns that its header does
    not name.
    """

    def header(line: str) -> tuple[str, list[str]] | None:
        m = re.fullmatch(r"COPY ([^ ]+) \((.*)\) FROM stdin;", line)
        return (m[1].replace('"', ""), [c.strip().strip('"') for c in m[2].split(",")]) if m else None

    heads = {h for r in spark.read.text(path).where(F.col("value").startswith("COPY ")).distinct().collect() if (h := (lambda x: x and (x[0], tuple(x[1])))(header(r.value)))}
    found = {name: given for name, given in heads if table is None or table in (name, name.rpartition(".")[2])}
    if len(found) != 1:
        raise ValueError(f"{table or 'one table'} expected in the dump, found {sorted(name for name, _ in heads)}")
    name, given = next(iter(found.items()))
    if missing := [c for c in columns if c not in given]:
        raise ValueError(f"{name} has no columns {missing}")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = False
        for b in batches:
            kept = []
            for line in b.column(0).to_pylist():
                if not inside:
                    inside = bool((h := header(line)) and h[0] == name)
                elif line == "\\.":
                    inside = False
                else:
                    kept.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["value"])

    # a plain file is not split either, as a part would not know what it is in
    whole = spark.read.option("wholetext", False).format("text").load(path)
    if not path.endswith(".gz"):
        whole = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_lines, "value string")
    parts = F.split("value", "\t", -1)
    return whole.mapInArrow(body, "value string").select(*[unescaped(F.get(parts, F.lit(given.index(c)))).alias(c) for c in columns])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("content"):
            text = raw.as_buffer()
            at, size = 0, 1 << 22
            while at < text.size:
                end = min(at + size, text.size)
                if end < text.size:
                    cut = bytes(text.slice(at, end - at)).rfind(b"\n")
                    if cut < 0:
                        size *= 2
                        continue
                    end = at + cut + 1
                lines = bytes(text.slice(at, end - at)).decode().split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines[:-1] if lines[-1] == "" else lines, pa.string())], names=["value"])
                at = end


def latest_lookup(lookups: DataFrame, name: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows of a lookup's largest version, with their place in pos; of rows that share `key`, which must be a number, the first.
    Values of key that are no numbers are null, and count as one."""
    version = lookups.where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(1))).first()[0]
    rows = explode_lookup(lookups, name, version, schema)
    if key is None:
        return rows
    rest = [c for c in rows.columns if c != key]
    rows = rows.withColumn(key, F.col(key).try_cast("double").try_cast("long"))
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def sample(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The n rows of smallest `order`, for a first look at a table."""
    return df.orderBy(order).limit(n)


def explode_lookup(lookups: DataFrame, name: str, version: int, schema: str) -> DataFrame:
    """The rows of one lookup (one table row with a JSON array in data), with their place in pos. A missing lookup is an error."""
    one = lookups.where((F.col("name") == name) & (F.col("version") == version)).limit(1)
    if one.isEmpty():
        raise ValueError(f"lookup {name} version {version} not found")
    return one.select(F.posexplode(F.from_json("data", f"array<struct<{schema}>>")).alias("pos", "r")).select("pos", "r.*")
