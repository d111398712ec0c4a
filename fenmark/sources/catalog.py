"""Versioned tables on a shared folder: version= partitions, a row of pointer files, load history.

All tables of a load are written under new versions first; readers see them when the next pointer file appears, in one rename.

Loads are fenced. A lock is a numbered file that only one load can make, and its number, the token, grows. The next pointer file can be
made once only as well, by a load that holds the latest token and saw the pointer before it: so a load that was stopped for so long
that another took over cannot undo what that one did. A version that is being loaded has a mark beside it until its rows are checked.
"""

from __future__ import annotations

import contextlib
import inspect
import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_VERSIONS = 2
#: Pointer and lock files that are left for a look at what happened.
KEPT_FILES = 20
HISTORY = "run_id string, table string, version int, rows long, status string, detail string, loaded_at timestamp, data_version string, token long"


@dataclass(frozen=True)
class Manifest:
    """One reference-data version: its name, and for each table the path of its rows."""

    data_version: str
    tables: dict[str, str]

    def __post_init__(self) -> None:
        if not isinstance(self.data_version, str) or not self.data_version:
            raise ValueError("a manifest needs a data_version")
        if not isinstance(self.tables, dict) or not self.tables:
            raise ValueError("a manifest needs tables")
        if wrong := sorted(str(t) for t, p in self.tables.items() if not (isinstance(t, str) and t and isinstance(p, str) and p)):
            raise ValueError(f"a manifest needs a path for each table: {wrong}")

    @classmethod
    def parse(cls, text: str) -> Manifest:
        doc = json.loads(text)
        return cls(doc.get("data_version", ""), doc.get("tables", {}))


class Busy(RuntimeError):
    """Another load is running."""


class Stale(RuntimeError):
    """Another load has taken over, or has moved the pointer."""


class Catalog:
    """Tables below root, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _read(self, name: str) -> dict:
        if name == "pointer.json":
            return self.pointer()
        p = f"{self.root}/{name}"
        return self._content(p) if self.fs.exists(self._path(p)) else {}

    def _content(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))

    def _replace(self, name: str, content: dict) -> None:
        """A small file, written whole under another name and renamed over the old one. The pointer moves by its own way."""
        if name == "pointer.json":
            self._point(content, self._last("pointers"), None, "")
        else:
            self._put(f"{self.root}/{name}", content, "OVERWRITE")

    def _put(self, path: str, content: dict, how: str) -> None:
        side = self._path(f"{self.root}/.side-{uuid.uuid4().hex}")
        out = self.fs.create(side, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, how)
        try:
            context.rename(side, self._path(path), options)
        except Exception:
            self.fs.delete(side, False)
            raise

    def _made(self, path: str, content: dict) -> bool:
        """Makes a file that is not there yet, whole; False if it is there."""
        self.fs.mkdirs(self._path(path).getParent())
        try:
            self._put(path, content, "NONE")
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def _numbers(self, folder: str) -> list[int]:
        p = self._path(f"{self.root}/{folder}")
        if not self.fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _last(self, folder: str) -> int:
        return max(self._numbers(folder), default=0)

    def _file(self, folder: str, number: int, end: str = "json"):
        return f"{self.root}/{folder}/{number:012d}.{end}"

    def _point(self, versions: dict[str, int], seen: int, token: int | None, run: str) -> None:
        """Moves the pointer from its file number `seen` to the next. Stale if there is a later lock than token, or another next file."""
        if token is not None and self._last("locks") != token:
            raise Stale(f"a later load than {token} has taken over")
        if not self._made(self._file("pointers", seen + 1), {"versions": versions, "token": token, "run_id": run}):
            raise Stale(f"the pointer moved on from {seen}")
        for n in self._numbers("pointers")[:-KEPT_FILES]:
            self.fs.delete(self._path(self._file("pointers", n)), False)

    def pointer(self) -> dict[str, int]:
        last = self._last("pointers")
        return self._content(self._file("pointers", last))["versions"] if last else {}

    def _listed(self, table: str) -> list[str]:
        p = self._path(f"{self.root}/{table}")
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _loading(self, table: str) -> set[int]:
        """Versions whose rows are not checked yet, or never were."""
        return {int(n.rpartition("-")[2]) for n in self._listed(table) if n.startswith(".loading-")}

    def versions(self, table: str) -> list[int]:
        """Whole versions, largest last; one that no pointer ever named may be among them."""
        return sorted({int(n.split("=")[1]) for n in self._listed(table) if n.startswith("version=")} - self._loading(table))

    def active(self, table: str) -> int:
        """The pointer's version, else the largest whole one, else 1."""
        return self.pointer().get(table) or max(self.versions(table), default=1)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The active or the given version; its partition only is scanned."""
        v = self.active(table) if version is None else version
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/version={v}")

    @contextlib.contextmanager
    def single_flight(self, stale_after_s: float = 6 * 3600, beat_s: float = 60.0) -> Iterator[int]:
        """Only one load at a time: gives its token. While the block runs, its lock is renewed every beat_s; one that was not renewed for
        stale_after_s, as its driver was lost, is taken over. Busy otherwise. A block whose lock was taken over ends as usual, but
        cannot move the pointer."""
        last, now = self._last("locks"), datetime.now(UTC).timestamp()
        if last and not self.fs.exists(self._path(self._file("locks", last, "done"))) and now - self._beat(last) <= stale_after_s:
            raise Busy(f"another load holds lock {last} of {self.root}")
        token = last + 1
        if not self._made(self._file("locks", token), {"at": now}):
            raise Busy(f"another load took lock {token} of {self.root}")
        ended = threading.Event()

        def renew() -> None:
            while not ended.wait(beat_s):
                self.fs.create(self._path(self._file("locks", token, "beat")), True).close()

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield token
        finally:
            ended.set()
            thread.join()
            self.fs.create(self._path(self._file("locks", token, "done")), True).close()
            for n in self._numbers("locks")[:-KEPT_FILES]:
                for end in ("json", "beat", "done"):
                    self.fs.delete(self._path(self._file("locks", n, end)), False)

    def _beat(self, lock: int) -> float:
        paths = [self._path(self._file("locks", lock, end)) for end in ("json", "beat")]
        return max(self.fs.getFileStatus(p).getModificationTime() / 1000 for p in paths if self.fs.exists(p))

    def promote(self, tables: dict[str, DataFrame], check=None, cluster: dict[str, str] | None = None, expected: dict[str, int] | None = None, data_version: str | None = None, group_bytes: int | None = None) -> str:
        """Writes every table as a new version, runs check on each, and makes all of them active at once; with a failure none is, and
        ValueError names all failures. Gives the run id.

        check(table name, new frame, old frame or None) gives failures; one with a fourth parameter gets a function there that reads a
        table by its name, in its new version if this load has one, else in its active one. A table whose written rows are not as many
        as `expected` says has failed. cluster names a column to sort a table by, group_bytes the size of row groups. Busy if another load is running, Stale if one took over meanwhile. Whatever ends the load, its
        rows go and the history tells of it.
        """
        with self.single_flight() as token:
            return self._promote(token, tables, check, cluster or {}, expected or {}, data_version, group_bytes)

    def _promote(self, token: int, tables: dict[str, DataFrame], check, cluster: dict[str, str], expected: dict[str, int], data_version: str | None, group_bytes: int | None) -> str:
        run, seen, before = uuid.uuid4().hex, self._last("pointers"), self.pointer()
        new = {}
        for name in tables:
            lost = self._loading(name)  # of loads that were lost, as the lock is ours; one may live on, so its number is not used again
            new[name] = max([*self.versions(name), *lost], default=0) + 1
            for v in lost:
                self._drop(name, v)
            self.fs.mkdirs(self._path(f"{self.root}/{name}"))
            self.fs.create(self._path(f"{self.root}/{name}/.loading-{new[name]}"), True).close()
        try:
            for name, df in tables.items():
                out = df.repartitionByRange(cluster[name]).sortWithinPartitions(cluster[name]) if name in cluster else df
                writer = out.withColumn("created_at", F.current_timestamp()).write
                if group_bytes:
                    writer = writer.option("parquet.block.size", group_bytes)
                writer.parquet(f"{self.root}/{name}/version={new[name]}")
            failures = self._failures(new, before, check, expected)
            if failures:
                raise ValueError("; ".join(failures))
            rows = {name: self.read(name, v).count() for name, v in new.items()}
            self._point(before | new, seen, token, run)
        except BaseException as e:
            for name, v in new.items():
                self._drop(name, v)
            self._record(run, new, "failed", str(e)[:4000] or type(e).__name__, token=token, data_version=data_version)
            if self._last("locks") != token:
                raise Stale(f"a later load than {token} has taken over") from e
            raise
        for name, v in new.items():
            self.fs.delete(self._path(f"{self.root}/{name}/.loading-{v}"), False)
        self._record(run, new, "success", "", rows, token, data_version)
        for name in tables:
            # the version that was active stays, and of the others the latest, KEPT_VERSIONS in all with the new one
            others = [v for v in self.versions(name) if v < new[name] and v != before.get(name)]
            keep = KEPT_VERSIONS - 1 - (name in before)
            for v in others[: len(others) - keep]:
                self._drop(name, v)
        return run

    def _failures(self, new: dict[str, int], before: dict[str, int], check, expected: dict[str, int]) -> list[str]:
        failures: list[str] = []
        lookup = lambda table: self.read(table, new.get(table))
        wide = check is not None and len(inspect.signature(check).parameters) > 3
        for name, v in new.items():
            if check:
                old = self.read(name, before[name]) if name in before else None
                failures += check(name, self.read(name, v), old, *([lookup] if wide else []))
            if name in expected and (n := self.read(name, v).count()) != expected[name]:
                failures.append(f"table={name} rule=rows_written detail={n} instead of {expected[name]}")
        return failures

    def _drop(self, table: str, version: int) -> None:
        for name in (f"version={version}", f".loading-{version}"):
            self.fs.delete(self._path(f"{self.root}/{table}/{name}"), True)

    def _record(self, run: str, new: dict[str, int], status: str, detail: str, counts: dict[str, int] | None = None, token: int | None = None, data_version: str | None = None) -> None:
        now = datetime.now(UTC)
        rows = [(run, t, v, (counts or {}).get(t), status, detail, now, data_version, token) for t, v in new.items()]
        self.spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("append").parquet(f"{self.root}/history")

    def history(self) -> DataFrame:
        if not self.fs.exists(self._path(f"{self.root}/history")):
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).parquet(f"{self.root}/history")

    def status(self, tables: list[str]) -> DataFrame:
        """table, version, n (rows of the active version; null where there is none) and empty, for each of tables."""
        def one(t: str) -> DataFrame:
            if not self.versions(t):
                return self.spark.sql("SELECT {t} AS table, CAST(NULL AS INT) AS version, CAST(NULL AS BIGINT) AS n", t=t)
            return self.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(self.active(t)).alias("version"), "n")

        return reduce(DataFrame.unionByName, map(one, tables)).withColumn("empty", F.coalesce(F.col("n") == 0, F.lit(True)))

    def generation(self) -> datetime | None:
        """When the last successful load was; what was cached before is old."""
        return self.history().where("status = 'success'").agg(F.max("loaded_at")).first()[0]

    def reconcile(self) -> list[str]:
        """Notes `reconciled` for tables whose active version has no successful load in the history, as after a driver was lost
        between the rename and the record; gives their names."""
        known = {(r.table, r.version) for r in self.history().where("status in ('success', 'reconciled')").select("table", "version").distinct().collect()}
        lost = {t: v for t, v in self.pointer().items() if (t, v) not in known}
        if lost:
            self._record(uuid.uuid4().hex, lost, "reconciled", "the pointer was ahead of the history", {t: self.read(t, v).count() for t, v in lost.items()})
        return sorted(lost)

    def rollback(self, tables: list[str] | None = None) -> tuple[dict[str, int], dict[str, str]]:
        """Moves pointers one version back: (moved, skipped with reasons). Default: the tables of the last successful load. Busy while a
        load is running."""
        with self.single_flight() as token:
            seen, before = self._last("pointers"), self.pointer()
            if tables is None:
                last = self.history().where("status = 'success'").agg(F.max_by("run_id", "loaded_at")).first()[0]
                tables = [r.table for r in self.history().where(F.col("run_id") == last).select("table").distinct().collect()]
            moved, skipped = {}, {}
            for t in tables:
                back = self.active(t) - 1
                if back in self.versions(t):
                    moved[t] = back
                else:
                    skipped[t] = f"version {back} is not there"
            if moved:
                run = uuid.uuid4().hex
                self._point(before | moved, seen, token, run)
                self._record(run, moved, "success", "rollback", {t: self.read(t, v).count() for t, v in moved.items()}, token, None)
            return moved, skipped

    def provenance(self, tables: list[str]) -> DataFrame:
        """table, version, run_id, data_version, loaded_at: of each of tables the load that its active version came from; nulls where
        none is known. A version keeps the load it was written by when the pointer moves back to it."""
        wanted = self.spark.createDataFrame([(t, self.active(t) if self.versions(t) else None) for t in tables], "table string, version int")
        loads = self.history().where("status = 'success' and detail <> 'rollback'")
        loads = loads.groupBy("table", "version").agg(F.max_by(F.struct("run_id", "data_version", "loaded_at"), "loaded_at").alias("l"))
        return wanted.join(loads, ["table", "version"], "left").select("table", "version", "l.*")

    def stamped(self, results: DataFrame, tables: list[str]) -> DataFrame:
        """results with provenance, an array of (table, version, run_id, data_version) of the tables they were made from, by name."""
        rows = sorted(self.provenance(tables).collect())  # one row a table
        made = [F.struct(F.lit(r.table).alias("table"), F.lit(r.version).alias("version"), F.lit(r.run_id).cast("string").alias("run_id"), F.lit(r.data_version).cast("string").alias("data_version")) for r in rows]
        return results.withColumn("provenance", F.array(*made))

    def source_tag(self, path: str) -> str:
        """A tag of a file in any store that Hadoop reads: it changes with its length and its time of change."""
        p = self._path(path)
        s = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
        return f"{s.getLen()}-{s.getModificationTime()}"

    def needs_reload(self, what: str | Manifest, etag: str | None = None) -> bool:
        """Whether a table's source has another tag than was noted at its last load; of a manifest, whether any of its tables is not
        active in a version that was loaded as that data version."""
        if isinstance(what, Manifest):
            return bool(self.stale_tables(what))
        return self._read("etags.json").get(what) != etag

    def stale_tables(self, manifest: Manifest) -> list[str]:
        """The manifest's tables whose active version is of another data version, or of none."""
        known = {r.table: r.data_version for r in self.provenance(sorted(manifest.tables)).collect()}  # one row a table
        return sorted(t for t in manifest.tables if known.get(t) != manifest.data_version)

    def note_etag(self, table: str, etag: str) -> None:
        """Notes the tag of a table's source. Busy while a load is running."""
        with self.single_flight():
            self._replace("etags.json", self._read("etags.json") | {table: etag})
