"""Assessments that compute only what no earlier run has: results are kept by what they depend on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.functions import geometry as st
from fenmark.session import remove, written

KEYS = "key string, run string"


class ResultStore:
    """Results below root, a folder that driver and executors share, by generation of the reference data and by settings.

    A run writes its results first and the keys it has done after them; results whose run has no such keys are those of a run that was
    lost, and are not read. So a run can be stopped anywhere, and runs may go side by side: what two of them did at once is there twice,
    and one is taken.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, settings: object, generation: str) -> str:
        plain = asdict(settings) if is_dataclass(settings) else settings
        name = hashlib.sha256(json.dumps([generation, plain], sort_keys=True, default=str).encode()).hexdigest()
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def assess(self, sites: DataFrame, inputs: list[str], assess: Callable[[DataFrame], DataFrame], settings: object, generation: str) -> tuple[DataFrame, int]:
        """sites (geom and others) with the columns that assess adds, and how many sites had no result before it: those
        that share their geometry and inputs count each, and are computed once.

        assess takes (key, geom, *inputs), one row for each distinct geometry and inputs that has no result yet, and gives rows with key
        and its own columns; each row's result must depend on that row alone, the settings and the reference data. Sites it gives no row
        for go, as out of scope, and are remembered as such. Sites with a null geometry are computed like others.
        """
        folder = self._folder(settings, generation)
        key = F.sha2(F.concat(F.coalesce(st.hash_key("geom"), F.lit("none")), F.to_json(F.struct(*inputs)) if inputs else F.lit("")), 256)
        keyed = written(sites.withColumn("key", key))
        todo = keyed.select("key", "geom", *inputs)
        if self._exists(f"{folder}/keys"):
            todo = todo.join(self.spark.read.schema(KEYS).parquet(f"{folder}/keys"), "key", "left_anti")
        computed = todo.count()
        todo = written(todo.dropDuplicates(["key"]))
        if computed or not self._exists(f"{folder}/keys"):
            run = uuid.uuid4().hex
            assess(todo).write.parquet(f"{folder}/results/run={run}")
            todo.select("key", F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/keys")
        done = self.spark.read.schema(KEYS).parquet(f"{folder}/keys").groupBy("key").agg(F.min("run").alias("run"))
        # names of runs are text without digits only by chance, so their kind is told
        found = self.spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results").withColumn("run", F.col("run").cast("string"))
        found = found.join(done, ["key", "run"]).drop("run")
        mine = [c for c in found.columns if c == "key" or c not in keyed.columns]
        return keyed.join(found.select(*mine), "key").drop("key"), computed

    def forget(self, keep: list[tuple[object, str]]) -> None:
        """Removes all results but those of the given (settings, generation)."""
        kept = {self._folder(*k).rpartition("/")[2] for k in keep}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            for s in fs.listStatus(p):
                if s.getPath().getName() not in kept:
                    remove(self.spark, s.getPath().toString())
