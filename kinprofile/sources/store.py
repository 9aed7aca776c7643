"""Accumulating result store: one table per kind, replaced by (algorithm, group) in atomic commits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("metrics", "chosen", "labels", "profile", "stability")
PART = ["_commit", "_algorithm", "_group"]
ATTEMPTS = 20


@dataclass(frozen=True)
class ResultStore:
    """Writing an algorithm's results replaces only its own (algorithm, group) partitions, all at once or not at all.

    A write puts its rows under a commit folder of their own, writes a manifest (which commit holds each algorithm and
    group) beside the last one, and makes it valid by renaming it to the next version number; a rename never replaces a
    version, so of two writers the later one starts again from the other's manifest.  Readers take the last version: a
    write that fails or is still running is invisible.  ``vacuum`` deletes what no valid manifest names.

    Algorithm and group stay typed columns of the data; the folders are named by text copies with a prefix that no
    reader takes for a number, so "01", "1" and "1e3" remain three groups and a string group remains one.
    """

    path: str
    group: str

    def write(self, kind: str, algorithm: str, df: DataFrame) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown result kind {kind}")
        spark, commit = df.sparkSession, f"c-{uuid.uuid4().hex}"
        rows = f"{self.path}/{kind}/rows/_commit={commit}"
        named = df.withColumns({
            "algorithm": F.lit(algorithm), "_algorithm": F.lit(f"is {algorithm}"),
            "_group": F.concat(F.lit("is "), F.coalesce(F.col(self.group).cast("string"), F.lit("null"))),
        })
        named.write.mode("errorifexists").partitionBy("_algorithm", "_group").parquet(rows)
        if not _children(spark, rows):  # no rows, nothing to replace
            return
        new = spark.read.schema(named.schema).parquet(rows).select("_algorithm", "_group").distinct()
        new = new.select(F.lit(commit).alias("_commit"), "_algorithm", "_group")
        for _ in range(ATTEMPTS):
            version, held = self._manifest(spark, kind)
            own = new if held is None else held.join(new, ["_algorithm", "_group"], "left_anti").select(PART).union(new)
            staged = f"{self.path}/{kind}/staged/{uuid.uuid4().hex}"
            own.write.mode("errorifexists").parquet(staged)
            if _rename(spark, staged, f"{self.path}/{kind}/versions/{version + 1:012d}"):
                return
        raise RuntimeError(f"{ATTEMPTS} other writers of {kind} were faster")

    def _manifest(self, spark: SparkSession, kind: str) -> tuple[int, DataFrame | None]:
        versions = _children(spark, f"{self.path}/{kind}/versions")
        if not versions:
            return 0, None
        last = max(versions)
        schema = ", ".join(f"{c} string" for c in PART)
        return int(last), spark.read.schema(schema).parquet(f"{self.path}/{kind}/versions/{last}")

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """All stored rows; columns written by only some algorithms are null elsewhere."""
        _, held = self._manifest(spark, kind)
        if held is None:
            raise FileNotFoundError(f"nothing stored under {self.path}/{kind}")
        rows = f"{self.path}/{kind}/rows"
        live = [f"{rows}/_commit={r['_commit']}" for r in held.select("_commit").distinct().collect()]  # one row per write
        stored = spark.read.option("mergeSchema", True).option("basePath", rows).parquet(*sorted(live))
        return stored.join(held, PART, "left_semi").drop(*PART)

    def vacuum(self, spark: SparkSession, kind: str) -> int:
        """Delete older manifests and the rows of replaced or failed writes; returns how many folders went.

        For times without writers or readers of older versions.
        """
        base, (version, held) = f"{self.path}/{kind}", self._manifest(spark, kind)
        live = set() if held is None else {f"_commit={r['_commit']}" for r in held.select("_commit").distinct().collect()}
        gone = [f"{base}/rows/{c}" for c in _children(spark, f"{base}/rows") if c not in live]
        gone += [f"{base}/versions/{v}" for v in _children(spark, f"{base}/versions") if int(v) != version]
        gone += [f"{base}/staged/{s}" for s in _children(spark, f"{base}/staged")]
        for folder in gone:
            files, target = _files(spark, folder)
            files.delete(target, True)
        return len(gone)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    files, target = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()] if files.exists(target) else []


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; false if the target exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, to = _files(spark, target)
    files.mkdirs(to.getParent())
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(hadoop.Path(source)), files.makeQualified(to), plain)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception) or files.exists(to):
            return False
        raise
    return True
