"""Session helpers: shared scratch folder and lineage cutting.

Iterative operators never keep their state only on executors.  They write it as a
Parquet table into the shared folder the cluster names in ``spark.checkpoint.dir``
and read it back.  A lost executor then costs one task, not the whole loop, and the
file size gives Catalyst a measured number on which to decide for or against a
broadcast join; the package gives no broadcast hints of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system on which Spark resolves it, for readers besides Spark's own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to driver and executors, taken from the session's settings."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if configured:
        return qualified(spark, configured)
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CONF} to a folder all executors can reach")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder per process, for sessions in a single JVM only."""
    return tempfile.mkdtemp(prefix="kinprofile-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/kinprofile/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    ``files`` spreads the rows evenly over that many files, where later work per row is heavy.
    """
    path = scratch_path(df.sparkSession, name)
    out = df if files is None else df.repartition(files)
    out.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for small written tables ahead of heavy work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_apart(df: DataFrame) -> int:
    """Partitions for keys whose work is much larger than their bytes; adaptive execution leaves a given number as it is."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism
