"""Vector tables kept between runs, valid while the source files and the specification stay the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprofile.operators.vectors import distinct_vectors, scan_tasks
from kinprofile.spec import FeatureSpec


def file_state(spark: SparkSession, folders: Sequence[str]) -> tuple[int, int, int]:
    """(files, bytes, digest of path, length and time of change) below the folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    stamp = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return tuple(files.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(stamp), F.lit(0))
    ).first())


def fingerprint(rows: DataFrame, spec: FeatureSpec, folders: Sequence[str], version: str = "") -> str:
    """Changes with the source files, the specification, the columns of ``rows`` and ``version``."""
    parts = [repr(spec), rows.schema.json(), version, file_state(rows.sparkSession, folders)]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


def stored_vectors(
    rows: DataFrame, spec: FeatureSpec, folders: Sequence[str], target: str, version: str = ""
) -> tuple[DataFrame, bool]:
    """The vector table of ``rows`` below ``target``, and whether this call had to build it.

    ``folders`` are the files that ``rows`` is read from; ``version`` names how rows are made of them, to be changed
    with that code.  A table is built aside and renamed when it is whole, so a failed run leaves none.  Tables of other
    fingerprints below ``target`` are deleted once the new one stands; give each specification a target of its own.
    """
    spark = rows.sparkSession
    vectors = distinct_vectors(rows, spec)
    jvm = spark._jvm.org.apache.hadoop.fs
    own = jvm.Path(f"{target}/vectors-{fingerprint(rows, spec, folders, version)}")
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    built = not files.exists(own)
    if built:
        staged = f"{target}/building-{uuid.uuid4().hex}"
        vectors.repartition(scan_tasks(rows, spec)).write.mode("errorifexists").parquet(staged)
        if not files.rename(jvm.Path(staged), own):
            raise OSError(f"cannot rename {staged} to {own}")
        for old in files.listStatus(own.getParent()):
            if old.getPath().getName().startswith("vectors-") and old.getPath().getName() != own.getName():
                files.delete(old.getPath(), True)
    return spark.read.schema(vectors.schema).parquet(own.toString()), built
