"""Shared by the corpus operators: table reads, Arrow column mapping, written steps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.session import materialise, scratch_path


SLICE = 1000  # rows whose values a worker holds as Python objects

#: Functions that drop what an operator keeps in a worker process between its tasks.
HELD: list[Callable[[], None]] = []


def settle(own: Callable[[], None] | None = None) -> None:
    """Drop what tasks of other operators left in this worker: Spark uses a process again for the next stage.

    Memory of their Arrow batches that the pool only keeps for later goes back as well.
    """
    for drop in HELD:
        if drop is not own:
            drop()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns called like one of ``names`` in any case, so that an operator may add its own."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(
    df: DataFrame, source: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], added: T.StructType,
    kept_by: str = "",
) -> DataFrame:
    """Append columns computed in Python from the values of ``source``, ``SLICE`` rows of an Arrow batch at a time.

    ``make()`` runs once per task and returns a function from the list of values to the new Arrow columns.
    Columns of ``df`` with a name of ``added`` are replaced; all others pass through untouched.  ``kept_by`` names the
    module whose state a worker may keep.
    """
    kept = without(df, added.fieldNames())
    schema = T.StructType(kept.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(next((d for d in HELD if d.__module__ == kept_by), None))
        columns = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                new = columns(batch.column(source).to_pylist())
                for name in added.fieldNames():
                    batch = batch.append_column(name, new[name])
                yield batch

    return kept.mapInArrow(run, schema)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of an operator that no later step reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Whether Spark deletes the shuffle files of a finished execution at once, not when the driver collects its objects.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is planned and run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Steps:
    """Tables an operator writes on its way; ``drop`` deletes one as soon as nothing reads it.

    A written table needs the shuffles behind it no more, so their files go with the write.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        with setting(self.spark, SHUFFLE_CLEANUP, "true"):
            df.write.mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.keep = getattr(self, "keep", [])
        self.keep.append(out)  # an id is only unique while its object lives
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            discard(self.spark, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, label)``, label the smallest node reachable.

    Every round hooks each node to its smallest neighbour (a grouped minimum, combined before the shuffle, so a
    hub with a third of all edges costs one row per task), shortens the chains, and contracts the edges to the
    labels; contracted edges that meet are dropped.  State is written every round.  Nodes without an edge, loops
    and null ends give no row beyond their label.
    """
    spark = edges.sparkSession
    steps = Steps(spark)
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null")
    live = steps.write(ends.where("a < b").distinct(), "edges")
    labels = steps.write(
        live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("label", F.col("node")), "labels"
    )
    while not live.isEmpty():
        hook = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
            hook = steps.write(hook, "hooks")
        near = lambda end, h: h.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))
        moved = live.join(near("a", hook), "a", "left").join(near("b", hook), "b", "left").select(
            F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")
        )
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        next_live = steps.write(moved, "edges")
        next_labels = steps.write(
            labels.join(hook.select(F.col("node").alias("label"), "up"), "label", "left").select(
                "node", F.coalesce("up", "label").alias("label")
            ),
            "labels",
        )
        steps.drop(live)
        steps.drop(labels)
        live, labels = next_live, next_labels
    return labels


__all__ = ["Steps", "add_columns", "components", "discard", "materialise", "scratch_path", "table", "without"]
