"""Exact-size uniform samples per group, and weighted positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.functions.scalar import uniform
from kinprofile.session import materialise

SEED = 42


def sample_rows(df: DataFrame, group: str, row_id: str, size: int, seed: int = SEED) -> DataFrame:
    """Uniform sample without replacement of at most ``size`` rows per group, reproducible.

    The sample is the ``size`` rows with the smallest hash.  A threshold known from the group
    counts removes nearly all rows before any shuffle, so a hot group sends only about
    ``size`` rows to its ranking task.  If a group should end up short (the threshold
    leaves ten standard deviations of room) the threshold is doubled until it is not.
    """
    counts = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "group-counts")
    ranked = Window.partitionBy(group).orderBy("_u", row_id)
    room = size + 10.0 * size**0.5 + 50.0
    while True:
        near = df.join(counts, group).withColumn("_u", uniform(seed, F.col(row_id))).filter(
            F.col("_u") * F.col("_n") <= F.lit(room)
        )
        picked = materialise(
            near.withColumn("_place", F.row_number().over(ranked)).filter(F.col("_place") <= size), "sample"
        )
        short = (
            counts.join(picked.groupBy(group).agg(F.count(F.lit(1)).alias("_got")), group, "left")
            .filter(F.coalesce("_got", F.lit(0)) < F.least(F.col("_n"), F.lit(size)))
        )
        if short.isEmpty():
            return picked.drop("_n", "_u", "_place")
        room *= 2


def sample_positions(sizes: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """``m`` distinct uniform row positions out of 1..n per key: (keys, position).

    ``sizes`` is (keys, n, m).  Floyd's draw, one rule for every size and always exact: step i of m draws a position
    up to n - m + i and takes n - m + i itself if the drawn one is taken already.  A key's m steps run inside its row;
    no row of the data is read.
    """
    names = [F.col(k) for k in keys]
    drawn = uniform(seed, "row", *names, F.col("i"))
    steps = sizes.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m").cast("bigint"))))
    top = F.col("n") - F.col("m") + F.col("i")
    steps = steps.withColumns({"top": top, "at": F.floor(drawn * top).cast("bigint") + 1})
    in_order = F.array_sort(F.collect_list(F.struct("i", "top", "at")))
    packed = steps.groupBy(*keys).agg(in_order.alias("steps"))  # m entries: the sample's size, not the data's
    taken = F.aggregate(
        "steps", F.array().cast("array<bigint>"),
        lambda have, s: F.array_append(have, F.when(F.array_contains(have, s["at"]), s["top"]).otherwise(s["at"])),
    )
    return packed.select(*keys, F.explode(taken).alias("position"))
