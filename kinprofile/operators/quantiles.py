"""Exact grouped quantiles that never gather a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here the
values are counted first; where a group has too many distinct values, the searched rank
is bracketed by bucket totals, round by round, until few values remain in the bracket.
The answer is always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.session import materialise


def _ranks(totals: DataFrame, keys: list[str], probs: Sequence[float], carried: Sequence[str] = ()) -> DataFrame:
    """The two neighbouring ranks (from 0) and the mixing share of every probability."""
    spot = F.col("prob") * (F.col("n") - 1).cast("double")
    return (
        totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select(*keys, "prob", F.floor(spot).alias("lo"), (spot - F.floor(spot)).alias("share"), "n", *carried)
        .withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1))
        .drop("n")
    )


def _pick(counts: DataFrame, keys: list[str], column: str, ranks: DataFrame) -> DataFrame:
    """Read the ranks off cumulative counts; ``skipped`` rows lie below the counted values."""
    inside = Window.partitionBy(*keys, "prob").orderBy(column)
    run = (
        ranks.join(counts, [*keys, "prob"])
        .withColumn("upto", F.sum("weight").over(inside) + F.col("skipped"))
    )
    low = F.min(F.when(F.col("upto") > F.col("lo"), F.col(column)))
    high = F.min(F.when(F.col("upto") > F.col("hi"), F.col(column)))
    return run.groupBy(*keys, "prob", "share").agg(low.alias("low"), high.alias("high")).select(
        *keys, "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value")
    )


def weighted_quantiles(
    values: DataFrame, keys: list[str], column: str, weight: str, probs: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles of a small (value, weight) table: (keys, prob, value)."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum(weight).alias("weight"))
    totals = counts.groupBy(*keys).agg(F.sum("weight").alias("n"))
    spread = counts.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "skipped", F.lit(0).cast("bigint")
    )
    return _pick(spread, keys, column, _ranks(totals, keys, probs))


def _narrow(counts: DataFrame, keys: list[str], column: str, ranks: DataFrame, buckets: int = 1024) -> DataFrame:
    """One refinement: cut each bracket into equal-width buckets and keep those holding the ranks.

    The bucket totals combine on the map side, so a round moves at most ``buckets`` rows per
    (key, prob) and task.
    """
    span = F.col("to") - F.col("from")
    place = F.when(span > 0, F.least(F.floor((F.col(column) - F.col("from")) / span * buckets), F.lit(buckets - 1)))
    totals = (
        counts.join(ranks, keys)
        .filter((F.col(column) >= F.col("from")) & (F.col(column) <= F.col("to")))
        .groupBy(*keys, "prob", "lo", "hi", "share", "skipped", F.coalesce(place, F.lit(0)).alias("bucket"))
        .agg(
            F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("distinct_values"),
            F.min(column).alias("from"), F.max(column).alias("to"),
        )
    )
    upto = F.sum("weight").over(Window.partitionBy(*keys, "prob").orderBy("bucket")) + F.col("skipped")
    return (
        totals.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("weight"))
        .filter((F.col("upto") > F.col("lo")) & (F.col("before") <= F.col("hi")))
        .groupBy(*keys, "prob", "lo", "hi", "share")
        .agg(
            F.min("from").alias("from"), F.max("to").alias("to"), F.min("before").alias("skipped"),
            F.sum("distinct_values").alias("distinct_values"),
        )
    )


def grouped_quantiles(
    df: DataFrame, keys: list[str], column: str, probs: Sequence[float], window_rows: int = 1_000_000,
    weight: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of ``column`` per ``keys``: (keys, prob, value).

    ``weight`` names a row count where the input is already counted. Counts per value
    shuffle by (key, value), so a hot key spreads over all tasks.
    """
    counts = materialise(
        df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias(column))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("weight")),
        "value-counts",
    )
    return counted_quantiles(counts, keys, column, probs, window_rows)


def counted_quantiles(
    counts: DataFrame, keys: list[str], column: str, probs: Sequence[float], window_rows: int = 1_000_000
) -> DataFrame:
    """The same from a written table with one row per (keys, value) and its ``weight``.

    Windows run only over brackets of at most ``window_rows`` distinct values per (key, prob).
    """
    sizes = counts.groupBy(*keys).agg(
        F.sum("weight").alias("n"), F.count(F.lit(1)).alias("distinct_values"),
        F.min(column).alias("from"), F.max(column).alias("to"),
    ).withColumn("skipped", F.lit(0).cast("bigint"))
    carried = ["from", "to", "skipped", "distinct_values"]
    ranks = materialise(_ranks(sizes, keys, probs, carried), "ranks")
    while not ranks.filter(F.col("distinct_values") > window_rows).isEmpty():
        ranks = materialise(_narrow(counts, keys, column, ranks.drop("distinct_values")), "ranks")
    narrowed = counts.join(ranks.select(*keys, "prob", "from", "to", "skipped"), keys).filter(
        (F.col(column) >= F.col("from")) & (F.col(column) <= F.col("to"))
    )
    return _pick(
        narrowed.select(*keys, "prob", column, "weight", "skipped"), keys, column,
        ranks.select(*keys, "prob", "lo", "hi", "share"),
    )
