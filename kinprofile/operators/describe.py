"""Descriptive summaries per group: imputation, scaling, medians, modes, shares, densities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprofile.operators.quantiles import counted_quantiles, grouped_quantiles
from kinprofile.session import materialise, spread

REACH = 9.0


def value_counts(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Rows per (group, variable, value), written once: the only pass over the rows that
    medians, modes, shares and densities need."""
    doubles = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns])
    return materialise(
        doubles.unpivot([group], list(columns), "variable", "value").filter("value IS NOT NULL")
        .groupBy(group, "variable", "value").agg(F.count(F.lit(1)).alias("rows")),
        "value-counts",
    )


def medians(counts: DataFrame, group: str) -> DataFrame:
    """Exact interpolated median: (group, variable, value)."""
    weighted = counts.withColumnRenamed("rows", "weight")
    return counted_quantiles(weighted, [group, "variable"], "value", (0.5,)).drop("prob")


def modes(counts: DataFrame, group: str) -> DataFrame:
    """Most frequent value (lowest on ties): (group, variable, value, share)."""
    top = counts.groupBy(group, "variable").agg(
        F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("value"),
        (F.max("rows") / F.sum("rows")).alias("share"),
    )
    return top.select(group, "variable", "value", "share")


def usable_columns(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Which columns hold a value in which group: (group, variable, n_valid, usable).

    A column without any value in a group takes no part in that group's imputation, scaling or model; it has a row here
    with ``usable`` false instead of silently missing.  One pass, counts only; an empty table gives no row.
    """
    counts = df.groupBy(group).agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([group], list(columns), "variable", "n_valid").withColumn("usable", F.col("n_valid") > 0)


def impute(df: DataFrame, group: str, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fill nulls with the group's median or mode; a column with no value in a group stays null.

    Only the small table of fill values meets the rows; it is written first so the join is
    planned from its size and the rows are not shuffled by group.
    """
    counts = value_counts(df, group, [*continuous, *categorical])
    fills = []
    if continuous:
        fills.append(medians(counts.filter(F.col("variable").isin(*continuous)), group))
    if categorical:
        fills.append(modes(counts.filter(F.col("variable").isin(*categorical)), group).drop("share"))
    table = fills[0] if len(fills) == 1 else fills[0].unionByName(fills[1])
    names = [*continuous, *categorical]
    wide = materialise(table.groupBy(group).pivot("variable", names).agg(F.first("value")), "fills").select(
        group, *[F.col(c).alias(f"{c}_fill") for c in names]
    )
    return df.join(wide, group, "left").withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_fill")) for c in names}
    ).drop(*[f"{c}_fill" for c in names])


def standardise(df: DataFrame, group: str, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Subtract the group mean and divide by the population deviation (zero deviation -> 1)."""
    stats = materialise(
        df.groupBy(group).agg(
            *[F.avg(c).alias(f"{c}_avg") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
        ),
        "moments",
    )
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col(f"{c}_avg"))
        / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))
        for c in columns
    }
    return df.join(stats, group).withColumns(scaled).drop(*[f"{c}_{s}" for c in columns for s in ("avg", "std")])


def group_summary(
    df: DataFrame, group: str, continuous: Sequence[str], categorical: Sequence[str],
    labels: Mapping[str, Mapping[int, str]], digits: int = 1, counts: DataFrame | None = None,
) -> DataFrame:
    """One row per group: rounded medians and "label (nn%)" of the modes ("-" without values).

    ``counts`` are the ``value_counts`` of at least these columns, if they are there already.
    """
    counts = value_counts(df, group, [*continuous, *categorical]) if counts is None else counts
    middle = (
        medians(counts.filter(F.col("variable").isin(*continuous)), group).withColumn("shown", F.round("value", digits).cast("string"))
        .select(group, "variable", "shown")
    )
    named = F.lit(None).cast("string")
    for variable, table in labels.items():
        pairs = [F.lit(x) for item in table.items() for x in item]
        named = F.when(
            F.col("variable") == variable, F.element_at(F.create_map(*pairs), F.col("value").cast("int"))
        ).otherwise(named)
    top = modes(counts.filter(F.col("variable").isin(*categorical)), group).select(
        group, "variable",
        F.format_string("%s (%d%%)", F.coalesce(named, F.col("value").cast("string")), F.round(F.col("share") * 100).cast("int")).alias("shown"),
    )
    names = [*continuous, *categorical]
    wide = middle.unionByName(top).groupBy(group).pivot("variable", names).agg(F.first("shown"))
    return wide.fillna("-", list(categorical)).withColumns({c: F.col(c).cast("double") for c in continuous})


def category_shares(df: DataFrame, group: str, column: str, table: Mapping[int, str]) -> DataFrame:
    """Percent of every named category per group, absent ones included: (group, code, label, pct)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).cast("int").alias("code")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    totals = counts.groupBy(group).agg(F.sum("rows").alias("total"))
    entries = [F.struct(F.lit(code).alias("code"), F.lit(label).alias("label")) for code, label in table.items()]
    grid = totals.select(group, "total", F.explode(F.array(*entries)).alias("c")).select(group, "total", "c.*")
    return grid.join(counts, [group, "code"], "left").select(
        group, "code", "label", (F.coalesce("rows", F.lit(0)) * 100.0 / F.col("total")).alias("pct")
    )


def pooled_percentiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact percentiles over all groups together: (variable, prob, value)."""
    return grouped_quantiles(counts, ["variable"], "value", probs, weight="rows")


def density_curves(
    df: DataFrame, group: str, columns: Sequence[str], points: int = 400, limits: tuple[float, float] = (0.005, 0.995),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Gaussian density per group and variable on a common grid: (group, variable, i, x, density).

    Scott bandwidth (sample deviation times n^(-1/5)); every curve is divided by its own
    peak.  The x range are pooled percentiles; groups with one row or one value are skipped.
    Values are counted first, so repeated values cost once; ``counts`` are the ``value_counts`` of at least these columns,
    if they are there already.
    """
    keys = [group, "variable"]
    values = value_counts(df, group, columns) if counts is None else counts.filter(F.col("variable").isin(*columns))
    means = materialise(
        values.groupBy(*keys).agg(
            F.sum("rows").alias("n"), (F.sum(F.col("rows") * F.col("value")) / F.sum("rows")).alias("mean"),
            F.min("value").alias("low"), F.max("value").alias("high"),
        ).filter((F.col("n") > 1) & (F.col("high") - F.col("low") > 1e-8 + 1e-5 * F.abs("low"))),
        "density-means",
    )
    off = F.col("value") - F.col("mean")
    moments = values.join(means, keys).groupBy(*keys, "n").agg(
        F.sqrt(F.sum(F.col("rows") * off * off) / F.greatest(F.col("n") - 1, F.lit(1))).alias("std")
    )
    ends = pooled_percentiles(values, limits).groupBy("variable").agg(
        F.min("value").alias("x_min"), F.max("value").alias("x_max")
    )
    flat = F.col("x_min") == F.col("x_max")
    frame = materialise(
        moments.join(ends, "variable").select(
            *keys, (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
            F.when(flat, F.col("x_min") - 0.5).otherwise(F.col("x_min")).alias("x_min"),
            F.when(flat, F.col("x_max") + 0.5).otherwise(F.col("x_max")).alias("x_max"),
        ),
        "density-frame",
    )
    place = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / F.lit(float(points - 1))
    z = (F.col("x") - F.col("value")) / F.col("bandwidth")
    # A value adds less than 1e-17 of its own peak beyond REACH bandwidths, so it only visits the points within.
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    first = F.greatest(F.lit(0), F.ceil((F.col("value") - REACH * F.col("bandwidth") - F.col("x_min")) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("value") + REACH * F.col("bandwidth") - F.col("x_min")) / step)).cast("int")
    raw = (
        spread(values).join(frame, keys)
        .withColumns({"first": first, "last": last}).filter("first <= last")
        .withColumn("i", F.explode(F.sequence("first", "last")))
        .withColumn("x", place)
        .groupBy(*keys, "i")
        .agg(F.sum(F.col("rows") * F.exp(-z * z / 2)).alias("raw"))
    )
    grid = frame.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", place)
    curves = materialise(
        grid.join(raw, [*keys, "i"], "left").select(*keys, "i", "x", F.coalesce("raw", F.lit(0.0)).alias("raw")), "density-raw"
    )
    return curves.join(curves.groupBy(*keys).agg(F.max("raw").alias("peak")), keys).select(
        *keys, "i", "x",
        F.when(F.col("peak") > 0, F.col("raw") / F.nullif("peak", F.lit(0.0))).otherwise(F.col("raw")).alias("density"),
    )
