"""Cluster profiles: top category per variable with its share and lift against the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.operators.vectors import categories
from kinprofile.spec import FeatureSpec


def category_counts(
    members: DataFrame, vectors: DataFrame, spec: FeatureSpec, keys: list[str]
) -> DataFrame:
    """Rows per (keys, label, variable, value)."""
    names = [f.name for f in spec.features]
    labelled = members.select(*keys, "vid", "label", F.col("w").alias("rows")).join(
        categories(vectors, spec).select(spec.group, "vid", *names), [spec.group, "vid"]
    )
    return (
        labelled.unpivot([*keys, "label", "rows"], names, "variable", "value")
        .groupBy(*keys, "label", "variable", "value")
        .agg(F.sum("rows").alias("rows"))
    )


def cluster_profile(
    members: DataFrame, vectors: DataFrame, spec: FeatureSpec, keys: list[str], digits: tuple[int, int, int] = (1, 0, 2)
) -> DataFrame:
    """Long profile: (keys, label, n, pct, variable, top_value, top_pct, lift).

    ``digits`` rounds the cluster share, the category share and the lift. Ties for the
    top category go to the alphabetically first. Noise keeps its own rows (label -1).
    """
    counts = category_counts(members, vectors, spec, keys)
    in_cluster = Window.partitionBy(*keys, "label", "variable")
    overall = Window.partitionBy(*keys, "variable")
    of_value = Window.partitionBy(*keys, "variable", "value")
    shares = (
        counts.withColumn("n", F.sum("rows").over(in_cluster))
        .withColumn("total", F.sum("rows").over(overall))
        .withColumn("value_total", F.sum("rows").over(of_value))
        .withColumn("place", F.row_number().over(in_cluster.orderBy(F.col("rows").desc(), F.col("value"))))
        .filter("place = 1")
    )
    share = F.col("rows") / F.col("n")
    return shares.select(
        *keys,
        F.col("label").cast("int").alias("label"),
        "n",
        F.round(F.col("n") * 100.0 / F.col("total"), digits[0]).alias("pct"),
        "variable",
        F.col("value").alias("top_value"),
        F.round(share * 100.0, digits[1]).alias("top_pct"),
        F.round(share / (F.col("value_total") / F.col("total")), digits[2]).alias("lift"),
    )


def wide_profile(profile: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """One row per cluster: "value (nn%)" and lift per variable, noise named "Ruído"."""
    named = profile.withColumn(
        "cluster", F.when(F.col("label") < 0, "Ruído").otherwise(F.concat(F.lit("Cluster "), F.col("label")))
    ).withColumn("shown", F.format_string("%s (%.0f%%)", "top_value", "top_pct"))
    return (
        named.groupBy(*keys, "label", "cluster", "n", "pct")
        .pivot("variable", [f.name for f in spec.features])
        .agg(F.first("shown").alias("top"), F.first("lift").alias("lift"))
    )
