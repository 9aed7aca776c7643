"""Agreement of several labellings of the same units by adjusted Rand index."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprofile.operators.metrics import adjusted_rand
from kinprofile.session import materialise

MIN_POINTS = 50


def agreement(
    labels: DataFrame, group: str, unit: str, algorithms: list[str], min_points: int = MIN_POINTS
) -> DataFrame:
    """(group, algorithm_a, algorithm_b, n_points, ari, aligned) for every pair of algorithms.

    ``labels`` is (group, algorithm, unit, label, w).  One shuffle brings all labels of a
    unit together; the pairs are then read off that single row, so no self-join is needed.
    Units where either side is noise are left out; below ``min_points`` rows ARI is null.
    ``aligned`` is false when one side labels units the other does not.
    """
    wide = labels.groupBy(group, unit, "w").pivot("algorithm", algorithms).agg(F.min("label"))
    pairs = [
        F.struct(
            F.lit(a).alias("algorithm_a"), F.lit(b).alias("algorithm_b"),
            F.col(a).alias("label_a"), F.col(b).alias("label_b"),
        )
        for a, b in combinations(algorithms, 2)
    ]
    keys = [group, "algorithm_a", "algorithm_b"]
    cells = materialise(
        wide.select(group, "w", F.explode(F.array(*pairs)).alias("p")).select(group, "w", "p.*")
        .groupBy(*keys, "label_a", "label_b").agg(F.sum("w").alias("cnt")),
        "agreement-cells",
    )
    overview = cells.groupBy(*keys).agg(
        (F.sum((F.col("label_a").isNull() != F.col("label_b").isNull()).cast("int")) == 0).alias("aligned")
    )
    scored = adjusted_rand(cells.filter("label_a >= 0 and label_b >= 0"), keys, "label_a", "label_b")
    return overview.join(scored, keys, "left").select(
        *keys, F.coalesce("n_points", F.lit(0).cast("bigint")).alias("n_points"),
        F.when(F.col("n_points") >= min_points, F.col("ari")).alias("ari"), "aligned",
    )


def agreement_matrix(table: DataFrame, group: str, algorithms: list[str]) -> DataFrame:
    """One row per group, one column ``a_vs_b`` per pair."""
    names = [f"{a}_vs_{b}" for a, b in combinations(algorithms, 2)]
    return (
        table.withColumn("pair", F.concat_ws("_vs_", "algorithm_a", "algorithm_b"))
        .groupBy(group).pivot("pair", names).agg(F.first("ari"))
    )


def pair_summary(table: DataFrame) -> DataFrame:
    """Mean ARI over groups per pair and how many groups show moderate agreement (> 0.3)."""
    return table.groupBy("algorithm_a", "algorithm_b").agg(
        F.avg("ari").alias("mean_ari"), F.count(F.when(F.col("ari") > 0.3, 1)).alias("moderate_groups")
    )
