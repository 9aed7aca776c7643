"""Choosing a solution from sweep tables: curve differences, normalised metrics, pick rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.operators.metrics import best_row

MAX_CLUSTERS = 12
MAX_NOISE_PCT = 50.0
MIN_CLUSTER_PCT = 2.0
EXPECTED_K = 7


def curve_differences(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """First and second difference of an ordered curve (second centred on its point)."""
    along = Window.partitionBy(*keys).orderBy(x)
    before, after = F.lag(y).over(along), F.lead(y).over(along)
    return df.select(
        *keys, x, y, (F.col(y) - before).alias("diff1"), (after - 2 * F.col(y) + before).alias("diff2")
    )


def elbow(df: DataFrame, keys: list[str], x: str, y: str, absolute: bool = True) -> DataFrame:
    """Point of the largest second difference, absolute or signed; first point on ties."""
    bends = curve_differences(df, keys, x, y).filter(F.col("diff2").isNotNull())
    size = F.abs("diff2") if absolute else F.col("diff2")
    return best_row(bends, keys, [size.desc(), F.col(x)]).select(*keys, F.col(x).alias("elbow"))


def normalise_metrics(df: DataFrame, keys: list[str], higher: list[str], lower: list[str]) -> DataFrame:
    """Min-max normalise metrics within each key; ``lower`` is better gets inverted, constant -> 0.5."""
    within = Window.partitionBy(*keys)
    out = df
    for name in higher + lower:
        low, high = F.min(name).over(within), F.max(name).over(within)
        share = (F.col(name) - low) / F.nullif(high - low, F.lit(0.0))
        out = out.withColumn(
            f"{name}_norm",
            F.when(high == low, 0.5).otherwise(F.lit(1.0) - share if name in lower else share),
        )
    return out


def reasonable(most: int = MAX_CLUSTERS) -> Column:
    """2 to ``most`` clusters, noise below half, silhouette known."""
    return (
        F.col("n_clusters").between(2, most) & (F.col("pct_noise") < MAX_NOISE_PCT)
        & F.col("silhouette").isNotNull()
    )


def pick_density_solution(report: DataFrame, keys: list[str], param: str, middle: bool) -> DataFrame:
    """Adopted parameter per group of a DBSCAN or HDBSCAN sweep: (keys, param, rule).

    Highest silhouette among the reasonable solutions; failing that the fewest clusters
    with noise below half; failing that the middle (or first) candidate.
    """
    many = 2_147_483_647
    in_order = Window.partitionBy(*keys).orderBy(param)
    last = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2) if middle else F.lit(0)
    ranked = (
        report.withColumn("position", F.row_number().over(in_order) - 1)
        .withColumn("fallback", last)
        .withColumn(
            "tier",
            F.when(reasonable(), 1).when(reasonable(many), 2).when(F.col("position") == F.col("fallback"), 3)
            .otherwise(4),
        )
    )
    merit = F.when(F.col("tier") == 1, -F.col("silhouette")).when(F.col("tier") == 2, F.col("n_clusters").cast("double"))
    rule = F.element_at(
        F.array(F.lit("best silhouette"), F.lit("fewest clusters"), F.lit("fallback")), F.least("tier", F.lit(3))
    )
    return best_row(ranked, keys, [F.col("tier"), merit, F.col(param)]).select(*keys, param, rule.alias("rule"))


def pick_balanced_solution(report: DataFrame, keys: list[str], linkage_order: tuple[str, ...]) -> DataFrame:
    """Adopted (linkage, k) per group of an agglomerative sweep.

    Per linkage the best silhouette among solutions whose smallest cluster holds at least
    2% of the rows; linkages without one only compete when no linkage has one.
    """
    eligible = F.coalesce((F.col("min_cluster_pct") >= MIN_CLUSTER_PCT) & F.col("silhouette").isNotNull(), F.lit(False))
    turn = F.array_position(F.array(*map(F.lit, linkage_order)), F.col("linkage"))
    order = [(~eligible).cast("int"), F.col("silhouette").desc_nulls_last(), turn, F.col("k")]
    return best_row(report.withColumn("eligible", eligible), keys, order).select(*keys, "linkage", "k", "silhouette", "eligible")


def pick_k(report: DataFrame, keys: list[str]) -> DataFrame:
    """K by elbow, silhouette, Davies-Bouldin and Dunn; the Dunn peak is adopted.

    A curve too short for a second difference has its first K as elbow.
    """
    bend = elbow(report, keys, "k", "wcss").withColumnRenamed("elbow", "k_elbow")

    def peak(metric: Column, name: str) -> Column:
        return F.min_by("k", F.struct(metric.isNull(), metric, F.col("k"))).alias(name)

    return (
        report.groupBy(*keys)
        .agg(
            peak(-F.col("silhouette"), "k_silhouette"),
            peak(F.col("davies_bouldin"), "k_davies_bouldin"),
            peak(-F.col("dunn"), "k_dunn"),
            F.min("k").alias("k_first"),
        )
        .join(bend, keys, "left")
        .withColumn("k_elbow", F.coalesce("k_elbow", "k_first"))
        .drop("k_first")
        .withColumn("k_adopted", F.col("k_dunn"))
    )


def divergent(chosen: DataFrame, keys: list[str], expected: int = EXPECTED_K) -> DataFrame:
    """Groups whose Dunn peak is another K than ``expected``, with that K."""
    return chosen.filter(F.col("k_dunn") != expected).select(*keys, "k_dunn")


def premise(chosen: DataFrame, expected: int = EXPECTED_K) -> DataFrame:
    """Does one global K hold? Share of groups whose Dunn peak is ``expected``."""
    agree = F.sum((F.col("k_dunn") == expected).cast("int"))
    return chosen.agg(
        F.lit(expected).alias("expected_k"), F.count(F.lit(1)).alias("groups"), agree.alias("agreeing"),
        (agree * 2 >= F.count(F.lit(1))).alias("holds"),
    )
