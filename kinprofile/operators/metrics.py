"""Quality of partitions: Hamming silhouette, Davies-Bouldin, Dunn; all models at once.

Input is a *members* table ``(keys..., vid, label, w)``: how many rows of each distinct
vector carry each label under each model.  ``keys`` starts with the group column and may
add algorithm, parameter, replicate and so on.  Noise (label < 0) is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.operators.neighbours import extreme_distance
from kinprofile.operators.vectors import level_sums_sql, one_hot_sql
from kinprofile.session import materialise, spread
from kinprofile.spec import FeatureSpec

MIN_POINTS = 20
TILE = 64  # clusters that meet a vector in one row


def coded_members(members: DataFrame, vectors: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """Clustered members with their codes, scaled ordinals and scales."""
    scales = [f"{o.name}_scale" for o in spec.ordinals]
    features = vectors.select(
        spec.group, "vid", *spec.code_columns, *[o.scaled for o in spec.ordinals], *scales
    )
    return (
        members.filter("label >= 0").select(*keys, "vid", "label", "w").join(features, [spec.group, "vid"])
    )


def cluster_counts(coded: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """Per cluster: size, rows per level of every feature, and the centre array."""
    hits = level_sums_sql(spec)
    steps = [f"sum(CASE WHEN {o.code} = {level} THEN w ELSE 0 END)" for o in spec.ordinals for level in o.codes]
    sums = hits + [f"sum(w * {o.scaled})" for o in spec.ordinals]
    return coded.groupBy(*keys, "label").agg(
        F.sum("w").alias("size"),
        F.expr(f"array({', '.join(hits + steps)})").alias("level_rows"),
        F.expr(f"transform(array({', '.join(sums)}), x -> x / sum(w))").alias("centre"),
    )


def tiles(counts: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Clusters of a model packed into arrays of at most ``TILE``: (keys, tile, packed).

    Labels number the clusters of a model from 0, so a tile is a range of labels.  A model with thousands of clusters has
    many rows of bounded size, never one array of all of them.
    """
    tile = F.floor(F.col("label") / TILE).alias("tile")
    return counts.groupBy(*keys, tile).agg(F.collect_list(F.struct("label", *columns)).alias("packed"))


def _column_mismatches(spec: FeatureSpec, o: str) -> str:
    """Differing feature columns between a vector and all rows of the cluster struct ``o``, summed (SQL)."""
    terms = []
    for f in spec.nominals:
        at = spec.offsets[f.name]
        shown = " + ".join(f"get({o}.level_rows, {at + i})" for i in range(len(f.kept)))
        same = f"get({o}.level_rows, {f.code} + {at})"
        terms.append(f"CASE WHEN {f.code} = -1 THEN {shown} ELSE {o}.size + {shown} - 2 * {same} END")
    at = len(spec.one_hot)
    for f in spec.ordinals:
        levels = ", ".join(map(str, f.codes))
        index = f"CAST(array_position(array({levels}), {f.code}) AS INT) + {at - 1}"
        terms.append(f"{o}.size - get({o}.level_rows, {index})")
        at += len(f.codes)
    return " + ".join(terms)


def silhouette(coded: DataFrame, counts: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """Exact mean silhouette under the Hamming metric: (keys, silhouette).

    Hamming sums over columns, so the distance of a vector to a whole cluster follows from the cluster's level counts.  A
    vector meets the clusters tile by tile and keeps one row per tile: the smallest mean distance there.
    """
    apart = f"transform(packed, o -> named_struct('label', o.label, 'size', o.size, 'apart', {_column_mismatches(spec, 'o')}))"
    met = spread(coded).join(tiles(counts, keys, "size", "level_rows"), keys).withColumn("apart", F.expr(apart))
    per_member = met.select(
        *keys, "vid", "label", "w", F.expr("try_element_at(filter(apart, p -> p.label = label), 1)").alias("own"),
        F.expr("array_min(transform(filter(apart, p -> p.label <> label), p -> p.apart / p.size))").alias("b"),
    ).groupBy(*keys, "vid", "label", "w").agg(
        F.max("own.size").alias("size"), F.max("own.apart").alias("inside"), F.min("b").alias("b")
    )
    top = F.greatest(F.col("a"), F.col("b"))
    return (
        per_member.withColumn("a", F.when(F.col("size") > 1, F.col("inside") / F.greatest(F.col("size") - 1, F.lit(1))))
        .withColumn("s", F.when((F.col("size") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0))))
        .groupBy(*keys)
        .agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("silhouette"))
    )


def davies_bouldin_and_gap(coded: DataFrame, counts: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """Davies-Bouldin index and the smallest centre distance: (keys, davies_bouldin, min_gap).

    Every cluster meets the centres of its model tile by tile and keeps its worst ratio and smallest gap; no cluster
    pair leaves a row.
    """
    centred = coded.join(counts.select(*keys, "label", "centre"), [*keys, "label"])
    gap = "sqrt(aggregate(zip_with({a}, {b}, (x, c) -> (x - c) * (x - c)), 0D, (s, x) -> s + x))"
    away = F.expr(gap.format(a=one_hot_sql(spec), b="centre"))
    spread = centred.groupBy(*keys, "label").agg((F.sum(F.col("w") * away) / F.sum("w")).alias("spread"))
    centres = materialise(counts.select(*keys, "label", "centre").join(spread, [*keys, "label"]), "centres")
    apart = f"""transform(filter(packed, o -> o.label <> label), o ->
        named_struct('gap', {gap.format(a='centre', b='o.centre')}, 'spread', o.spread))"""
    worst = "array_max(transform(apart, o -> CASE WHEN o.gap > 0 THEN (spread + o.spread) / o.gap ELSE 0D END))"
    return (
        centres.join(tiles(centres, keys, "centre", "spread"), keys).withColumn("apart", F.expr(apart)).filter(F.size("apart") > 0)
        .select(*keys, "label", F.expr(worst).alias("worst"), F.expr("array_min(apart.gap)").alias("gap"))
        .groupBy(*keys, "label").agg(F.max("worst").alias("worst"), F.min("gap").alias("gap"))
        .groupBy(*keys)
        .agg(F.avg("worst").alias("davies_bouldin"), F.min("gap").alias("min_gap"))
    )


def diameters(coded: DataFrame, spec: FeatureSpec, keys: list[str]) -> DataFrame:
    """Exact largest distance inside each cluster: (keys, label, diameter)."""
    cluster = [*keys, "label"]
    far = extreme_distance(coded, coded, spec, cluster, ["vid"], farthest=True)
    return far.groupBy(*cluster).agg(F.sqrt(F.max("sq")).alias("diameter"))


def cluster_quality(
    members: DataFrame, vectors: DataFrame, spec: FeatureSpec, keys: list[str], digits: int = 4
) -> DataFrame:
    """(keys, silhouette, davies_bouldin, dunn) for every model in ``members``.

    All three are null with fewer than two clusters or fewer than 20 clustered rows.
    """
    coded = materialise(coded_members(members, vectors, spec, keys), "members")
    counts = materialise(cluster_counts(coded, spec, keys), "cluster-counts")
    usable = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.sum("size").alias("rows")).filter(
        (F.col("found") >= 2) & (F.col("rows") >= MIN_POINTS)
    )
    widest = diameters(coded, spec, keys).groupBy(*keys).agg(F.max("diameter").alias("widest"))
    scores = (
        usable.join(silhouette(coded, counts, spec, keys), keys)
        .join(davies_bouldin_and_gap(coded, counts, spec, keys), keys)
        .join(widest, keys)
    )
    dunn = F.when(F.col("widest") > 0, F.col("min_gap") / F.nullif("widest", F.lit(0.0))).otherwise(0.0)
    return members.select(*keys).distinct().join(scores, keys, "left").select(
        *keys,
        F.round("silhouette", digits).alias("silhouette"),
        F.round("davies_bouldin", digits).alias("davies_bouldin"),
        F.round(F.when(F.col("widest").isNotNull(), dunn), digits).alias("dunn"),
    )


def partition_sizes(members: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """(keys, n_clusters, n_noise, pct_noise, min_cluster_pct) of every model."""
    sizes = members.groupBy(*keys, "label").agg(F.sum("w").alias("size"))
    noise = F.sum(F.when(F.col("label") < 0, F.col("size")).otherwise(0))
    return (
        sizes.groupBy(*keys)
        .agg(
            F.count(F.when(F.col("label") >= 0, 1)).alias("n_clusters"),
            noise.alias("n_noise"),
            F.round(noise * 100.0 / F.sum("size"), digits).alias("pct_noise"),
            F.round(
                F.min(F.when(F.col("label") >= 0, F.col("size"))) * 100.0 / F.sum("size"), digits
            ).alias("min_cluster_pct"),
        )
    )


def model_report(
    members: DataFrame, vectors: DataFrame, spec: FeatureSpec, keys: list[str], digits: int = 4
) -> DataFrame:
    """The sweep table: sizes and the three quality numbers per model."""
    return partition_sizes(members, keys).join(cluster_quality(members, vectors, spec, keys, digits), keys)


def adjusted_rand(contingency: DataFrame, keys: list[str], a: str, b: str, weight: str = "cnt") -> DataFrame:
    """Adjusted Rand index from a contingency table: (keys, n_points, ari).

    1 where both partitions agree on every pair (also when both are trivial). The table is
    written first: it is small, is read three times, and may come from full row tables.
    """
    contingency = materialise(contingency.select(*keys, a, b, weight), "contingency")

    def pairs(c: Column) -> Column:
        x = c.cast("double")
        return x * (x - 1) / 2

    rows = contingency.groupBy(*keys, a).agg(F.sum(weight).alias("size"))
    cols = contingency.groupBy(*keys, b).agg(F.sum(weight).alias("size"))
    cells = contingency.groupBy(*keys).agg(
        F.sum(weight).alias("n_points"), F.sum(pairs(F.col(weight))).alias("both")
    )
    left = rows.groupBy(*keys).agg(F.sum(pairs(F.col("size"))).alias("in_a"))
    right = cols.groupBy(*keys).agg(F.sum(pairs(F.col("size"))).alias("in_b"))
    every = pairs(F.col("n_points"))
    expected = F.col("in_a") * F.col("in_b") / F.nullif(every, F.lit(0.0))
    ceiling = (F.col("in_a") + F.col("in_b")) / 2
    same = (F.col("both") == F.col("in_a")) & (F.col("both") == F.col("in_b"))
    return cells.join(left, keys).join(right, keys).select(
        *keys, "n_points",
        F.when(same, 1.0).otherwise((F.col("both") - expected) / F.nullif(ceiling - expected, F.lit(0.0))).alias("ari"),
    )


def contingency(members_a: DataFrame, members_b: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Rows per pair of labels of two label tables aligned on (keys, unit)."""
    left = members_a.select(*keys, unit, F.col("label").alias("label_a"), "w")
    right = members_b.select(*keys, unit, F.col("label").alias("label_b"))
    return left.join(right, [*keys, unit]).groupBy(*keys, "label_a", "label_b").agg(F.sum("w").alias("cnt"))


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under an explicit order (the tie-break is part of it)."""
    return (
        df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter("place = 1").drop("place")
    )
