"""DBSCAN over weighted distinct vectors: every group and every eps in the same jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.operators.neighbours import blocks_within, kth_distance, neighbour_counts, spread_labels
from kinprofile.operators.quantiles import weighted_quantiles
from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec

MIN_SAMPLES = 10
CANDIDATES = 18
CONTEXT_PERCENTILES = (0.50, 0.70, 0.85)


def k_distances(counts: DataFrame, spec: FeatureSpec, k: int = MIN_SAMPLES) -> DataFrame:
    """k-distance per vector (own row counted, as a search over the fitted rows does)."""
    return kth_distance(counts, spec, F.lit(k))


def sorted_curve(kdist: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The ascending k-distance curve as runs of rows: (group, kdist, first_place, last_place)."""
    along = Window.partitionBy(spec.group).orderBy("kdist")
    values = kdist.groupBy(spec.group, "kdist").agg(F.sum("w").alias("w"))
    last = F.sum("w").over(along)
    return values.select(spec.group, "kdist", (last - F.col("w") + 1).alias("first_place"), last.alias("last_place"))


def eps_candidates(kdist: DataFrame, counts: DataFrame, spec: FeatureSpec, picks: int = CANDIDATES) -> DataFrame:
    """Candidate radii per group: evenly spaced picks from the tail of the distinct
    k-distances plus three percentiles, rounded to 4 places, distinct and positive.

    Where every vector has k equal rows or more, all k-distances are 0.  Such a group takes the smallest positive
    distances that occur (rounded up, so that a radius reaches its own distance), as many as ``picks``; a group
    whose rows are all equal takes 1.  So every group has a candidate however many rows repeat.
    """
    group = spec.group
    values = kdist.groupBy(group, "kdist").agg(F.sum("w").alias("w"))
    tail = max(picks * 4, 40)
    per_group = Window.partitionBy(group)
    ranked = (
        values.withColumn("size", F.least(F.count(F.lit(1)).over(per_group), F.lit(tail)))
        .withColumn("from_top", F.row_number().over(per_group.orderBy(F.col("kdist").desc())))
        .filter(F.col("from_top") <= tail)
        .withColumn("position", F.col("size") - F.col("from_top"))
    )
    spaced = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(picks - 1)),
        lambda i: F.floor(i.cast("double") * (F.col("size") - 1).cast("double") / F.lit(float(picks - 1))),
    ))
    tail_picks = ranked.filter(F.array_contains(spaced, F.col("position").cast("bigint"))).select(group, "kdist")
    context = weighted_quantiles(values, [group], "kdist", "w", CONTEXT_PERCENTILES).select(
        group, F.col("value").alias("kdist")
    )
    found = (
        tail_picks.unionByName(context)
        .select(group, F.round("kdist", 4).alias("eps"))
        .filter("eps > 0")
        .distinct()
    )
    groups = values.select(group).distinct()
    without = groups.join(found.select(group).distinct(), group, "left_anti")
    occurring = counts.filter("dist > 0").join(without, group, "left_semi").select(
        group, (F.ceil(F.col("dist") * 10_000) / 10_000).alias("eps")
    ).distinct()
    upward = Window.partitionBy(group).orderBy("eps")
    smallest = occurring.withColumn("place", F.row_number().over(upward)).filter(F.col("place") <= picks).drop("place")
    constant = without.join(smallest.select(group).distinct(), group, "left_anti").withColumn("eps", F.lit(1.0))
    return found.unionByName(smallest).unionByName(constant)


def knee(kdist: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Radius at the sharpest bend of the sorted k-distance curve, per group.

    The curve has one point per row, but its second difference is non-zero only next to a
    change of value, so the whole search runs on the distinct values and their weights.
    """
    group = spec.group
    values = kdist.groupBy(group, "kdist").agg(F.sum("w").alias("w"))
    along = Window.partitionBy(group).orderBy("kdist")
    runs = (
        values.withColumn("before", F.lag("kdist").over(along))
        .withColumn("after", F.lead("kdist").over(along))
        .withColumn("place", F.sum("w").over(along))
        .withColumn("rows", F.sum("w").over(Window.partitionBy(group)))
    )
    rise = F.coalesce(F.col("after") - F.col("kdist"), F.lit(0.0))
    fall = F.coalesce(F.col("kdist") - F.col("before"), F.lit(0.0))
    # interior points of the row curve: the last row of a run (rise) and its first (fall)
    points = runs.select(
        group, "rows", "kdist",
        F.explode(F.when(F.col("w") == 1, F.array(F.struct(F.col("place").alias("at"), (rise - fall).alias("bend"))))
                  .otherwise(F.array(
                      F.struct(F.col("place").alias("at"), rise.alias("bend")),
                      F.struct((F.col("place") - F.col("w") + 1).alias("at"), (-fall).alias("bend")),
                  ))).alias("p"),
    ).filter((F.col("p.at") > 1) & (F.col("p.at") < F.col("rows")))
    best = points.groupBy(group).agg(F.max_by("kdist", F.struct(F.col("p.bend"), -F.col("p.at"))).alias("bend_at"))
    ninetieth = weighted_quantiles(values, [group], "kdist", "w", (0.90,)).select(group, F.col("value").alias("p90"))
    top = values.groupBy(group).agg(F.max("kdist").alias("top"))
    return (
        top.join(ninetieth, group).join(best, group, "left")
        .select(
            group,
            F.when(F.col("bend_at") > 0, F.col("bend_at")).when(F.col("p90") > 0, F.col("p90"))
            .when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("knee_eps"),
        )
    )


def dbscan(
    vectors: DataFrame, counts: DataFrame, radii: DataFrame, spec: FeatureSpec, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """Labels for every (group, eps): (group, eps, vid, w, label), noise = -1.

    A core vector has at least ``min_samples`` rows within eps, its own included.  Clusters
    are numbered by their smallest core row id; a border vector takes the smallest label
    among its core neighbours.
    """
    group, keys = spec.group, [spec.group, "eps"]
    radii = materialise(radii.select(*keys), "radii")
    degree = (
        counts.join(radii, group)
        .filter(F.col("dist") <= F.col("eps"))
        .groupBy(*keys, "vid", "w", "first_row").agg(F.sum("cnt").alias("degree"))
    )
    nodes = materialise(degree.withColumn("core", F.col("degree") >= min_samples), "degrees")
    links = materialise(blocks_within(vectors, radii, spec), "blocks")
    cores = nodes.filter("core").select(*keys, "vid", F.col("first_row").alias("label"))
    parts = materialise(spread_labels(cores, links, keys), "components")
    order = Window.partitionBy(*keys).orderBy("label")
    numbered = parts.select(*keys, "label").distinct().withColumn("number", F.row_number().over(order) - 1)
    core_labels = parts.join(numbered, [*keys, "label"]).select(*keys, "vid", "number")
    reach = links.join(core_labels, [*keys, "vid"]).groupBy(*keys, "block").agg(F.min("number").alias("number"))
    border = (
        links.join(reach, [*keys, "block"]).groupBy(*keys, "vid").agg(F.min("number").alias("border"))
    )
    return (
        nodes.join(core_labels, [*keys, "vid"], "left").join(border, [*keys, "vid"], "left")
        .select(*keys, "vid", "w", F.coalesce("number", "border", F.lit(-1)).cast("int").alias("label"))
    )


def dbscan_sweep(vectors: DataFrame, spec: FeatureSpec, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Labels for all candidate radii of all groups."""
    counts = materialise(neighbour_counts(vectors, spec), "counts")
    radii = eps_candidates(materialise(k_distances(counts, spec, min_samples), "kdist"), counts, spec)
    return dbscan(vectors, counts, radii, spec, min_samples)
