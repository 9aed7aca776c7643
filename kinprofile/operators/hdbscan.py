"""HDBSCAN over weighted distinct vectors, for all groups at once.

Distances in the coded space take few values, so the single-linkage hierarchy of mutual
reachability is the nested sequence of core-vector components at each of these values:
the same components DBSCAN needs, with the distance value as one more key.  No edge list
and no spanning tree over vector pairs is formed.

Definitions follow the published algorithm (density-based clusters by excess of mass, with
the optional distance threshold below which clusters are not split).  The core distance is
the distance to the ``min_cluster_size``-th other row.  Merges at equal height happen
together, and a core distance of 0 counts as infinite density.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.operators.neighbours import blocks_within, kth_distance, neighbour_counts, spread_labels
from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec

# The swept thresholds.
SELECTION_EPSILONS = (0.0, 0.2, 0.4, 0.6, 0.8, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.5, 2.0, 2.5)
MIN_CLUSTER_SHARE = 0.01
MIN_CLUSTER_FLOOR = 20


def min_cluster_size(n: Column) -> Column:
    return F.greatest(F.lit(MIN_CLUSTER_FLOOR), F.floor(n * F.lit(MIN_CLUSTER_SHARE))).cast("bigint")


def core_distances(counts: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Distance to the ``min_cluster_size``-th row besides the own one, per vector."""
    n = F.col("n")
    return kth_distance(counts, spec, F.least(min_cluster_size(n) + 1, n)).withColumnRenamed("kdist", "core")


def reachability_components(
    vectors: DataFrame, cores: DataFrame, radii: DataFrame, spec: FeatureSpec, below: DataFrame | None = None
) -> DataFrame:
    """Components of mutual reachability <= eps: (group, eps, vid, w, label = smallest row id).

    ``below`` (group, vid, start) are components at a distance no larger than any of ``radii``; components are nested,
    so the search starts from them.
    """
    keys = [spec.group, "eps"]
    inside = cores.join(radii, spec.group).filter(F.col("core") <= F.col("eps"))
    nodes = inside.select(*keys, "vid", "w", F.col("first_row").alias("label"))
    if below is not None:
        nodes = nodes.join(below, [spec.group, "vid"], "left").withColumn("start", F.coalesce("start", "label"))
    nodes = materialise(nodes, "reach-nodes")
    links = blocks_within(vectors, radii, spec)
    return spread_labels(nodes.drop("w"), links, keys).join(nodes.drop("label", "start"), [*keys, "vid"])


def component_levels(
    vectors: DataFrame, counts: DataFrame, cores: DataFrame, spec: FeatureSpec, batch: int = 16
) -> DataFrame:
    """Components at every distance value, lowest first: (group, level, eps, vid, w, label).

    Levels run in batches, each from the components of the last level before it; a group leaves once all its
    vectors form one component, which happens long before the largest distances.
    """
    group = spec.group
    floor = cores.groupBy(group).agg(F.min("core").alias("floor"))
    by_height = Window.partitionBy(group).orderBy("eps")
    levels = materialise(
        counts.select(group, F.col("dist").alias("eps")).distinct()
        .join(floor, group).filter(F.col("eps") >= F.col("floor"))
        .select(group, "eps", F.row_number().over(by_height).alias("level")),
        "levels",
    )
    totals = cores.groupBy(group).agg(F.count(F.lit(1)).alias("vectors"))
    open_groups, done, start, below = totals, [], 0, None
    while True:
        radii = levels.filter((F.col("level") > start) & (F.col("level") <= start + batch)).join(
            open_groups, group, "left_semi"
        )
        if radii.isEmpty():
            break
        parts = reachability_components(vectors, cores, materialise(radii.select(group, "eps"), "radii"), spec, below)
        parts = materialise(parts.join(levels, [group, "eps"]), "components")
        done.append(parts)
        highest = parts.groupBy(group).agg(F.max("level").alias("level"))
        below = parts.join(highest, [group, "level"], "left_semi").select(group, "vid", F.col("label").alias("start"))
        closed = (
            parts.groupBy(group, "level").agg(F.count(F.lit(1)).alias("vectors"), F.min("label").alias("a"), F.max("label").alias("b"))
            .filter("a = b").join(totals, [group, "vectors"], "left_semi").select(group)
        )
        open_groups = materialise(open_groups.join(closed, group, "left_anti"), "open-groups")
        start += batch
    return reduce(DataFrame.unionByName, done)


def condense(levels: DataFrame, vectors: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Condensed tree from the nested components.

    Returns ``tree`` (group, cluster, parent, top, birth, size, stability) and ``exits``
    (group, vid, w, cluster): the cluster each vector leaves last when distances shrink.
    All windows are per vector and as short as the list of distance values.
    """
    group = spec.group
    sizes = vectors.groupBy(group).agg(F.first("n").alias("n"))
    node, path = [group, "level", "label"], Window.partitionBy(group, "vid").orderBy("level")
    weights = levels.groupBy(*node).agg(F.sum("w").alias("size"))
    large = weights.join(sizes, group).filter(F.col("size") >= min_cluster_size(F.col("n"))).drop("n")
    walk = levels.join(large, node).withColumn("below", F.lag("label").over(path))
    births = walk.groupBy(*node).agg((F.count_distinct("below") != 1).alias("starts"))
    walk = walk.join(births, node).withColumn(
        "seen", F.last(F.when(F.col("starts"), F.concat_ws(":", "level", "label")), ignorenulls=True).over(path)
    )
    named = walk.groupBy(*node).agg(F.max("seen").alias("cluster"))
    walk = materialise(
        walk.join(named, node).select(group, "vid", "w", "level", "eps", "size", "cluster"), "condensed"
    )
    walk = walk.withColumn("above", F.lead("cluster").over(path)).withColumn("above_eps", F.lead("eps").over(path))
    leaves = F.col("above") != F.col("cluster")
    clusters = materialise(
        walk.groupBy(group, "cluster").agg(
            F.max(F.when(leaves, F.col("above"))).alias("parent"),
            F.max(F.when(leaves, F.col("above_eps"))).alias("birth"),
            F.max("size").alias("size"), F.max("level").alias("top"),
        ),
        "clusters",
    )
    first = F.row_number().over(path)
    exits = materialise(
        walk.withColumn("place", first).filter("place = 1").select(group, "vid", "w", "cluster", F.col("eps").alias("exit_eps")),
        "exits",
    )

    def density(eps: Column) -> Column:
        return F.when(eps > 0, 1.0 / F.nullif(eps, F.lit(0.0))).otherwise(F.lit(float("inf")))

    born = F.when(F.col("birth").isNull(), F.lit(0.0)).otherwise(density(F.col("birth")))
    gains = exits.select(group, "cluster", F.col("w").alias("rows"), density(F.col("exit_eps")).alias("leaves_at")).unionByName(
        clusters.filter("parent IS NOT NULL").select(
            group, F.col("parent").alias("cluster"), F.col("size").alias("rows"), density(F.col("birth")).alias("leaves_at")
        )
    )
    stability = (
        gains.join(clusters.select(group, "cluster", "birth"), [group, "cluster"])
        .groupBy(group, "cluster").agg(F.sum(F.col("rows") * (F.col("leaves_at") - born)).alias("stability"))
    )
    return clusters.join(stability, [group, "cluster"]), exits.drop("exit_eps")


def select_clusters(tree: DataFrame, spec: FeatureSpec, epsilons: tuple[float, ...]) -> DataFrame:
    """Selected ancestor of every condensed cluster per threshold: (group, eps, cluster, chosen).

    Every cluster without sub-clusters holds at least 1% of its group's rows, so a tree has
    at most about 200 nodes whatever the data size; that bounded tree is walked per group.
    """
    group = spec.group

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "cluster"])
        parent = {c: p for c, p in zip(pdf["cluster"], pdf["parent"]) if isinstance(p, str)}
        birth = dict(zip(pdf["cluster"], pdf["birth"]))
        best = dict(zip(pdf["cluster"], pdf["stability"]))
        below: dict[str, list[str]] = {}
        for child, up in parent.items():
            below.setdefault(up, []).append(child)

        def descendants(c: str) -> Iterator[str]:
            for child in below.get(c, []):
                yield child
                yield from descendants(child)

        picked: set[str] = set()
        for c in pdf["cluster"]:  # sub-clusters come first
            if c not in parent:
                continue
            inner = sum(best[x] for x in below.get(c, []))
            if inner > best[c]:
                best[c] = inner
            else:
                picked -= set(descendants(c))
                picked.add(c)
        out = []
        for eps in epsilons:
            final = set()
            for c in picked:
                # climb to the first ancestor born above the threshold, staying below the root
                close = birth[c] < eps
                while close and parent[c] in parent:
                    c = parent[c]
                    close = birth[c] <= eps
                final.add(c)
            final -= {x for c in final for x in descendants(c)}
            for c in pdf["cluster"]:
                at = c
                while at is not None and at not in final:
                    at = parent.get(at)
                out.append((pdf[group].iloc[0], eps, c, at))
        return pd.DataFrame(out, columns=[group, "eps", "cluster", "chosen"])

    kind = tree.schema[group].dataType.simpleString()
    return tree.groupBy(group).applyInPandas(walk, f"{group} {kind}, eps double, cluster string, chosen string")


def hdbscan_sweep(
    vectors: DataFrame, spec: FeatureSpec, epsilons: tuple[float, ...] = SELECTION_EPSILONS
) -> DataFrame:
    """Labels for every (group, eps): (group, eps, vid, w, label), noise = -1."""
    group, keys = spec.group, [spec.group, "eps"]
    counts = materialise(neighbour_counts(vectors, spec), "counts")
    cores = materialise(core_distances(counts, spec), "cores")
    tree, exits = condense(component_levels(vectors, counts, cores, spec), vectors, spec)
    chosen = materialise(select_clusters(tree, spec, epsilons), "selected")
    placed = (
        vectors.select(group, "vid", "w", "first_row", F.explode(F.array(*map(F.lit, epsilons))).alias("eps"))
        .join(exits.select(group, "vid", "cluster"), [group, "vid"], "left")
        .join(chosen, [*keys, "cluster"], "left")
    )
    return number_labels(placed, keys, "chosen")


def number_labels(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Replace cluster names by 0, 1, ... in order of their smallest row id; null is noise."""
    firsts = placed.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min("first_row").alias("lowest"))
    order = Window.partitionBy(*keys).orderBy("lowest")
    numbers = firsts.select(*keys, name, (F.row_number().over(order) - 1).alias("label"))
    return placed.join(numbers, [*keys, name], "left").select(
        *keys, "vid", "w", F.coalesce("label", F.lit(-1)).cast("int").alias("label")
    )
