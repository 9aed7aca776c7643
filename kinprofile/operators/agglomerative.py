"""Ward, average and complete linkage over weighted distinct vectors, all groups at once.

The three linkages are reducible: every pair of clusters that are each other's nearest neighbour may merge in the same round
without changing the hierarchy, and a cluster whose neighbour did not merge keeps it.  Equal distances are ordered by a hash
of the pair.  The number of rounds is the longest chain of nearest neighbours that ever waits for its end: few on clustered
data, up to the number of vectors on a line with growing gaps.

A group of at most ``BLOCK`` distinct vectors goes through all its rounds inside one task per linkage.  A larger one takes a
job per round over tiles: clusters lie in blocks of about ``BLOCK`` rows (Ward: one row per cluster, its centre; the others
one per vector), a cluster of more rows is spread over blocks of its own, and a task compares one block of clusters that
look for a neighbour with one block of all.  It emits the nearest cluster of each, and, where a spread cluster is involved,
the sum or maximum its part gives, which are combined by Spark.  Only clusters that merged, or whose neighbour did, look
again.  Both ways give the same hierarchy.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.operators.hdbscan import number_labels
from kinprofile.operators.vectors import dense, one_hot_sql
from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec

LINKAGES = ("ward", "average", "complete")
K_RANGE = tuple(range(2, 11))
DENDROGRAM_MERGES = 40
BLOCK = 2048
DIGITS = 9  # heights that agree so far count as equal
CELLS = 4_000_000


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _ward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 * a[:, None] * b[None, :] / (a[:, None] + b[None, :]))


def _mix(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pair hash that decides among equal distances."""
    z = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(27))) >> np.uint64(1)).astype(np.int64)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(np.minimum(a, b), np.maximum(a, b))


def _nearest(height: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and pair hash of the nearest ``other`` of every ``own`` that has any, by (height, hash, name)."""
    low = height.min(1)
    i, j = np.nonzero((height == low[:, None]) & np.isfinite(low)[:, None])
    tie = _pair_hash(own[i], other[j])
    order = np.lexsort((other[j], tie, i))
    i, j, tie = i[order], j[order], tie[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
    return i[first], j[first], tie[first]


def _whole(x: np.ndarray, w: np.ndarray, vid: np.ndarray, linkage: str) -> pd.DataFrame:
    """All rounds over one block: (vid, w, round, before, cluster, height) of every change."""
    height = _gaps(x, x)
    if linkage == "ward":
        height *= _ward(w, w)
    np.fill_diagonal(height, np.inf)
    mass, place, alive, out = w.astype(float).copy(), np.arange(len(vid)), np.arange(len(vid)), []
    turn = 0
    while len(alive) > 1:
        # Rows of ``height`` carry the names of their clusters: a cluster is named by its smallest vector.
        low = np.round(height[np.ix_(alive, alive)], DIGITS)
        i, j, tie = _nearest(low, vid[alive], vid[alive])
        mutual = np.flatnonzero((j[j] == i) & (i < j))
        if not len(mutual):
            value = low[i, j]
            a, b = np.minimum(i, j), np.maximum(i, j)
            mutual = np.lexsort((vid[alive[b]], vid[alive[a]], tie, value))[:1]
            i, j = a, b
        for at in mutual.tolist():
            a, b = int(alive[i[at]]), int(alive[j[at]])
            if vid[a] > vid[b]:
                a, b = b, a
            own, h = np.flatnonzero((place == a) | (place == b)), float(np.round(height[a, b], DIGITS))
            out.append(pd.DataFrame({"vid": vid[own], "w": w[own], "round": turn, "before": vid[place[own]], "cluster": vid[a], "height": h}))
            place[own] = a
            if linkage == "average":
                new = (mass[a] * height[a] + mass[b] * height[b]) / (mass[a] + mass[b])
            elif linkage == "complete":
                new = np.maximum(height[a], height[b])
            else:
                gap = height[a, b]
                with np.errstate(invalid="ignore"):
                    sq = (mass[a] + mass) * height[a] ** 2 + (mass[b] + mass) * height[b] ** 2 - mass * gap * gap
                new = np.sqrt(np.maximum(np.nan_to_num(sq, nan=np.inf, posinf=np.inf), 0.0) / (mass[a] + mass[b] + mass))
            mass[a] += mass[b]
            height[a], height[:, a] = new, new
            height[b], height[:, b] = np.inf, np.inf
            height[a, a] = np.inf
        alive = np.unique(place)
        turn += 1
    columns = ["vid", "w", "round", "before", "cluster", "height"]
    return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})


_TILE = [
    T.StructField("cluster", T.LongType()), T.StructField("partner", T.LongType()), T.StructField("whole", T.BooleanType()),
    T.StructField("value", T.DoubleType()), T.StructField("tie", T.LongType()), T.StructField("scale", T.DoubleType()),
]


def _compare(own: pd.DataFrame, other: pd.DataFrame, linkage: str) -> pd.DataFrame:
    """One tile: the nearest whole cluster of every whole one, and what parts of spread clusters add to their pairs."""
    own, other = own.sort_values("cluster", kind="stable"), other.sort_values("cluster", kind="stable")
    (a, first_a), (b, first_b) = (np.unique(t["cluster"].to_numpy(), return_index=True) for t in (own, other))
    (x, w), (y, v) = ((np.array(t["x"].tolist(), float), t["w"].to_numpy(float)) for t in (own, other))
    mass_a, mass_b = own["mass"].to_numpy(float)[first_a], other["mass"].to_numpy(float)[first_b]
    spread = own["spread"].to_numpy(bool)[first_a][:, None] | other["spread"].to_numpy(bool)[first_b][None, :]
    total = np.zeros((len(a), len(b)))
    owner = np.repeat(np.arange(len(a)), np.diff(np.r_[first_a, len(own)]))
    for at in range(0, len(x), max(1, CELLS // len(y))):
        some = slice(at, at + max(1, CELLS // len(y)))
        gap = _gaps(x[some], y)
        if linkage == "average":
            np.add.at(total, owner[some], np.add.reduceat(gap * v, first_b, axis=1) * w[some][:, None])
        else:  # Ward has one row per cluster
            np.maximum.at(total, owner[some], np.maximum.reduceat(gap, first_b, axis=1))
    scale = mass_a[:, None] * mass_b[None, :] if linkage == "average" else np.ones_like(total)
    if linkage == "ward":
        total = total * _ward(mass_a, mass_b)
    same = a[:, None] == b[None, :]
    height = np.where(same | spread, np.inf, np.round(total / scale, DIGITS))
    i, j, tie = _nearest(height, a, b)
    best = pd.DataFrame({"cluster": a[i], "partner": b[j], "whole": True, "value": height[i, j], "tie": tie, "scale": 1.0})
    i, j = np.nonzero(spread & ~same)
    part = pd.DataFrame(
        {"cluster": a[i], "partner": b[j], "whole": False, "value": total[i, j], "tie": _pair_hash(a[i], b[j]), "scale": scale[i, j]}
    )
    return pd.concat([best, part])


def nearest_clusters(points: DataFrame, seeking: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, partner, height, tie) for the clusters of ``seeking`` (keys, cluster).

    ``points`` is (keys, cluster, vid, w, x).
    """
    sizes = points.groupBy(*keys, "cluster").agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("rows"))
    sizes = materialise(sizes, "linkage-sizes")
    blocks = F.ceil(F.sum("rows") / BLOCK).alias("blocks")
    placed = points.join(sizes, [*keys, "cluster"]).join(sizes.groupBy(*keys).agg(blocks), keys)
    piece = F.when(F.col("rows") > BLOCK, F.pmod(F.xxhash64("vid"), F.ceil(F.col("rows") / BLOCK)))
    placed = placed.withColumns({
        "spread": F.col("rows") > BLOCK,
        "block": F.xxhash64(F.coalesce(piece, F.pmod(F.xxhash64("cluster"), "blocks")), F.when(F.col("rows") > BLOCK, F.col("cluster"))),
    }).select(*keys, "block", "cluster", "mass", "spread", "w", "x")
    placed = materialise(placed, "linkage-blocks")
    mine = placed.join(seeking, [*keys, "cluster"], "left_semi")
    left = mine.withColumnRenamed("block", "own").join(placed.select(*keys, F.col("block").alias("other")).distinct(), keys)
    right = placed.withColumnRenamed("block", "other").join(mine.select(*keys, F.col("block").alias("own")).distinct(), keys)
    right = right.select([F.col(c).alias(c) for c in right.columns])  # both sides come from the same table
    schema = T.StructType([T.StructField(k, points.schema[k].dataType) for k in keys] + _TILE)
    tile = [*keys, "own", "other"]

    def search(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = _compare(own, other, key[1]) if len(own) and len(other) else pd.DataFrame({f.name: [] for f in _TILE})
        for name, value in zip(keys, key):
            found[name] = value
        return found[schema.fieldNames()]

    found = materialise(left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(search, schema), "linkage-tiles")
    height = F.when(F.col("linkage") == "average", F.sum("value") / F.first("scale")).otherwise(F.max("value"))
    parts = found.where("not whole").groupBy(*keys, "cluster", "partner").agg(F.round(height, DIGITS).alias("value"), F.first("tie").alias("tie"))
    every = found.where("whole").select(*keys, "cluster", "partner", "value", "tie").unionByName(parts)
    best = every.groupBy(*keys, "cluster").agg(F.min(F.struct(F.col("value").alias("height"), "tie", "partner")).alias("best"))
    return best.select(*keys, "cluster", "best.partner", "best.height", "best.tie")


def reciprocal_pairs(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """Merges of one round: pairs named from both sides, else the closest pair of the key."""
    pairs = nearest.groupBy(
        *keys, F.least("cluster", "partner").alias("into"), F.greatest("cluster", "partner").alias("gone")
    ).agg(F.min("height").alias("height"), F.min("tie").alias("tie"), F.count(F.lit(1)).alias("named"))
    mutual = pairs.filter("named = 2")
    closest = pairs.groupBy(*keys).agg(
        F.max("named").alias("most"), F.min(F.struct("height", "tie", "into", "gone")).alias("p")
    ).filter("most < 2")
    return mutual.select(*keys, "into", "gone", "height").unionByName(closest.select(*keys, "p.into", "p.gone", "p.height"))


def _by_rounds(vectors: DataFrame, spec: FeatureSpec, linkages: tuple[str, ...]) -> DataFrame:
    """The history of groups of several blocks: a few jobs per round."""
    keys = [spec.group, "linkage"]
    x = F.expr(one_hot_sql(spec)).alias("x")
    points = vectors.select(spec.group, "vid", "w", x, F.explode(F.array(*map(F.lit, linkages))).alias("linkage"))
    points = materialise(points.withColumn("cluster", F.col("vid")), "linkage-points")
    placed = points.select(*keys, "vid", "w", "cluster")
    nearest = materialise(nearest_clusters(points, points.select(*keys, "cluster"), keys), "linkage-nearest")
    rounds = []
    while True:
        pairs = materialise(reciprocal_pairs(nearest, keys), "linkage-pairs")
        if pairs.isEmpty():
            break
        sides = pairs.select(*keys, F.explode(F.array("into", "gone")).alias("cluster"), "into", "height")
        step = placed.join(sides, [*keys, "cluster"], "left").withColumn("before", F.col("cluster"))
        step = materialise(step.withColumn("cluster", F.coalesce("into", "cluster")), "linkage-members")
        changed = step.where("height IS NOT NULL")
        rounds.append(changed.select(*keys, "vid", "w", F.lit(len(rounds)).alias("round"), "before", "cluster", "height"))
        placed = step.select(*keys, "vid", "w", "cluster")
        moved = points.join(sides.drop("height"), [*keys, "cluster"], "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("into")
        # Ward needs a cluster's weight and centre only.
        centre = moved.where("linkage = 'ward'").select(*keys, "cluster", "vid", "w", F.posexplode("x").alias("at", "v"))
        centre = centre.groupBy(*keys, "cluster", "at").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
        centre = centre.groupBy(*keys, "cluster").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))
        centre = centre.select(*keys, "cluster", F.col("cluster").alias("vid"), "w", F.expr("transform(c, e -> e.v)").alias("x"))
        points = materialise(moved.where("linkage <> 'ward'").unionByName(centre), "linkage-points")
        # Whoever merged looks for a neighbour again, and whoever had one that merged.
        gone = sides.select(*keys, F.col("cluster").alias("touched")).distinct()
        touched = nearest.join(gone.withColumnRenamed("touched", "cluster"), [*keys, "cluster"], "left_anti")
        kept = touched.join(gone.withColumnRenamed("touched", "partner"), [*keys, "partner"], "left_anti")
        lost = touched.join(gone.withColumnRenamed("touched", "partner"), [*keys, "partner"], "left_semi").select(*keys, "cluster")
        seeking = materialise(lost.union(pairs.select(*keys, F.col("into").alias("cluster"))), "linkage-seeking")
        nearest = materialise(kept.unionByName(nearest_clusters(points, seeking, keys)), "linkage-nearest")
    return reduce(DataFrame.unionByName, rounds)


def linkage_history(vectors: DataFrame, spec: FeatureSpec, linkages: tuple[str, ...] = LINKAGES) -> DataFrame:
    """Every change of cluster of every vector: (group, linkage, vid, w, round, before, cluster, height).

    A cluster is named by its smallest vector id.
    """
    group = spec.group
    sizes = materialise(vectors.groupBy(group).agg(F.count(F.lit(1)).alias("vectors")), "sizes")  # one row per group
    sized = vectors.select(group, "vid", "w", *spec.code_columns, *[o.scaled for o in spec.ordinals]).join(sizes, group)
    fields = [T.StructField(c, T.LongType()) for c in ("vid", "w")] + [T.StructField("round", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("before", "cluster")] + [T.StructField("height", T.DoubleType())]
    schema = T.StructType([T.StructField(group, vectors.schema[group].dataType), T.StructField("linkage", T.StringType()), *fields])

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vid")
        found = _whole(dense(own, spec), own["w"].to_numpy(), own["vid"].to_numpy(), key[1])
        found.insert(0, "linkage", key[1])
        found.insert(0, group, key[0])
        return found

    small = sized.where(F.col("vectors") <= BLOCK).withColumn("linkage", F.explode(F.array(*map(F.lit, linkages))))
    history = small.groupBy(group, "linkage").applyInPandas(solve, schema)
    if not sizes.where(F.col("vectors") > BLOCK).isEmpty():
        history = history.unionByName(_by_rounds(sized.where(F.col("vectors") > BLOCK), spec, linkages))
    return materialise(history, "linkage-history")


def merge_table(history: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Merges: (group, linkage, step, left, right, height, rows), lowest first."""
    keys = [spec.group, "linkage"]
    merges = history.groupBy(*keys, "round", "cluster").agg(
        F.min("before").alias("left"), F.max("before").alias("right"),
        F.first("height").alias("height"), F.sum("w").alias("rows"),
    )
    order = Window.partitionBy(*keys).orderBy("height", "round", "cluster")
    return merges.withColumn("step", F.row_number().over(order)).select(*keys, "step", "left", "right", "height", "rows")


def flat_clusters(
    history: DataFrame, vectors: DataFrame, spec: FeatureSpec, ks: tuple[int, ...] = K_RANGE,
    linkages: tuple[str, ...] = LINKAGES,
) -> DataFrame:
    """At most K clusters per (group, linkage, k): (group, linkage, k, vid, w, label).

    The cut applies every merge up to the K-th largest height, so equal heights are cut
    together and may leave fewer than K clusters.
    """
    keys = [spec.group, "linkage"]
    down = Window.partitionBy(*keys).orderBy(F.col("height").desc(), F.col("step").desc())
    cuts = (
        merge_table(history, spec).withColumn("k", F.row_number().over(down))
        .filter(F.col("k").isin(*ks)).select(*keys, "k", F.col("height").alias("cut"))
    )
    grid = vectors.select(
        spec.group, "vid", "w", "first_row", F.explode(F.array(*map(F.lit, linkages))).alias("linkage")
    ).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    joined = history.join(materialise(cuts, "cuts"), keys).filter(F.col("height") <= F.col("cut"))
    last = joined.groupBy(*keys, "k", "vid").agg(F.max_by("cluster", "round").alias("cluster"))
    placed = grid.join(last, [*keys, "k", "vid"], "left").withColumn("cluster", F.coalesce("cluster", "vid"))
    return number_labels(placed, [*keys, "k"], "cluster")


def dendrogram_tail(
    history: DataFrame, spec: FeatureSpec, chosen: DataFrame, last: int = DENDROGRAM_MERGES
) -> DataFrame:
    """Last merges of the adopted linkage with the height that separates K-1 from K clusters.

    ``chosen`` is (group, linkage, k).
    """
    keys = [spec.group, "linkage"]
    down = Window.partitionBy(*keys).orderBy(F.col("step").desc())
    ranked = (
        merge_table(history, spec).join(chosen.select(*keys, "k"), keys)
        .withColumn("from_top", F.row_number().over(down))
    )
    cut = ranked.groupBy(*keys).agg(
        ((F.max(F.when(F.col("from_top") == F.col("k") - 1, F.col("height")))
          + F.max(F.when(F.col("from_top") == F.col("k"), F.col("height")))) / 2).alias("cut_height")
    )
    return ranked.filter(F.col("from_top") <= last).join(cut, keys).select(
        *keys, "k", "from_top", "left", "right", "height", "rows", "cut_height"
    )
