"""Bootstrap weights of exactly the group's size, without a pass over its rows.

Drawing n of n rows with replacement gives the distinct vectors multinomial counts.  They are drawn by splitting: the
vectors of a group hang in a binary tree by the leading bits of a hash of their id, and a node hands a binomial number of
its draws to its left child, in proportion to the rows below it.  Every node's number comes from a uniform of
``(seed, replicate, group, level, node)``, so the counts do not depend on how the tree is dealt out: its top is drawn per
(group, replicate) from the node weights, the subtrees of at most about ``BLOCK`` vectors in tasks of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.functions.scalar import uniform
from kinprofile.session import materialise, tasks_apart

BLOCK = 8192
BITS = 52


def _uniform(*parts) -> float:
    """The uniform of ``functions.scalar.uniform`` for plain values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0**52


def binomial(n: int, p: float, u: float) -> int:
    """Binomial(n, p) draw by inverting its distribution function at ``u``.

    Only numbers within nine standard deviations (and 40) are looked at; the others hold less than the last bit of ``u``.
    """
    if n <= 0 or p <= 0.0:
        return 0
    if p >= 1.0:
        return n
    reach = 9.0 * math.sqrt(n * p * (1.0 - p)) + 40.0
    low, high = max(0, math.floor(n * p - reach)), min(n, math.ceil(n * p + reach))
    log_p, log_q = math.log(p), math.log1p(-p)
    mode = min(high, max(low, math.floor((n + 1) * p)))
    at_mode = math.lgamma(n + 1.0) - math.lgamma(mode + 1.0) - math.lgamma(n - mode + 1.0) + mode * log_p + (n - mode) * log_q
    x = np.arange(low, high + 1)
    logs = np.r_[0.0, np.cumsum(np.log((n - x[:-1]) / x[1:]) + (log_p - log_q))]  # from the ratios of neighbours
    total = np.cumsum(np.exp(logs + (at_mode - logs[mode - low])))
    return min(high, low + int(np.searchsorted(total, u, "right")))


def _shares(place: np.ndarray, weight: np.ndarray, n: int, level: int, node: int, stop: int, key: tuple) -> list[tuple[int, int]]:
    """Draws ``(entry, count)`` of the entries below ``node``; ``place`` holds their rising hash bits.

    A node is split until it holds one entry, or until ``stop`` leading bits have been used.
    """
    out, todo = [], [(0, len(place), n, level, node)]
    sums = np.r_[0, np.cumsum(weight)]
    while todo:
        a, b, n, level, node = todo.pop()
        if n == 0 or a == b:
            continue
        if b - a == 1 or level == stop:
            out.append((a, n))
            continue
        middle = a + int(np.searchsorted(place[a:b], (2 * node + 1) << (BITS - level - 1)))
        left = binomial(n, float(sums[middle] - sums[a]) / float(sums[b] - sums[a]), _uniform(*key, level, node))
        todo += [(a, middle, left, level + 1, 2 * node), (middle, b, n - left, level + 1, 2 * node + 1)]
    return out


def bootstrap_weights(vectors: DataFrame, group: str, replicates: int = 20, seed: int = 42) -> DataFrame:
    """Resampled weight of every distinct vector: (group, replicate, vid, w), only positive ones.

    ``vectors`` is (group, vid, w).  The weights of a (group, replicate) add up to the group's.
    """
    place = (uniform("v", F.col("vid")) * float(2**BITS)).cast("long").alias("place")
    placed = vectors.select(group, "vid", F.col("w").cast("long").alias("w"), place)
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("vectors"), F.sum("w").alias("n"))
    levels = F.ceil(F.log2(F.greatest(F.col("vectors") / BLOCK, F.lit(1.0)))).cast("int")
    sizes = materialise(sizes.select(group, "n", levels.alias("top")), "tree")  # one row per group
    dealt = placed.join(sizes, group).withColumn("node", F.expr(f"shiftright(place, {BITS} - top)"))
    nodes = dealt.groupBy(group, "top", "node").agg(F.sum("w").alias("w"))  # at most about 2 * vectors / BLOCK
    several = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    kind = vectors.schema[group].dataType
    fields = [T.StructField(group, kind), T.StructField("replicate", T.IntegerType())]
    drawn_nodes = T.StructType([*fields, T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])

    def draw_nodes(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        top, weight = int(own["top"].iloc[0]), own["w"].to_numpy()
        place = own["node"].to_numpy() << (BITS - top)
        # A node that holds several vectors is split further down, so only its level stops it here.
        found = _shares(place, weight, int(weight.sum()), 0, 0, top, (seed, key[1], key[0])) if top else [(0, int(weight.sum()))]
        node = own["node"].to_numpy()
        return pd.DataFrame([(*key, int(node[i]), n) for i, n in found], columns=drawn_nodes.fieldNames())

    top_counts = nodes.select("*", several).groupBy(group, "replicate").applyInPandas(draw_nodes, drawn_nodes)
    below = dealt.select(group, "top", "node", "place", "vid", "w").join(top_counts, [group, "node"])
    drawn = T.StructType([*fields, T.StructField("vid", T.LongType()), T.StructField("w", T.LongType())])

    def draw(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["place", "vid"])
        found = _shares(
            own["place"].to_numpy(), own["w"].to_numpy(), int(own["n"].iloc[0]), int(own["top"].iloc[0]), int(key[2]), BITS, (seed, key[1], key[0])
        )
        vid = own["vid"].to_numpy()
        return pd.DataFrame([(key[0], key[1], int(vid[i]), n) for i, n in found], columns=drawn.fieldNames())

    # Few bytes, much work: partitions that Spark would put together by their size stay apart.
    keys = [group, "replicate", "node"]
    return below.repartition(tasks_apart(vectors), *keys).groupBy(*keys).applyInPandas(draw, drawn)
