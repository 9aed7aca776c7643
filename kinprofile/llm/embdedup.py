"""Near-duplicate embeddings through a forest of random-projection trees with spill overlap.

1. Equal vectors become one row with a weight; null, zero and non-finite vectors take no part.
2. Every tree splits recursively by random directions at the median of a bounded sample.  A vector closer to a split than
   the spill margin goes to both sides, so a pair of links is cut only when a split falls far between its ends.  The sample
   on the driver places the first splits; where the table needs deeper trees, every leaf is split on by a sample of its own
   rows, a few levels at a time, in tasks.
3. Vectors of a leaf are compared with each other by cosine in double precision; a leaf beyond ``block`` vectors is
   compared block by block in tasks of its own.
4. A pair that meets in several leaves counts in the first of them only - every row knows all its leaves - so link counts
   are sums and no pair leaves a task.  What leaves is one count and one component label per vector and leaf; labels are
   joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprofile.llm.common import Steps, components

TREES = 6
LEVELS = 5  # levels a round of deeper splits adds
PER_LEAF = 16  # sampled rows a leaf of a fitted tree keeps at least, on average


def usable(vector: str) -> Column:
    """Non-null, not empty, without null or non-finite components, not zero (null counts as false)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Forest:
    """Trees as arrays: direction and threshold of every inner node, numbered level by level."""

    def __init__(self, d: int, depth: int, margin: float, seed: int | list[int], trees: int = TREES) -> None:
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth, self.margin, self.trees = depth, margin, trees
        self.direction = rng.normal(size=(trees, inner, d)).astype(np.float32)
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.threshold = np.zeros((trees, inner), np.float32)

    def fit(self, sample: np.ndarray) -> Forest:
        for tree in range(self.trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    own = np.flatnonzero(at == node)
                    if len(own):
                        along = sample[own] @ self.direction[tree, node]
                        self.threshold[tree, node] = np.median(along)
                        at[own] = 2 * node + 1 + (along > self.threshold[tree, node])
        return self

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every membership, by row and leaf; leaves are numbered through all trees."""
        own, leaf = [], []
        inner = (1 << self.depth) - 1
        for tree in range(self.trees):
            who, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                gap = np.einsum("ij,ij->i", rows[who], self.direction[tree, node]) - self.threshold[tree, node]
                left, right = gap <= self.margin, gap >= -self.margin
                who = np.concatenate([who[left], who[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            own.append(who)
            leaf.append(node - inner + (tree << self.depth))
        own_, leaf_ = np.concatenate(own), np.concatenate(leaf)
        order = np.lexsort((leaf_, own_))
        return own_[order], leaf_[order]


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64))


def _indicator(leaves: pd.Series, below: int) -> np.ndarray:
    """Rows x earlier leaves, 1 where the row is in the leaf."""
    lists = [[x for x in own if x < below] for own in leaves]
    names = {x: k for k, x in enumerate(sorted({x for own in lists for x in own}))}
    out = np.zeros((len(lists), max(1, len(names))), np.float32)
    for i, own in enumerate(lists):
        out[i, [names[x] for x in own]] = 1
    return out


def _compare(rows: pd.DataFrame, leaf: int, first: int, second: int, threshold: float, kind: str) -> pd.DataFrame:
    """Weighted link counts of the pairs this leaf owns, and the smallest id reached inside it by any of its links."""
    rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
    vectors = _matrix(rows["vec"].tolist(), kind)
    single = vectors.astype(np.float32)
    rounding = 4 * (vectors.shape[1] + 8) * 2.0**-24  # beyond the error of a single-precision product of unit vectors
    a = np.flatnonzero(rows["block"].to_numpy() == first)
    b = a if first == second else np.flatnonzero(rows["block"].to_numpy() == second)
    left, right = [], []
    for at in range(0, len(a), 512):
        cosine = single[a[at : at + 512]] @ single[b].T
        i, j = np.nonzero(cosine >= np.float32(threshold - rounding))
        rough = cosine[i, j].astype(np.float64)
        i, j = a[at + i], b[j]
        unsure = np.flatnonzero(rough < threshold + rounding)
        if len(unsure):  # decided in double precision by a sum in the order of components, whatever the blocks
            exact = np.zeros(len(unsure))
            for c in range(vectors.shape[1]):
                exact += vectors[i[unsure], c] * vectors[j[unsure], c]
            sure = np.ones(len(i), bool)
            sure[unsure] = exact >= threshold
            i, j = i[sure], j[sure]
        if first == second:
            i, j = i[i < j], j[i < j]
        left.append(i.astype(np.int32))
        right.append(j.astype(np.int32))
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    some = np.unique(np.concatenate([i, j]))
    at = np.zeros(len(rows), np.int64)
    at[some] = np.arange(len(some))
    earlier = _indicator(rows["leaves"].iloc[some], leaf)
    own = np.empty(len(i), bool)
    for k in range(0, len(i), 200_000):
        x, y = at[i[k : k + 200_000]], at[j[k : k + 200_000]]
        own[k : k + 200_000] = ~((earlier[x] * earlier[y]).any(1)) if earlier.shape[1] < 64 else ~_meet(earlier, x, y)
    weight = rows["n"].to_numpy()
    counts = np.bincount(i[own], weight[j[own]], len(rows)) + np.bincount(j[own], weight[i[own]], len(rows))
    label = np.arange(len(rows))
    while True:  # smallest row reached
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    rep = rows["rep"].to_numpy()
    counted, hooked = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({
        "a": np.concatenate([rep[counted], rep[label[hooked]]]),
        "b": pd.array([None] * len(counted) + rep[hooked].tolist(), "Int64"),
        "n": np.concatenate([counts[counted].astype(np.int64), np.zeros(len(hooked), np.int64)]),
    })


def _meet(earlier: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), bool)
    for k in range(0, len(x), 20_000):
        out[k : k + 20_000] = np.einsum("ij,ij->i", earlier[x[k : k + 20_000]], earlier[y[k : k + 20_000]]) > 0
    return out


def _split_on(steps: Steps, placed: DataFrame, levels: int, d: int, margin: float, seed: int, kind: str) -> DataFrame:
    """Memberships ``placed(leaf, rep, n, vec)`` with every leaf cut into 2^``levels`` by splits of its own.

    A leaf's splits come from about ``PER_LEAF`` << ``levels`` of its rows, in one task; its rows are placed wherever they
    are, each with the thresholds of its leaf beside it.
    """
    wanted = PER_LEAF << levels
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(levels), "rep"), F.lit(1_000_003)) * F.col("rows") < F.lit(wanted * 1_000_003)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        points = _matrix(pdf.sort_values("rep")["vec"].tolist(), kind).astype(np.float32)
        cut = Forest(d, levels, margin, [seed, leaf], 1).fit(points).threshold
        return pd.DataFrame({"leaf": [leaf], "cut": [cut[0].tolist()]})

    cuts = steps.write(placed.join(sizes, "leaf").where(draw).select("leaf", "rep", "vec").groupBy("leaf").applyInPandas(fit, "leaf long, cut array<float>"), "cuts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for leaf, part in pdf.groupby("leaf", sort=False):
                own = Forest(d, levels, margin, [seed, int(leaf)], 1)
                if part["cut"].iloc[0] is not None:
                    own.threshold[0] = part["cut"].iloc[0]
                row, sub = own.leaves(_matrix(part["vec"].tolist(), kind).astype(np.float32))
                taken = part.iloc[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((int(leaf) << levels) + sub), pa.array(taken["rep"]), pa.array(taken["n"]), pa.array(taken["vec"].tolist(), pa.binary())],
                    ["leaf", "rep", "n", "vec"],
                )

    together = placed.join(cuts, "leaf", "left").select("leaf", "rep", "n", "vec", "cut").sortWithinPartitions("leaf")
    deeper = steps.write(together.mapInArrow(place, "leaf long, rep long, n long, vec binary"), "placed")
    steps.drop(cuts)
    return deeper


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, leaf_size: int = 256,
    sample: int = 50_000, block: int = 2048, spill: float = 0.16, seed: int = 5,
) -> DataFrame:
    """Rows ``(key, n_links, component_id, kept)``, one per row of ``rows``.

    Vectors with cosine >= ``threshold`` (double precision) are linked; ``n_links`` counts other vectors, equal ones
    included.  Unusable vectors (see ``usable``) and those with a null key have no link; a null key has a null component
    and is kept.  Rows that repeat a key are one node for components.  Vectors of different length are never compared.

    ``leaf_size`` sets the depth of the trees: rows / 2^depth is at most this (memberships by spill come on top).  ``sample``
    bounds the rows that place the first splits (collected; about ``sample`` by hash), every row is in the forest.
    ``spill`` is the margin in units of 1/sqrt(dimension), at half a typical distance of a barely linked pair.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    kind = "<f4" if "float" in dict(rows.dtypes)[vector] else "<f8"
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    given = given.withColumn("ok", usable("vec") & F.col("id").isNotNull())
    hashed = given.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    classes = hashed.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = steps.write(classes, "classes")
    by_size = classes.groupBy(F.size("vec").alias("d")).count().collect()  # one row per length of vector
    out, dead = None, []
    for size in by_size:
        d, total = size["d"], size["count"]
        own = classes.where(F.size("vec") == d)
        share = min(1.0, sample / total)
        drawn = own if share == 1 else own.where(F.pmod(F.xxhash64(F.lit(seed), "h1"), F.lit(1_000_003)) < share * 1_000_003)
        points = unit(np.array([r["vec"] for r in drawn.select("vec").collect()], np.float64).reshape(-1, d))
        margin = spill / math.sqrt(d)
        wanted = max(0, math.ceil(math.log2(max(1, total / leaf_size))))
        depth = min(wanted, int(math.log2(max(1, len(points) / PER_LEAF))))
        forest = spark.sparkContext.broadcast(Forest(d, depth, margin, seed).fit(points.astype(np.float32)))

        def place(batches: Iterator[pa.RecordBatch], forest=forest, d=d) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    flat = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                    row, leaf = forest.value.leaves(unit(flat.astype(np.float64)).astype(np.float32))
                    first = np.searchsorted(row, np.arange(part.num_rows + 1))
                    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(leaf, pa.int64()))
                    raw = pa.array([v.tobytes() for v in flat], pa.binary())
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf, pa.int64()), part.column("rep").take(take), part.column("n").take(take),
                         raw.take(take), lists.take(take)],
                        ["leaf", "rep", "n", "vec", "leaves"],
                    )

        placed = own.select("rep", "n", "vec").mapInArrow(place, "leaf long, rep long, n long, vec binary, leaves array<long>")
        placed = steps.write(placed, "placed")
        if depth < wanted:
            while depth < wanted:
                levels = min(LEVELS, wanted - depth)
                deeper = _split_on(steps, placed.select("leaf", "rep", "n", "vec"), levels, d, margin, seed, kind)
                steps.drop(placed)
                placed, depth = deeper, depth + levels
            dead.append(placed)
            leaves = placed.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
            placed = placed.join(leaves, "rep")
        else:
            dead.append(placed)
        blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # one row per leaf
        dealt = placed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = dealt.select("leaf", "rep", "n", "vec", "leaves", "block", other)
        dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

        def compare(group, pdf):
            return _compare(pdf, int(group[0]), int(group[1]), int(group[2]), threshold, kind)

        found = dealt.groupBy("leaf", "lo", "hi").applyInPandas(compare, "a long, b long, n long")
        out = found if out is None else out.union(found)
    nothing = spark.createDataFrame([], "a long, b long, n long")
    found = steps.write(nothing if out is None else out, "found")
    for df in dead:
        steps.drop(df)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    same = hashed.where("ok").join(classes.where("n > 1").select("h1", "h2", "rep"), ["h1", "h2"]).where("id <> rep")
    labels = components(found.where("b is not null").select("a", "b").union(same.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    weights = classes.select("h1", "h2", "rep", "n").join(counts, "rep", "left")
    weights = weights.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.lit(True).alias("ok"))
    result = hashed.select("id", "h1", "h2", "ok").join(weights, ["h1", "h2", "ok"], "left")
    result = result.join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    component = F.coalesce("label", "id")
    return result.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
