"""Approximate nearest neighbours by inner product over balanced posting lists.

Largest inner product becomes smallest distance by one more component: vectors are scaled by the largest norm and
lifted onto the unit sphere, queries are normalised.  On a bounded sample, balanced clustering gives centroids, a graph over
them, and the distance ratio that a query needs to reach its neighbours.

* Index: every vector is posted to its nearest cluster and, if it lies near a boundary, to up to ``REPLICAS`` - 1 others
  within ``boundary`` of the nearest distance.
* Search: the graph finds the centroids around a query; lists whose centroid is farther than ratio x nearest are pruned.
* Lists travel in groups of bounded size (a large list is cut); a query visits each group that holds one of its lists and
  takes home its best ``k`` of that group, scored on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.llm.common import Steps
from kinprofile.llm.embdedup import usable

REPLICAS = 3
FOUND = "query_id long, vec_id long, score double"


def lifted(rows: np.ndarray, norm: float) -> np.ndarray:
    scaled = rows / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
    return np.c_[scaled, rest].astype(np.float32)


def pointed(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return np.c_[rows / np.linalg.norm(rows, axis=1, keepdims=True), np.zeros(len(rows))].astype(np.float32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def balanced_centroids(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Clusters of similar size: each round adds to a cluster's distance a price that grows with its surplus."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    price = np.zeros(k, np.float32)
    for _ in range(rounds if k > 1 else 1):
        nearest = np.empty(len(points), np.int64)
        spread = 0.0
        for at in range(0, len(points), 4096):
            far = _squared(points[at : at + 4096], centres)
            spread += float(far.min(1).sum())
            nearest[at : at + 4096] = (far + price).argmin(1)
        size = np.bincount(nearest, minlength=k)
        price += np.float32(0.1 * spread / len(points)) * (size * k / len(points) - 1).clip(-1, 2).astype(np.float32)
        for c in np.flatnonzero(size):
            centres[c] = points[nearest == c].mean(0)
    return centres


class CentroidGraph:
    """Neighbour graph over the centroids; searched best first from a fixed entry."""

    DEGREE = 24
    CELLS = 500_000

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        k = len(centres)
        degree = min(self.DEGREE, k - 1)
        near: list[set[int]] = [set() for _ in range(k)]
        for at in range(0, k, 1024):
            order = np.argsort(_squared(centres[at : at + 1024], centres), 1)[:, : degree + 1]
            for i, row in enumerate(order.tolist(), at):
                for j in row:
                    if j != i:
                        near[i].add(j)
                        near[j].add(i)
        self.entry = int(_squared(centres.mean(0, keepdims=True), centres).argmin()) if k else 0
        for i in range(k):  # a chain, so that every centroid can be reached
            near[i].add((i + 1) % k)
        near_ = [sorted(n - {i}) for i, n in enumerate(near)]
        width = max([1, *map(len, near_)])
        self.near = np.array([n + [i] * (width - len(n)) for i, n in enumerate(near_)], np.int64).reshape(k, width)

    def search(self, points: np.ndarray, beam: int, ratio: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Centroids around each point, nearest first, with distances; about ``CELLS`` points x centroids are held at a time."""
        step = max(1, self.CELLS // max(1, len(self.centres)))
        for at in range(0, len(points), step):
            yield from self._walk(points[at : at + step], beam, ratio)

    def _walk(self, points: np.ndarray, beam: int, ratio: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Best-first search with a beam; with a ``ratio`` the search also goes on through every centroid within
        ratio x nearest, whatever the beam.  All points advance together, one expansion each per step.
        """
        n, k = len(points), len(self.centres)
        far = np.full((n, k), np.inf, np.float32)
        open_ = np.zeros((n, k), bool)
        far[:, self.entry] = np.sqrt(_squared(points, self.centres[self.entry : self.entry + 1]))[:, 0]
        open_[:, self.entry] = True
        active = np.arange(n)
        lengths = (points * points).sum(1)
        norms = (self.centres * self.centres).sum(1)
        while len(active):
            waiting = np.where(open_[active], far[active], np.inf)
            pick = waiting.argmin(1)
            best = waiting[np.arange(len(active)), pick]
            seen = far[active]
            limit = np.partition(seen, min(beam, k) - 1, axis=1)[:, min(beam, k) - 1]
            if ratio is not None:
                limit = np.maximum(limit, seen.min(1) * ratio)
            go = np.isfinite(best) & (best <= limit)
            active, pick = active[go], pick[go]
            if not len(active):
                break
            open_[active, pick] = False
            around = self.near[pick]
            dots = np.einsum("ijk,ik->ij", self.centres[around], points[active])
            new = np.sqrt(np.maximum(0, lengths[active][:, None] + norms[around] - 2 * dots))
            rows = active[:, None]
            fresh = np.isinf(far[rows, around])
            far[rows, around] = np.where(fresh, new, far[rows, around])
            open_[rows, around] |= fresh
        for row in far:
            known = np.flatnonzero(np.isfinite(row))
            known = known[np.argsort(row[known], kind="stable")]
            yield known, row[known]


def postings(graph: CentroidGraph, points: np.ndarray, boundary: float) -> list[np.ndarray]:
    """Clusters of each point: the nearest, and others nearly as near."""
    found = graph.search(points, 4 * REPLICAS)
    return [near[: REPLICAS][far[:REPLICAS] <= far[0] * (1 + boundary) + 1e-12] for near, far in found]


def probes(graph: CentroidGraph, points: np.ndarray, ratio: float, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """Clusters whose lists a query visits: all within the ratio, and as many as hold k + 1 vectors for sure."""
    out = []
    for near, far in graph.search(points, 8, ratio):
        inside = int((far <= far[0] * ratio + 1e-12).sum())
        enough = int(np.searchsorted(np.cumsum(sizes[near]), REPLICAS * (k + 1))) + 1
        if enough > len(near):  # the graph walk saw too few
            rest = np.setdiff1d(np.arange(len(sizes)), near)
            near = np.concatenate([near, rest])
            enough = int(np.searchsorted(np.cumsum(sizes[near]), REPLICAS * (k + 1))) + 1
        out.append(near[: max(inside, enough)])
    return out


def fit_ratio(graph: CentroidGraph, rows: np.ndarray, norm: float, boundary: float, k: int, target: float, queries: int = 200) -> float:
    """Smallest ratio with which sample queries reach ``target`` of their true neighbours in the sample."""
    if len(graph.centres) < 2:
        return 1.0
    points = lifted(rows, norm)
    posted = postings(graph, points, boundary)
    asked = rows[:: max(1, len(rows) // queries)]
    aim = pointed(asked)
    need = []
    for q, raw in zip(aim, asked):
        scores = rows @ raw
        best = np.argsort(-scores, kind="stable")[1 : k + 1]
        far = np.sqrt(_squared(q[None], graph.centres))[0]
        need += [far[posted[x]].min() / max(far.min(), 1e-12) for x in best.tolist()]
    return float(np.quantile(need, target, method="higher")) + 1e-6


def _scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed component by component: equal vectors score equal wherever they lie."""
    total = np.zeros(len(rows))
    for c in range(rows.shape[1]):
        total += query[c] * rows[:, c]
    return total


def _visit(lists: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one group of lists for every query that visits it."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(lists) or not len(asked):
        return empty
    lists = lists.sort_values(["vec_id", "list"], kind="stable")
    names = {x: i for i, x in enumerate(sorted(lists["list"].unique()))}
    ids, first = np.unique(lists["vec_id"].to_numpy(), return_index=True)
    vectors = np.stack(lists["vec"].to_numpy()[first]).astype(np.float64)
    member = np.zeros((len(names), len(ids)), bool)
    member[lists["list"].map(names).to_numpy(), np.searchsorted(ids, lists["vec_id"].to_numpy())] = True
    raw = np.stack(asked["vec"].to_numpy()).astype(np.float64)
    out = []
    for at in range(0, len(asked), 128):
        part = raw[at : at + 128]
        rough = part @ vectors.T
        for i, visited in enumerate(asked["lists"].iloc[at : at + 128]):
            own = int(asked["query_id"].iloc[at + i])
            some = np.flatnonzero(member[[names[x] for x in visited if x in names]].any(0) & (ids != own))
            if len(some) > k:
                line = rough[i, some]
                slack = 1e-9 * (1 + np.abs(line).max())
                some = some[line >= np.partition(line, len(line) - k)[len(line) - k] - slack]
            exact = _scores(part[i], vectors[some])
            best = np.lexsort((ids[some], -exact))[:k]
            out.append((np.full(len(best), own), ids[some[best]], exact[best]))
    q, v, s = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})


def search(
    queries: DataFrame, rows: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", list_size: int = 256,
    sample: int = 20_000, boundary: float = 0.05, target: float = 0.97, group_rows: int = 16_384, seed: int = 3,
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: of each query its ``k`` best found by inner product, itself excluded.

    Unusable vectors (null, zero, null or non-finite components), null keys, and vectors of a length other than the most
    common one take no part, as query or candidate.  Ties go to the smaller key; rows that repeat a key count once (any
    one of equal rows; of different vectors under one key the better).  Fewer candidates than ``k`` are all returned.

    ``sample`` bounds the rows (collected, by hash) on which centroids and the pruning ratio are fitted; every row is
    indexed.  The table has a list for every ``list_size`` rows, but no more than one for 16 rows of the sample.
    """
    spark = rows.sparkSession
    steps = Steps(spark)
    clean = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        usable("vec") & F.col("vec_id").isNotNull()
    )
    points, asked = clean(rows), clean(queries)
    shape = points.groupBy(F.size("vec").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")
    ).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, norm = shape["d"], shape["n"], shape["norm"]
    points, asked = points.where(F.size("vec") == d), asked.where(F.size("vec") == d)
    share = min(1.0, sample / n)
    drawn = points if share == 1 else points.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_003)) < share * 1_000_003)
    taken = np.array([r["vec"] for r in drawn.orderBy("vec_id").collect()], np.float64).reshape(-1, d)
    clusters = max(1, min(math.ceil(n / list_size), len(taken) // 16))
    graph = CentroidGraph(balanced_centroids(lifted(taken, norm), clusters, seed))
    ratio = fit_ratio(graph, taken, norm, boundary, k, target)
    model = spark.sparkContext.broadcast(graph)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                lists = postings(model.value, lifted(raw, norm), boundary)
                take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(take), part.column("vec").take(take), pa.array(np.concatenate(lists), pa.int32())],
                    ["vec_id", "vec", "list"],
                )

    index = steps.write(points.mapInArrow(post, "vec_id long, vec array<double>, list int"), "postings")
    sizes = np.zeros(clusters, np.int64)
    for r in index.groupBy("list").count().collect():  # one number per centroid
        sizes[r["list"]] = r["count"]
    # Neighbouring lists share a group of about group_rows postings; a larger list has several groups of its own.
    order = _tour(graph.centres)
    group_of, parts = np.zeros(clusters, np.int64), np.ones(clusters, np.int64)
    group, held = 0, 0
    for c in order.tolist():
        if sizes[c] > group_rows or held + sizes[c] > group_rows:
            group += held > 0
            held = 0
        group_of[c] = group
        if sizes[c] > group_rows:
            parts[c] = math.ceil(sizes[c] / group_rows)
            group += int(parts[c])
        else:
            held += int(sizes[c])
    plan = spark.sparkContext.broadcast((group_of, parts, sizes))
    first, cut = (F.array(*[F.lit(int(x)) for x in values]) for values in (group_of, parts)) if clusters <= 64 else (None, None)
    table = spark.createDataFrame([(c, int(group_of[c]), int(parts[c])) for c in range(clusters)], "list int, first long, parts long")
    placed = index.join(table, "list") if first is None else index.withColumns({"first": first[F.col("list")], "parts": cut[F.col("list")]})
    placed = placed.withColumn("group", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("long")).select("group", "list", "vec_id", "vec")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, parts, sizes = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                take, groups, lists = [], [], []
                for i, near in enumerate(probes(model.value, pointed(raw), ratio, sizes, k)):
                    visits: dict[int, list[int]] = {}
                    for c in near.tolist():
                        for g in range(group_of[c], group_of[c] + parts[c]):
                            visits.setdefault(int(g), []).append(c)
                    take += [i] * len(visits)
                    groups += visits
                    lists += visits.values()
                at_ = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups, pa.int64()), part.column("vec_id").take(at_), part.column("vec").take(at_),
                     pa.array(lists, pa.list_(pa.int32()))],
                    ["group", "query_id", "vec", "lists"],
                )

    visiting = asked.mapInArrow(ask, "group long, query_id long, vec array<double>, lists array<int>")
    visiting = visiting.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(4)))  # queries of a group in four tasks
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _visit(left, right, k)

    found = placed.groupBy("group", "turn").cogroup(visiting.groupBy("group", "turn")).applyInPandas(visit, FOUND)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _tour(centres: np.ndarray) -> np.ndarray:
    """Centroids in an order that keeps neighbours together: by their place along the widest directions."""
    if len(centres) < 3:
        return np.arange(len(centres))
    middle = centres - centres.mean(0)
    _, _, axes = np.linalg.svd(middle, full_matrices=False)
    along = middle @ axes[:2].T
    strips = np.argsort(np.argsort(along[:, 0])) * max(1, int(math.sqrt(len(centres)))) // len(centres)
    return np.lexsort((along[:, 1], strips))
