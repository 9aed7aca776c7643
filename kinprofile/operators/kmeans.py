"""Grouped weighted K-Means: every (group, K, start) model advances at the same time.

Vectors of a unit lie in blocks of at most about ``BLOCK``.  A task multiplies a block (dense, one-hot) with the centres of
all models of the unit and adds up what each cluster holds.  A unit of one block - nearly all are, since it has distinct
vectors, not rows - is seeded and iterated to rest inside its task, one task per start.  A larger one takes a job per drawn
seed and per step; its blocks give partial sums that are combined on the map side, and only centres travel back.  Both
ways use the same code for a block and draw the same seeds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.operators import resampling
from kinprofile.operators.metrics import adjusted_rand, best_row, model_report
from kinprofile.operators.vectors import block_norm_sql, dense, level_sums_sql, scan_tasks, squared_distance_sql, with_scaling
from kinprofile.session import materialise, tasks_apart
from kinprofile.spec import FeatureSpec

K_RANGE = tuple(range(2, 11))
N_INIT = 10
MAX_ITER = 300
TOL = 1e-5
SEED = 42
BLOCK = 8192


def _centre_sql(spec: FeatureSpec, at: str) -> str:
    """Centre struct with the squared norm of its one-hot block."""
    return f"named_struct('at', {at}, 'norm', {block_norm_sql(spec, at)})"


def _race(vid: np.ndarray, weight: np.ndarray, start: int, turn: int, seed: int) -> np.ndarray:
    """Exponential race: the smallest value falls on a vector with chance in proportion to ``weight``."""
    stream = ((seed * 1_000_003 + turn) * 1_000_003 + start) * 0x9E3779B97F4A7C15
    z = vid.astype(np.uint64) + np.uint64(stream & 0xFFFFFFFFFFFFFFFF)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xBF58476D1CE4E5B9)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(odd)
    u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, -np.log(u) / weight, np.inf)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1), 0.0)


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance to one centre, 0 exactly for equal vectors."""
    gap = x - centre
    return (gap * gap).sum(1)


def _held(x: np.ndarray, w: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weight and weighted sum of the vectors nearest to each centre (the first of equal ones), and their squared error."""
    squares = _squares(x, centres)
    label = squares.argmin(1)
    mine = np.zeros(squares.shape)
    mine[np.arange(len(x)), label] = w
    return mine.sum(0), mine.T @ x, float(w @ squares[np.arange(len(x)), label])


def _moved(centres: np.ndarray, weight: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    return np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-300)[:, None], centres)


def _seeds(x: np.ndarray, w: np.ndarray, vid: np.ndarray, k: int, start: int, seed: int) -> np.ndarray:
    """k-means++ seeds in drawing order; fewer where no vector is left that differs from all."""
    chosen, near = [], np.ones(len(x))
    for turn in range(k):
        race = _race(vid, w * near, start, turn, seed)
        won = int(race.argmin())
        if not np.isfinite(race[won]):
            break
        chosen.append(won)
        apart = _apart(x, x[won])
        near = apart if turn == 0 else np.minimum(near, apart)
    return x[chosen]


def _rest(x: np.ndarray, w: np.ndarray, centres: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, bool]:
    """Lloyd steps until the squared shift of all centres is at most ``tol``."""
    for _ in range(max_iter):
        weight, sums, _ = _held(x, w, centres)
        moved = _moved(centres, weight, sums)
        shift = float(((moved - centres) ** 2).sum())
        centres = moved
        if shift <= tol:
            return centres, True
    return centres, False


def _schema(vectors: DataFrame, units: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(u, vectors.schema[u].dataType) for u in units] + list(more))


_POINT = T.ArrayType(T.DoubleType())
_MODEL = [T.StructField("k", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("centres", T.ArrayType(_POINT))]
_FITTED = [*_MODEL, T.StructField("wcss", T.DoubleType()), T.StructField("settled", T.BooleanType())]


def _fit_whole(vectors: DataFrame, spec: FeatureSpec, units: list[str], n_init: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """All models of units of one block: a task takes one start of a unit through all its K."""
    schema = _schema(vectors, units, *_FITTED)

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vid")
        x, w, start = dense(own, spec), own["w"].to_numpy(float), int(key[-1])
        ks = sorted(own["ks"].iloc[0])
        seeds = _seeds(x, w, own["vid"].to_numpy(), max(ks), start, seed)
        out = []
        for k in ks:
            centres, settled = _rest(x, w, seeds[:k], max_iter, tol)
            out.append((*key[:-1], k, start, centres.tolist(), _held(x, w, centres)[2], settled))
        return pd.DataFrame(out, columns=schema.fieldNames())

    starts = F.explode(F.sequence(F.lit(1), F.lit(n_init))).alias("start")
    dealt = vectors.select(*units, *_carried(spec), "ks", starts).repartition(tasks_apart(vectors), *units, "start")
    return dealt.groupBy(*units, "start").applyInPandas(solve, schema)


def _carried(spec: FeatureSpec) -> list[str]:
    return ["vid", "w", *spec.code_columns, *[o.scaled for o in spec.ordinals]]


def _over_blocks(vectors: DataFrame, models: DataFrame, units: list[str], work, schema: T.StructType) -> DataFrame:
    """``work(key, block, models)`` for every block of a unit with all the unit's models."""
    per_block = models.join(vectors.select(*units, "blocks").distinct(), units)
    per_block = per_block.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    per_block = per_block.select([F.col(c).alias(c) for c in per_block.columns])  # both sides come from the same table
    keys = [*units, "block"]
    return vectors.groupBy(*keys).cogroup(per_block.groupBy(*keys)).applyInPandas(work, schema)


def _stacked(lists) -> np.ndarray:
    return np.array([list(c) for c in lists], float)


def _seed_blocks(vectors: DataFrame, spec: FeatureSpec, units: list[str], n_init: int, seed: int) -> DataFrame:
    """Seeds (units, start, centres) of units of several blocks, one job per seed."""
    keys = [*units, "start"]
    schema = _schema(vectors, units, T.StructField("start", T.IntegerType()), T.StructField("race", T.DoubleType()), T.StructField("point", _POINT))
    most = vectors.groupBy(*units).agg(F.max(F.array_max("ks")).alias("most"))
    starts = F.explode(F.sequence(F.lit(1), F.lit(n_init))).alias("start")
    drawn = materialise(most.select(*units, "most", starts, F.array().cast("array<array<double>>").alias("centres")), "seeds")
    turns = drawn.agg(F.max("most")).first()[0]

    def drawing(turn: int):
        def ahead(key: tuple, own: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own):
                own = own.sort_values("vid")
                x, w, vid = dense(own, spec), own["w"].to_numpy(float), own["vid"].to_numpy()
                for start, centres in zip(models["start"], models["centres"]):
                    near = np.ones(len(x))
                    for i, c in enumerate(_stacked(centres)):
                        near = _apart(x, c) if i == 0 else np.minimum(near, _apart(x, c))
                    race = _race(vid, w * near, int(start), turn, seed)
                    if np.isfinite(race.min()):
                        out.append((*key[:-1], start, race.min(), x[race.argmin()].tolist()))
            return pd.DataFrame(out, columns=schema.fieldNames())

        return ahead

    for turn in range(turns):
        won = _over_blocks(vectors, drawn, units, drawing(turn), schema).groupBy(*keys).agg(F.min_by("point", "race").alias("point"))
        grown = F.when(F.col("point").isNull() | (F.size("centres") >= F.col("most")), F.col("centres"))
        grown = grown.otherwise(F.concat("centres", F.array("point")))
        drawn = materialise(drawn.join(won, keys, "left").select(*units, "most", "start", grown.alias("centres")), "seeds")
    return drawn


def _fit_blocks(vectors: DataFrame, spec: FeatureSpec, units: list[str], n_init: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """All models of units of several blocks: a job per step, cluster sums combined over blocks."""
    keys = [*units, "k", "start"]
    sums = _schema(
        vectors, units, *_MODEL[:2], T.StructField("cluster", T.IntegerType()), T.StructField("at", T.IntegerType()),
        T.StructField("v", T.DoubleType()),
    )

    def hold(key: tuple, own: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(own):
            own = own.sort_values("vid")
            x, w = dense(own, spec), own["w"].to_numpy(float)
            for k, start, centres in zip(models["k"], models["start"], models["centres"]):
                weight, total, error = _held(x, w, _stacked(centres))
                cells = np.c_[weight, total].ravel()  # column 0 is the weight; cluster -1 carries the squared error
                n = np.arange(len(cells))
                part = pd.DataFrame({"cluster": np.r_[n // (x.shape[1] + 1), -1], "at": np.r_[n % (x.shape[1] + 1), 0], "v": np.r_[cells, error]})
                parts.append(part.assign(k=k, start=start))
        out = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("cluster", "at", "v", "k", "start")})
        for u, value in zip(units, key):
            out[u] = value
        return out[sums.fieldNames()]

    after = _schema(vectors, units, *_FITTED, T.StructField("shift", T.DoubleType()))

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        old = _stacked(rows["centres"].iloc[0])
        cells = [c.asDict() if hasattr(c, "asDict") else c for c in rows["cells"].iloc[0]]
        table = np.zeros((len(old), old.shape[1] + 1))
        error = 0.0
        for c in cells:
            if c["cluster"] < 0:
                error = c["v"]
            else:
                table[c["cluster"], c["at"]] = c["v"]
        moved = _moved(old, table[:, 0], table[:, 1:])
        shift = float(((moved - old) ** 2).sum())
        out = rows[keys].copy()
        out["centres"], out["wcss"], out["settled"], out["shift"] = [moved.tolist()], error, shift <= tol, shift
        return out[after.fieldNames()]

    seeds = _seed_blocks(vectors, spec, units, n_init, seed)
    every = seeds.join(vectors.select(*units, "ks").distinct(), units).withColumn("k", F.explode("ks"))
    active = every.select(*keys, F.expr("slice(centres, 1, k)").alias("centres"))
    settled = []
    for step in range(max_iter):
        found = _over_blocks(vectors, active, units, hold, sums).groupBy(*keys, "cluster", "at").agg(F.sum("v").alias("v"))
        listed = found.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "at", "v")).alias("cells"))  # K x columns
        moved = materialise(active.join(listed, keys).groupBy(*keys).applyInPandas(move, after), "centres")
        last = step + 1 == max_iter
        settled.append(moved if last else moved.where("settled"))
        active = moved.where("not settled").select(*keys, "centres")
        if last or active.isEmpty():
            break
    done = reduce(DataFrame.unionByName, settled).select(*keys, "centres", "settled")
    # The squared error belongs to the centres at rest, not to those before the last step.
    error = _over_blocks(vectors, done.drop("settled"), units, hold, sums).where("cluster = -1").groupBy(*keys).agg(F.sum("v").alias("wcss"))
    return done.join(error, keys).select(*keys, "centres", "wcss", "settled")


def assign(vectors: DataFrame, models: DataFrame, spec: FeatureSpec, units: list[str]) -> DataFrame:
    """Nearest centre of every vector under every model (first centre on ties)."""
    apart = squared_distance_sql(spec, "c.at", "c.norm")
    nearest = f"array_min(transform(centres, (c, i) -> named_struct('sq', {apart}, 'label', i)))"
    return vectors.join(models, units).withColumn("hit", F.expr(nearest))


def lloyd_step(vectors: DataFrame, models: DataFrame, spec: FeatureSpec, units: list[str]) -> DataFrame:
    """One weighted Lloyd iteration; an empty cluster keeps its centre.

    The squared shift of all centres of a model is reported as ``shift``.
    """
    keys = [*units, "k", "start"]
    sums = level_sums_sql(spec) + [f"sum(w * {o.scaled})" for o in spec.ordinals]
    moved = (
        assign(vectors, models, spec, units)
        .select(*keys, *spec.code_columns, *[o.scaled for o in spec.ordinals], "w", F.col("hit.label").alias("label"))
        .groupBy(*keys, "label")
        .agg(F.expr(f"transform(array({', '.join(sums)}), x -> x / sum(w))").alias("at"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "at"))).alias("found"))
    )
    renewed = (
        models.select(*keys, F.col("centres").alias("old")).join(moved, keys)
        .withColumn("ats", F.expr("transform(old, (c, i) -> coalesce(element_at(found, i), c.at))"))
    )
    shift = """aggregate(zip_with(old, ats, (a, b) ->
        aggregate(zip_with(a.at, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)), 0D, (s, x) -> s + x)"""
    return renewed.select(
        *keys, F.expr(f"transform(ats, x -> {_centre_sql(spec, 'x')})").alias("centres"), F.expr(shift).alias("shift")
    )


def fit(
    vectors: DataFrame, spec: FeatureSpec, units: list[str], ks: tuple[int, ...] = K_RANGE, n_init: int = N_INIT,
    max_iter: int = MAX_ITER, tol: float = TOL, seed: int = SEED, wanted: DataFrame | None = None,
) -> DataFrame:
    """All models at rest: (units, k, start, centres, wcss, settled).

    A model rests when the squared shift of its centres is at most ``tol`` (about 1e-4 of the mean variance of a one-hot
    column).  ``settled`` is false for a model that ``max_iter`` steps have not brought to rest.  A unit with fewer distinct
    vectors than K keeps fewer centres.  ``wanted`` (units, k) restricts which K each unit runs.
    """
    sizes = vectors.groupBy(*units).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # one row per unit
    if wanted is None:
        sizes = sizes.withColumn("ks", F.array(*map(F.lit, ks)))
    else:
        sizes = sizes.join(wanted.groupBy(*units).agg(F.collect_set("k").cast("array<int>").alias("ks")), units)
    sizes = materialise(sizes, "blocks")
    blocked = vectors.join(sizes, units).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    found = _fit_whole(blocked.where("blocks = 1"), spec, units, n_init, max_iter, tol, seed)
    if not sizes.where("blocks > 1").isEmpty():
        found = found.unionByName(_fit_blocks(blocked.where("blocks > 1"), spec, units, n_init, max_iter, tol, seed))
    return found


def kmeans(
    vectors: DataFrame, spec: FeatureSpec, ks: tuple[int, ...] = K_RANGE, n_init: int = N_INIT,
    max_iter: int = MAX_ITER, seed: int = SEED, units: list[str] | None = None, wanted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Best of ``n_init`` starts for every (units, k).

    Returns members (units, k, vid, label, w) and curve (units, k, wcss, settled). ``wanted`` (units, k) restricts which K
    each unit runs.
    """
    units = units or [spec.group]
    fitted = materialise(fit(vectors, spec, units, ks, n_init, max_iter, seed=seed, wanted=wanted), "fitted")
    best = best_row(fitted, [*units, "k"], [F.col("wcss"), F.col("start")])
    best = materialise(best.withColumn("centres", F.expr(f"transform(centres, x -> {_centre_sql(spec, 'x')})")), "best")
    members = assign(vectors, best.select(*units, "k", "centres"), spec, units).select(
        *units, "k", "vid", F.col("hit.label").alias("label"), "w"
    )
    return materialise(members, "kmeans-members"), best.select(*units, "k", "wcss", "settled")


def kmeans_sweep(
    vectors: DataFrame, spec: FeatureSpec, ks: tuple[int, ...] = K_RANGE, n_init: int = N_INIT
) -> tuple[DataFrame, DataFrame]:
    """Members and the sweep table (group, k, wcss, sizes, silhouette, davies_bouldin, dunn)."""
    members, curve = kmeans(vectors, spec, ks, n_init)
    report = model_report(members, vectors, spec, [spec.group, "k"])
    return members, report.join(curve, [spec.group, "k"])


def bootstrap_stability(
    vectors: DataFrame, spec: FeatureSpec, members: DataFrame, chosen: DataFrame, replicates: int = 20,
    n_init: int = 5,
) -> DataFrame:
    """ARI of each resampled clustering against the adopted one: (group, replicate, k, ari).

    ``chosen`` is (group, k). Every replicate is one more model key of the grouped fit.
    """
    group, units = spec.group, [spec.group, "replicate"]
    counts = resampling.bootstrap_weights(vectors, group, replicates, SEED).withColumns(spec.codes_of_vector())
    drawn = materialise(with_scaling(counts, spec, units), "bootstrap", files=scan_tasks(vectors, spec))
    wanted = drawn.select(*units).distinct().join(chosen.select(group, "k"), group)
    ks = tuple(sorted(row["k"] for row in chosen.select("k").distinct().collect()))  # at most the swept K
    again, _ = kmeans(drawn, spec, ks, n_init, units=units, wanted=wanted)
    base = members.join(chosen.select(group, "k"), [group, "k"]).select(
        group, "k", "vid", F.col("label").alias("label_a")
    )
    cells = (
        again.withColumnRenamed("label", "label_b").join(base, [group, "k", "vid"])
        .groupBy(*units, "k", "label_a", "label_b").agg(F.sum("w").alias("cnt"))
    )
    return adjusted_rand(cells, [*units, "k"], "label_a", "label_b").select(*units, "k", "ari")


def stability_summary(scores: DataFrame, group: str) -> DataFrame:
    from kinprofile.functions.scalar import stability_reading

    return scores.groupBy(group, "k").agg(
        F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.count(F.lit(1)).alias("replicates")
    ).withColumn("reading", stability_reading(F.col("mean_ari")))
