"""Neighbourhood operators in the coded feature space, without comparing vectors in pairs.

The squared distance of two vectors is a sum of one term per feature: 0 or 2 for a
nominal feature (1 when exactly one side is the all-zero level), and the squared scaled
gap of an ordinal one.  Two consequences carry all of this module:

* A sum, a minimum or a maximum over all partners of a vector can be taken one feature at
  a time (``neighbour_counts``, ``extreme_distance``).  Each step swaps one code column
  from "partner" to "own" value and aggregates, so the intermediate tables stay within the
  grid of declared levels and every aggregation combines on the map side.
* Vectors that share a *block* (same value, any value, or an interval of levels, per
  feature) are all within the block's cost of each other.  The epsilon graph is therefore a
  union of such blocks (``blocks_within``), and connected components or labels spread
  through vector-to-block rows instead of vector-to-vector edges.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec, Nominal, Ordinal


def _nominal_cost(own: Column, other: Column) -> Column:
    return F.when(own == other, 0).when((own == -1) | (other == -1), 1).otherwise(2)


def _gap(o: Ordinal) -> str:
    return f"{o.name}_gap"


def distance(spec: FeatureSpec, nominal_cost: Column, gaps: list[Column]) -> Column:
    """Euclidean distance from the integer parts; the one formula used by every operator,
    so that "equal distance" and "within eps" always mean the same double."""
    total = nominal_cost.cast("double")
    for o, gap in zip(spec.ordinals, gaps):
        scaled = gap.cast("double") / F.col(f"{o.name}_scale")
        total = total + scaled * scaled
    return F.sqrt(total)


def _by_size(spec: FeatureSpec) -> list[Nominal | Ordinal]:
    """Features in processing order: the one with most levels last, where the swapped
    values are whole vectors and nothing is kept between steps any more."""
    last = max(spec.features, key=lambda f: len(f.codes))
    return [f for f in spec.features if f is not last] + [last]


def _own_values(
    state: DataFrame, asked: DataFrame, keys: list[str], done: list[str], f: Nominal | Ordinal, names: list[str]
) -> DataFrame:
    """Pair the partner's level of ``f`` with the own levels that occur (column ``own``).

    ``done`` are the code columns already swapped to own values; only prefixes of asked
    vectors go on, so the table never outgrows asked prefixes times partner suffixes.
    """
    prefixes = asked.select(*keys, *done, F.col(f.code).alias("own"), *names)
    return state.join(prefixes if names else prefixes.distinct(), [*keys, *done])


def neighbour_counts(vectors: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Exact distance histogram of every vector: (group, vid, w, n, first_row, dist, cnt).

    ``cnt`` is the number of rows at exactly ``dist``, the vector's own rows included.
    """
    gaps, order = [_gap(o) for o in spec.ordinals], _by_size(spec)
    names = ["vid", "w", "n", "first_row"]
    scales = [f"{o.name}_scale" for o in spec.ordinals]
    state = vectors.select(
        spec.group, *spec.code_columns, F.col("w").alias("cnt"), F.lit(0).alias("m"),
        *[F.lit(0).alias(g) for g in gaps],
    )
    for f in order:
        final = f is order[-1]
        done = [x.code for x in order[:order.index(f)]]
        state = _own_values(state, vectors, [spec.group], done, f, [*names, *scales] if final else [])
        if isinstance(f, Nominal):
            state = state.withColumn("m", F.col("m") + _nominal_cost(F.col("own"), F.col(f.code)))
        else:
            state = state.withColumn(_gap(f), F.abs(F.col("own") - F.col(f.code)))
        if not final:
            state = (
                state.withColumn(f.code, F.col("own"))
                .groupBy(spec.group, *spec.code_columns, "m", *gaps)
                .agg(F.sum("cnt").alias("cnt"))
            )
    return (
        state.withColumn("dist", distance(spec, F.col("m"), [F.col(g) for g in gaps]))
        .groupBy(spec.group, *names, "dist")
        .agg(F.sum("cnt").alias("cnt"))
    )


def kth_distance(counts: DataFrame, spec: FeatureSpec, k: Column) -> DataFrame:
    """Distance to the k-th nearest row (own row counted) per vector, from its histogram."""
    ordered = Window.partitionBy(spec.group, "vid").orderBy("dist")
    return (
        counts.withColumn("reached", F.sum("cnt").over(ordered))
        .filter(F.col("reached") >= k)
        .groupBy(spec.group, "vid", "w", "n", "first_row")
        .agg(F.min("dist").alias("kdist"))
    )


def extreme_distance(
    members: DataFrame, asked: DataFrame, spec: FeatureSpec, keys: list[str], names: list[str], farthest: bool
) -> DataFrame:
    """Largest (or smallest) squared distance from each asked vector to the members of its key.

    ``members`` carries ``keys``, the code columns and the ordinal scales; ``asked`` carries
    ``keys``, the code columns and ``names``, which identify a vector in the result
    (keys, names, sq).  One max-plus (or min-plus) step per feature.
    """
    pick, order = F.max if farthest else F.min, _by_size(spec)
    scales = [f"{o.name}_scale" for o in spec.ordinals]
    state = members.select(*keys, *spec.code_columns, *scales).distinct().withColumn("sq", F.lit(0.0))
    for f in order:
        final = f is order[-1]
        done = [x.code for x in order[:order.index(f)]]
        state = _own_values(state, asked, keys, done, f, names if final else [])
        if isinstance(f, Nominal):
            cost = _nominal_cost(F.col("own"), F.col(f.code)).cast("double")
        else:
            step = F.abs(F.col("own") - F.col(f.code)).cast("double") / F.col(f"{f.name}_scale")
            cost = step * step
        state = state.withColumn("sq", F.col("sq") + cost)
        if final:
            return state.groupBy(*keys, *names).agg(pick("sq").alias("sq"))
        state = (
            state.withColumn(f.code, F.col("own"))
            .groupBy(*keys, *spec.code_columns, *scales)
            .agg(pick("sq").alias("sq"))
        )
    raise ValueError("the specification has no features")


def blocks_within(vectors: DataFrame, radii: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Vector-to-block rows of the radius graph: (group, eps, vid, block).

    ``radii`` holds (group, eps).  Two vectors share a block exactly when their distance is
    at most eps.  Only blocks that cannot be widened within eps are kept, so the result
    has a handful of rows per vector even when the graph is dense.
    """
    ranges = vectors.groupBy(spec.group).agg(
        *[F.first(f"{o.name}_scale").alias(f"{o.name}_scale") for o in spec.ordinals],
        *[F.min(o.code).alias(f"{o.name}_lo") for o in spec.ordinals],
        *[F.max(o.code).alias(f"{o.name}_hi") for o in spec.ordinals],
        F.lit(0).alias("m"),
    )
    shapes = radii.join(ranges, spec.group)
    widths = [F.lit(0) for _ in spec.ordinals]
    kinds = {f.name: ((0, 1, 2) if f.dropped is not None else (0, 2)) for f in spec.nominals}
    for f in spec.nominals:
        shapes = (
            shapes.withColumn(f"{f.name}_kind", F.explode(F.array(*map(F.lit, kinds[f.name]))))
            .withColumn("m", F.col("m") + F.col(f"{f.name}_kind"))
            .filter(distance(spec, F.col("m"), widths) <= F.col("eps"))
        )
    for i, o in enumerate(spec.ordinals):
        shapes = shapes.withColumn(
            f"{o.name}_width", F.explode(F.sequence(F.lit(0), F.col(f"{o.name}_hi") - F.col(f"{o.name}_lo")))
        )
        widths[i] = F.col(f"{o.name}_width")
        shapes = shapes.filter(distance(spec, F.col("m"), widths) <= F.col("eps"))
    widest = F.lit(True)
    for f in spec.nominals:
        kind = F.col(f"{f.name}_kind")
        step = 1 if f.dropped is not None else 2
        fits = (kind < 2) & (distance(spec, F.col("m") + step, widths) <= F.col("eps"))
        widest = widest & ~fits
    for i, o in enumerate(spec.ordinals):
        wider = [w + 1 if j == i else w for j, w in enumerate(widths)]
        room = widths[i] < F.col(f"{o.name}_hi") - F.col(f"{o.name}_lo")
        widest = widest & ~(room & (distance(spec, F.col("m"), wider) <= F.col("eps")))
    kinds_cols = [f"{f.name}_kind" for f in spec.nominals]
    width_cols = [f"{o.name}_width" for o in spec.ordinals]
    bound_cols = [f"{o.name}_{end}" for o in spec.ordinals for end in ("lo", "hi")]
    shapes = materialise(
        shapes.filter(widest).select(spec.group, "eps", *kinds_cols, *width_cols, *bound_cols), "shapes"
    )
    placed = vectors.select(spec.group, "vid", *spec.code_columns).join(shapes, spec.group)
    # (radix, digit) pairs that number a block exactly
    digits = []
    for f in spec.nominals:
        kind, code, part = F.col(f"{f.name}_kind"), F.col(f.code), f"{f.name}_part"
        if f.dropped is not None:
            # the all-zero level pairs with each other level in a block of cost 1
            own = F.when(
                (kind == 1) & (code == -1), F.array(*[F.lit(c) for c in f.codes if c >= 0])
            ).when(kind == 2, F.array(F.lit(None).cast("int"))).otherwise(F.array(code))
            placed = placed.withColumn(part, F.explode(own))
        else:
            placed = placed.withColumn(part, F.when(kind == 0, code))
        width = len(f.codes) + 1
        digits.append((3 * width, kind * width + F.coalesce(F.col(part) + 1, F.lit(width - 1))))
    for o in spec.ordinals:
        width, code, part = F.col(f"{o.name}_width"), F.col(o.code), f"{o.name}_part"
        lo = F.greatest(F.col(f"{o.name}_lo"), code - width)
        hi = F.least(F.col(f"{o.name}_hi") - width, code)
        placed = placed.withColumn(part, F.explode(F.sequence(lo, hi)))
        span = max(o.codes) - min(o.codes) + 1
        digits.append((span * span, width * span + F.col(part) - min(o.codes)))
    if prod(radix for radix, _ in digits) < 2**62:
        block = F.lit(0).cast("bigint")
        for radix, digit in digits:
            block = block * radix + digit
    else:
        block = F.concat_ws(",", *[digit for _, digit in digits])
    return placed.select(spec.group, "eps", "vid", block.alias("block"))


def spread_labels(
    cores: DataFrame, links: DataFrame, keys: list[str], passes: int = 2
) -> DataFrame:
    """Connected components of vectors that share blocks: (keys, vid, label).

    ``cores`` holds (keys, vid, label) with labels unique per key; each component ends with
    its smallest label.  A column ``start`` may hold a label already known to be in the vector's component.  Blocks with a single core vector join nothing and are left out.  A
    pass takes the smallest label per block and then per vector, so labels only ever fall.
    A label is the first row of some core vector, so a pass ends with a shortcut: every vector takes
    over the label that the vector behind its label has by now.  Shortcuts double the reach of a label each
    time, so the number of jobs follows the logarithm of a component's diameter.  A job chains a few passes, writes
    the state to the shared folder and the loop ends once the sum of the labels' hashes rests (ids may be text).
    """
    known = F.least("label", "start") if "start" in cores.columns else F.col("label")
    cores = materialise(cores.select(*keys, "vid", "label", known.alias("start")), "cores")
    inside = links.join(cores.select(*keys, "vid"), [*keys, "vid"]).select(*keys, "vid", "block")
    shared = inside.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("vectors")).filter("vectors > 1")
    links = materialise(inside.join(shared, [*keys, "block"], "left_semi"), "links")
    owner = cores.select(*keys, "vid", F.col("label").alias("own"))
    state, total = cores.select(*keys, "vid", F.col("start").alias("label")), None
    while True:
        for _ in range(passes):
            by_block = links.join(state, [*keys, "vid"]).groupBy(*keys, "block").agg(F.min("label").alias("label"))
            state = links.join(by_block, [*keys, "block"]).groupBy(*keys, "vid").agg(F.min("label").alias("label"))
        state = materialise(state, "labels")
        for _ in range(2):
            behind = state.join(owner, [*keys, "vid"]).select(*keys, F.col("own").alias("label"), F.col("label").alias("further"))
            state = state.join(behind, [*keys, "label"], "left").select(
                *keys, "vid", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        state = materialise(state, "labels")
        before, total = total, state.agg(F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            linked = state.withColumnRenamed("label", "low")
            return cores.join(linked, [*keys, "vid"], "left").select(
                *keys, "vid", F.coalesce("low", "start").alias("label")
            )
