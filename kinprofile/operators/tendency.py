"""Hopkins statistic of every group and run in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.functions.scalar import hopkins_reading
from kinprofile.operators.neighbours import extreme_distance
from kinprofile.operators.sampling import SEED, sample_positions
from kinprofile.operators.vectors import block_norm_sql, squared_distance_sql
from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec

SAMPLE = 150
RUNS = 10
STRIPS = 256


def _sampled_vectors(vectors: DataFrame, positions: DataFrame, group: str) -> DataFrame:
    """Rows drawn from every vector: (group, run, vid, taken).

    A vector covers the positions between the weight before it and the weight up to it.  The running weight comes from
    the totals of vector ranges, then from a window inside each range; vectors and positions meet in position ranges,
    at most ``STRIPS`` a group, so no window or join has the group alone as its key.
    """
    spread = F.floor(F.col("vid") / F.greatest(F.lit(1), F.ceil((F.col("high") + 1) / STRIPS))).alias("strip")
    top = vectors.groupBy(group).agg(F.max("vid").alias("high"), F.sum("w").alias("rows"))
    placed = vectors.select(group, "vid", "w").join(top, group).select(group, "vid", "w", "rows", spread)
    totals = placed.groupBy(group, "strip").agg(F.sum("w").alias("total"))
    before = totals.join(
        totals.select(group, F.col("strip").alias("earlier"), F.col("total").alias("part")), group, "left"
    ).groupBy(group, "strip").agg(F.coalesce(F.sum(F.when(F.col("earlier") < F.col("strip"), F.col("part"))), F.lit(0)).alias("before"))
    inside = Window.partitionBy(group, "strip").orderBy("vid")
    upto = placed.join(before, [group, "strip"]).withColumn("upto", F.col("before") + F.sum("w").over(inside))
    width = F.greatest(F.lit(1), F.ceil(F.col("rows") / STRIPS)).cast("bigint")
    covers = upto.select(
        group, "vid", (F.col("upto") - F.col("w")).alias("low"), "upto", width.alias("width"),
    ).withColumn("strip", F.explode(F.expr("sequence((low + 1) div width, upto div width)")))
    asked = positions.join(top.select(group, width.alias("width")), group).withColumn("strip", F.expr("position div width"))
    met = asked.select(group, "run", "position", "strip").join(covers, [group, "strip"])
    return (
        met.filter("position > low AND position <= upto").groupBy(group, "run", "vid").agg(F.count(F.lit(1)).alias("taken"))
    )


def _box(vectors: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Smallest and largest value of every feature column per group, as arrays."""
    hits = [f"CAST({f.code} = {level} AS DOUBLE)" for f, level, _ in spec.one_hot] + [o.scaled for o in spec.ordinals]
    return vectors.groupBy(spec.group).agg(
        F.expr(f"array({', '.join(f'min({h})' for h in hits)})").alias("low"),
        F.expr(f"array({', '.join(f'max({h})' for h in hits)})").alias("high"),
        F.first("n").alias("n"),
    )


def hopkins_runs(
    vectors: DataFrame, spec: FeatureSpec, sample: int = SAMPLE, runs: int = RUNS, seed: int = SEED
) -> DataFrame:
    """(group, run, h) with h = sum of random distances / (sum of random + sum of real).

    Real points are a sample of rows, measured against the rows left; random points are
    uniform in the group's box.  Groups of at most the sample size have nothing to measure
    against and give no rows.
    """
    group, keys = spec.group, [spec.group, "run"]
    m = F.least(F.lit(sample), F.greatest(F.lit(10), F.floor(F.col("n") / 3))).cast("bigint")
    units = materialise(
        _box(vectors, spec).withColumn("m", m).filter("n > m")
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))),
        "hopkins-units",
    )
    taken = materialise(
        _sampled_vectors(vectors, sample_positions(units.select(*keys, "n", "m"), keys, seed), group), "taken"
    )
    left = vectors.join(units.select(*keys), group).join(taken, [*keys, "vid"], "left").withColumn(
        "left_over", F.col("w") - F.coalesce("taken", F.lit(0))
    )
    left = materialise(left, "hopkins-rest", files=vectors.sparkSession.sparkContext.defaultParallelism)
    rest = left.filter("left_over > 0")
    near = extreme_distance(rest, left.filter("taken > 0"), spec, keys, ["vid", "taken"], farthest=False)
    real = near.groupBy(*keys).agg(F.sum(F.col("taken") * F.sqrt("sq")).alias("real"))
    width = len(spec.one_hot) + len(spec.ordinals)
    u = f"CAST(CAST(conv(substring(md5(concat_ws('|', '{seed}', 'box', {group}, run, i, j)), 1, 13), 16, 10) AS BIGINT) AS DOUBLE) / {2**52}D"
    points = units.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).withColumn(
        "p", F.expr(f"transform(sequence(0, {width - 1}), j -> get(low, j) + {u} * (get(high, j) - get(low, j)))")
    )
    points = materialise(points.select(*keys, "i", "p", F.expr(block_norm_sql(spec, "p")).alias("norm")), "points")
    random = (
        rest.join(points, keys).groupBy(*keys, "i")
        .agg(F.min(F.expr(squared_distance_sql(spec, "p", "norm"))).alias("sq"))
        .groupBy(*keys).agg(F.sum(F.sqrt("sq")).alias("random"))
    )
    return random.join(real, keys).select(
        *keys, (F.col("random") / F.nullif(F.col("random") + F.col("real"), F.lit(0.0))).alias("h")
    )


def hopkins_summary(runs: DataFrame, group: str) -> DataFrame:
    """(group, mean_h, std_h, reading)."""
    return runs.groupBy(group).agg(F.avg("h").alias("mean_h"), F.stddev_pop("h").alias("std_h")).withColumn(
        "reading", hopkins_reading(F.col("mean_h"))
    )


def histogram(df: DataFrame, group: str, value: str, bins: int = 8) -> DataFrame:
    """Equal-width bins between each group's extremes: (group, bin 1..bins, cnt), empty bins with 0.

    The last bin includes its upper edge; a constant group falls into the middle bin, as
    its range is widened by one half on both sides.
    """
    ends = df.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        group, F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    place = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins) + 1
    filled = (
        df.join(ends, group).withColumn("bin", F.least(place, F.lit(bins)).cast("int"))
        .groupBy(group, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    )
    grid = ends.select(group, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(filled, [group, "bin"], "left").select(group, "bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))
