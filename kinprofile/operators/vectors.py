"""Feature tables and the weighted distinct-vector table.

Rows are collapsed once to ``(group, vector, weight)`` with map-side combining, so a
group that holds a third of all rows still sends at most ``spec.max_vectors`` rows per
map task.  Everything after this step is independent of the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec


def encode(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Row level: group, row id, one code per feature and the vector id. No shuffle."""
    coded = df.select(
        F.col(spec.group), F.col(spec.row_id), *[f.encode().alias(f.code) for f in spec.features]
    )
    return coded.withColumn("vid", spec.vector_id())


def distinct_vectors(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per (group, vector): codes, weight ``w``, smallest row id, group size ``n``
    and ordinals scaled by the largest absolute level present in the group.

    The key of the big aggregation is just (group, vid); the codes are read back from it.
    """
    collapsed = (
        encode(df, spec)
        .groupBy(spec.group, "vid")
        .agg(F.count(F.lit(1)).alias("w"), F.min(spec.row_id).alias("first_row"))
        .withColumns(spec.codes_of_vector())
    )
    return with_scaling(collapsed, spec)


def with_scaling(vectors: DataFrame, spec: FeatureSpec, keys: list[str] | None = None) -> DataFrame:
    """Attach group size and max-abs scaled ordinals (a group whose levels are all 0 stays 0)."""
    within = Window.partitionBy(*(keys or [spec.group]))
    out = vectors.withColumn("n", F.sum("w").over(within))
    for o in spec.ordinals:
        top = F.max(F.abs(F.col(o.code))).over(within)
        out = out.withColumn(f"{o.name}_scale", F.when(top == 0, F.lit(1.0)).otherwise(top.cast("double")))
        out = out.withColumn(o.scaled, F.col(o.code) / F.col(f"{o.name}_scale"))
    return out


def vector_table(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``distinct_vectors`` written once, to be read by every later step.

    The table is small but the work per row is not (all models meet every vector), so it is
    written in several files: later scans then use many tasks.
    """
    return materialise(distinct_vectors(df, spec), "vectors", files=scan_tasks(df, spec))


def scan_tasks(df: DataFrame, spec: FeatureSpec) -> int:
    """Files for a vector table: one per core, but at least some hundred vectors each."""
    return min(df.sparkSession.sparkContext.defaultParallelism, max(8, spec.max_vectors // 256))


def feature_table(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Wide row-level feature table: scaled ordinals and one-hot doubles.

    Only the per-group maxima (a two-column table) meet the rows again; they are written
    first so that the join is planned from their measured size.
    """
    coded = encode(df, spec)
    tops = materialise(
        coded.groupBy(spec.group).agg(*[F.max(F.abs(F.col(o.code))).alias(f"{o.name}_top") for o in spec.ordinals]),
        "scales",
    ) if spec.ordinals else None
    joined = coded.join(tops, spec.group) if tops is not None else coded
    return joined.select(
        spec.group,
        spec.row_id,
        *[
            (F.col(o.code) / F.greatest(F.col(f"{o.name}_top"), F.lit(1))).alias(o.name)
            for o in spec.ordinals
        ],
        *[(F.col(f.code) == level).cast("double").alias(name) for f, level, name in spec.one_hot],
    )


def categories(vectors: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add the readable label of every feature next to its code."""
    return vectors.withColumns({f.name: f.decode(F.col(f.code)) for f in spec.features})


def dense(rows: pd.DataFrame, spec: FeatureSpec) -> np.ndarray:
    """Scaled one-hot matrix of coded vectors, for work on a block inside a task."""
    x = np.zeros((len(rows), len(spec.one_hot) + len(spec.ordinals)))
    for f in spec.nominals:
        code = rows[f.code].to_numpy()
        some = np.flatnonzero(code >= 0)
        x[some, spec.offsets[f.name] + code[some]] = 1.0
    for i, o in enumerate(spec.ordinals):
        x[:, len(spec.one_hot) + i] = rows[o.scaled].to_numpy()
    return x


# The expressions below are wide (one term per feature or level), so they are written as SQL
# text: one parse per expression instead of one driver call per term.


def one_hot_sql(spec: FeatureSpec) -> str:
    """The scaled vector as an array: one-hot block first, then the ordinals."""
    parts = [f"CAST({f.code} = {level} AS DOUBLE)" for f, level, _ in spec.one_hot]
    return f"array({', '.join(parts + [o.scaled for o in spec.ordinals])})"


def squared_distance_sql(spec: FeatureSpec, centre: str, norm: str) -> str:
    """Squared Euclidean distance of a coded vector to a dense centre array.

    ``norm`` is the squared norm of the one-hot block of the centre.  Only one array
    element per feature is touched instead of one per one-hot column.
    """
    terms = [norm]
    for f in spec.nominals:
        hit = f"get({centre}, {f.code} + {spec.offsets[f.name]})"
        terms.append(f"CASE WHEN {f.code} >= 0 THEN 1D - 2D * {hit} ELSE 0D END")
    for i, o in enumerate(spec.ordinals):
        gap = f"({o.scaled} - get({centre}, {len(spec.one_hot) + i}))"
        terms.append(f"{gap} * {gap}")
    return f"greatest(0D, {' + '.join(terms)})"


def block_norm_sql(spec: FeatureSpec, centre: str) -> str:
    """Squared norm of the one-hot block of a centre array."""
    return f"aggregate(slice({centre}, 1, {len(spec.one_hot)}), 0D, (total, x) -> total + x * x)"


def level_sums_sql(spec: FeatureSpec) -> list[str]:
    """Weighted rows per one-hot column."""
    return [f"sum(CASE WHEN {f.code} = {level} THEN w ELSE 0 END)" for f, level, _ in spec.one_hot]
