"""Two-dimensional projection table for plotting: principal components of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinprofile.operators.sampling import SEED, sample_rows
from kinprofile.session import materialise

SAMPLE = 10_000


def whole(features: str) -> Column:
    """Neither null nor empty, without null or non-finite entries (null counts as false)."""
    finite = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(features) > 0), F.lit(False))


def group_moments(df: DataFrame, group: str, features: str) -> DataFrame:
    """(group, d, cell, value): sums of 1, x and x x' of every group and vector length.

    A task adds up its own rows and sends one row per group and cell, whatever the number of rows; Spark adds the cells.
    """
    kind, of_group = df.schema[group].dataType.simpleString(), to_arrow_type(df.schema[group].dataType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, values = names.indices.to_numpy(), names.dictionary.to_pylist()
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy()
            first = np.concatenate([[0], np.cumsum(ends)])
            for code, d in {*zip(codes.tolist(), ends.tolist())}:
                rows = np.flatnonzero((codes == code) & (ends == d))
                x = np.c_[np.ones(len(rows)), flat[first[rows][:, None] + np.arange(d)]]
                key = (values[code], d)
                sums[key] = sums.get(key, 0.0) + (x.T @ x)
        for (name, d), gram in sums.items():
            cells = pa.array([gram.ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([name], of_group), pa.array([d], pa.int32()), cells], ["group", "d", "sums"])

    rows = df.select(F.col(group).alias("group"), F.col(features).cast("array<double>").alias("x")).where(whole("x"))
    parts = rows.mapInArrow(add, f"group {kind}, d int, sums array<double>")
    cells = parts.select("group", "d", F.posexplode("sums").alias("cell", "value"))
    return cells.groupBy("group", "d", "cell").agg(F.sum("value").alias("value"))


def principal_axes(df: DataFrame, group: str, features: str, k: int = 2) -> DataFrame:
    """(group, d, n, mean, total, axes, variances): the ``k`` leading eigenvectors of each group's covariance (divisor n).

    One row per group and vector length, computed from (d + 1) x (d + 1) sums.  The largest loading of an axis is
    positive.  A group with fewer than ``k`` columns has that many axes.
    """
    kind = df.schema[group].dataType.simpleString()

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        d = int(part["d"].iloc[0])
        gram = part.sort_values("cell")["value"].to_numpy().reshape(d + 1, d + 1)
        n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
        spread = gram[1:, 1:] / n - np.outer(mean, mean)
        values, vectors = np.linalg.eigh(spread)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        return pd.DataFrame({
            "group": [part["group"].iloc[0]], "d": [d], "n": [int(round(n))], "mean": [mean.tolist()], "total": [np.trace(spread)],
            "axes": [vectors.T.tolist()], "variances": [np.maximum(values, 0.0).tolist()],
        })

    schema = f"group {kind}, d int, n long, mean array<double>, total double, axes array<array<double>>, variances array<double>"
    return group_moments(df, group, features).groupBy("group", "d").applyInPandas(solve, schema)


def projection_2d(
    df: DataFrame, group: str, row_id: str, features: str, label: str, highlight: str, size: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(group, row_id, x, y, label, highlight) of a sample of rows per group.

    Every group has its own components, fitted on all its rows (``features`` is an array of numbers) and centred on its
    mean; the sample only limits the points shown.  Rows without a usable vector are shown with null coordinates, vectors
    of different length have components of their own, and a single column gives a null ``y``.
    """
    axes = materialise(principal_axes(df, group, features), "axes")  # one row per group
    shown = sample_rows(df, group, row_id, size, seed).withColumn("_v", F.col(features).cast("array<double>"))
    axes = axes.select(F.col("group").alias("_g"), "d", F.col("mean").alias("_mean"), F.col("axes").alias("_axes"))
    fits = F.col(group).eqNullSafe(F.col("_g")) & whole("_v") & (F.size("_v") == F.col("d"))
    centred = F.zip_with("_v", "_mean", lambda a, m: a - m)

    def along(axis: int) -> Column:
        products = F.zip_with(centred, F.get("_axes", F.lit(axis)), lambda c, w: c * w)
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return shown.join(axes, fits, "left").select(
        group, row_id, along(0).alias("x"), along(1).alias("y"), F.col(label).alias("label"), F.col(highlight).alias("highlight")
    )
