"""Completeness of coded columns: missing, ignored and undecodable shares per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprofile.functions.scalar import stripped

MISSING = ("", "nan", "none", "<na>")
ALERT = 15.0
HIGH_ALERT = 30.0


def is_missing(column: Column) -> Column:
    """Null, blank or one of the textual stand-ins for a missing value."""
    return column.isNull() | F.lower(stripped(column)).isin(*MISSING)


def is_ignored(column: Column, codes: Sequence[str]) -> Column:
    """Filled in, but with a code that says "unknown"; never true where the value is missing."""
    if not codes:
        return F.lit(False)
    return ~is_missing(column) & stripped(column).isin(*codes)


def quality_report(
    df: DataFrame, group: str, ignored: Mapping[str, Sequence[str]], invalid: Mapping[str, Column] | None = None,
    digits: int = 1,
) -> DataFrame:
    """One row per group: n, per column ``_missing``, ``_ignored``, ``_total`` and per check ``_invalid`` (in %).

    The total adds the two rounded parts. A single aggregation with map-side combining.
    """
    def share(condition: Column) -> Column:
        return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100, digits)

    parts = [F.count(F.lit(1)).alias("n")]
    for name, codes in ignored.items():
        parts += [
            share(is_missing(F.col(name))).alias(f"{name}_missing"),
            share(is_ignored(F.col(name), codes)).alias(f"{name}_ignored"),
        ]
    for name, condition in (invalid or {}).items():
        parts.append(share(condition).alias(f"{name}_invalid"))
    out = df.groupBy(group).agg(*parts)
    return out.withColumns({
        f"{name}_total": F.round(F.col(f"{name}_missing") + F.col(f"{name}_ignored"), digits) for name in ignored
    })


def long_report(report: DataFrame, group: str) -> DataFrame:
    """(group, variable, pct) of the total and invalid columns."""
    names = [c for c in report.columns if c.endswith(("_total", "_invalid"))]
    return report.unpivot([group], names, "column", "pct").select(
        group, F.regexp_replace("column", "_(total|invalid)$", "").alias("variable"), "pct"
    )


def quality_alerts(report: DataFrame, group: str, limit: float = ALERT, high: float = HIGH_ALERT) -> DataFrame:
    """Variables above ``limit`` percent without information: (group, variable, pct, severity)."""
    return long_report(report, group).filter(F.col("pct") > limit).withColumn(
        "severity", F.when(F.col("pct") > high, "high").otherwise("moderate")
    )


def quality_means(report: DataFrame, group: str) -> DataFrame:
    """Unweighted mean over groups: (variable, mean_pct)."""
    return long_report(report, group).groupBy("variable").agg(F.avg("pct").alias("mean_pct"))
