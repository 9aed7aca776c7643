"""Scalar building blocks, all native Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space that a text strip removes, blanks and control characters alike.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITE))


def lookup(column: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Translate a trimmed code through a literal map; unmatched codes give ``default``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    hit = F.element_at(F.create_map(*pairs), stripped(column))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def band(column: Column, cuts: Sequence[tuple[float, str]], above: str, missing: str | None = None) -> Column:
    """Label of the first cut the value lies below."""
    out = F.when(column.isNull(), F.lit(missing))
    for limit, label in cuts:
        out = out.when(column < limit, F.lit(label))
    return out.otherwise(F.lit(above))


def coded_in(column: Column, codes: Sequence[str], width: int = 3) -> Column:
    """True where the leading characters are one of ``codes`` (null counts as no)."""
    return F.coalesce(F.substring(column, 1, width).isin(*codes), F.lit(False))


def uniform(*parts: Column | str | int) -> Column:
    """Reproducible uniform in [0, 1) from the MD5 of the joined parts.

    The first 13 hex digits hold 52 bits, so the double is exact and any engine with
    MD5 gives the same number.
    """
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def fast_uniform(*parts: Column | int) -> Column:
    """Uniform in (0, 1) from a 64-bit hash; cheaper than MD5 where no other engine must agree."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(2**53))


def poisson_one(u: Column, top: int = 18) -> Column:
    """Poisson(1) draw by inverting its distribution function at ``u``."""
    from math import exp, factorial

    total, draw = 0.0, F.lit(0)
    for i in range(top):
        total += exp(-1.0) / factorial(i)
        draw = draw + F.when(u >= F.lit(total), 1).otherwise(0)
    return draw.cast("bigint")


def hopkins_reading(h: Column) -> Column:
    """Verbal reading of a Hopkins mean."""
    return (
        F.when(h >= 0.75, "strong")
        .when(h >= 0.60, "moderate")
        .when(h >= 0.50, "weak")
        .otherwise("random")
    )


def stability_reading(ari: Column) -> Column:
    return F.when(ari > 0.6, "stable").otherwise("unstable")


def agreement_reading(ari: Column) -> Column:
    return F.when(ari > 0.3, "moderate").otherwise("low")
