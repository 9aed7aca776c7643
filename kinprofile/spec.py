"""Feature specification: which columns group, identify and describe a record.

Every feature has a declared, finite set of levels.  That is what bounds the number
of distinct feature vectors per group (``FeatureSpec.max_vectors``) whatever the
number of rows, and every clustering operator works on that table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Vector ids are 64-bit numbers of the code tuple.
MAX_VECTORS = 1 << 62


@dataclass(frozen=True)
class Nominal:
    """One-hot feature. ``dropped`` is the level without a column of its own; it and
    any undeclared value encode as all zeros (code -1)."""

    name: str
    levels: tuple[str, ...]
    dropped: str | None = None

    @property
    def kept(self) -> tuple[str, ...]:
        return tuple(v for v in self.levels if v != self.dropped)

    @property
    def code(self) -> str:
        return f"{self.name}_code"

    @property
    def codes(self) -> tuple[int, ...]:
        return tuple(range(-1, len(self.kept)))

    def encode(self) -> Column:
        position = F.array_position(F.array(*map(F.lit, self.kept)), F.col(self.name))
        return (F.coalesce(position, F.lit(0)) - 1).cast("int")

    def decode(self, code: Column) -> Column:
        return F.when(code >= 0, F.get(F.array(*map(F.lit, self.kept)), code)).otherwise(F.lit(self.dropped))


@dataclass(frozen=True)
class Ordinal:
    """Ordered feature with integer level values; undeclared labels take ``default``."""

    name: str
    levels: tuple[tuple[str, int], ...]
    default: int = 0

    @property
    def code(self) -> str:
        return f"{self.name}_code"

    @property
    def scaled(self) -> str:
        return f"{self.name}_scaled"

    @property
    def codes(self) -> tuple[int, ...]:
        return tuple(sorted({v for _, v in self.levels} | {self.default}))

    def encode(self) -> Column:
        pairs = [F.lit(x) for label, value in self.levels for x in (label, value)]
        hit = F.element_at(F.create_map(*pairs), F.col(self.name))
        return F.coalesce(hit, F.lit(self.default)).cast("int")

    def decode(self, code: Column) -> Column:
        pairs = [F.lit(x) for label, value in reversed(self.levels) for x in (value, label)]
        return F.element_at(F.create_map(*pairs), code)


@dataclass(frozen=True)
class FeatureSpec:
    group: str
    row_id: str
    nominals: tuple[Nominal, ...]
    ordinals: tuple[Ordinal, ...] = ()

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("a specification needs at least one feature")
        if self.max_vectors > MAX_VECTORS:
            raise ValueError(f"{self.max_vectors} possible vectors per group do not fit a 64-bit id")

    @property
    def features(self) -> tuple[Nominal | Ordinal, ...]:
        return self.nominals + self.ordinals

    @property
    def code_columns(self) -> list[str]:
        return [f.code for f in self.features]

    @property
    def max_vectors(self) -> int:
        """Upper bound of distinct vectors per group, from the declared levels alone."""
        return prod(len(f.codes) for f in self.features)

    @property
    def one_hot(self) -> list[tuple[Nominal, int, str]]:
        """(feature, level code, column name) of every one-hot column, in order."""
        return [(f, i, f"{f.name}={v}") for f in self.nominals for i, v in enumerate(f.kept)]

    @property
    def offsets(self) -> dict[str, int]:
        """Position of each nominal's first column inside the one-hot block."""
        out, at = {}, 0
        for f in self.nominals:
            out[f.name] = at
            at += len(f.kept)
        return out

    def vector_id(self) -> Column:
        """Mixed-radix number of the code tuple: unique per vector, no lookup needed."""
        vid = F.lit(0).cast("bigint")
        for f in self.features:
            if isinstance(f, Nominal):
                digit = F.col(f.code) + 1
            else:
                digit = F.array_position(F.array(*map(F.lit, f.codes)), F.col(f.code)) - 1
            vid = vid * len(f.codes) + digit
        return vid.cast("bigint")

    def codes_of_vector(self) -> dict[str, Column]:
        """The code columns read back from the digits of ``vid``."""
        out, stride = {}, self.max_vectors
        for f in self.features:
            stride //= len(f.codes)
            digit = F.expr(f"CAST((vid div {stride}) % {len(f.codes)} AS INT)")
            if isinstance(f, Nominal):
                out[f.code] = digit - 1
            else:
                out[f.code] = F.get(F.array(*map(F.lit, f.codes)), digit)
        return out
