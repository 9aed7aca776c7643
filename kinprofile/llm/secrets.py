"""Secret scanning with multipart credential linking.

Strong findings come from patterns that name or look like a secret (kinds assign, access, hex).  Weak candidates are parts
that mean nothing alone: an account identifier, a mixed random-looking string, a service endpoint.  Parts of one text
are joined by intervals: each part covers the code points within ``scope`` of it, and a weak candidate is reported only
when a complementary part lies in its scope -

* ``ident`` and ``endpoint`` with a secret (a strong one or a weak ``opaque`` one),
* ``opaque`` with an identifier (an ``ident`` or an access key), or with an endpoint.

Parts are found inside the tasks and only parts are shuffled.  The join meets parts in buckets of ``scope`` code points; a
bucket holds a bounded number of them however long the text is, because parts of a kind do not overlap.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.common import add_columns, materialise, without

# The base patterns, and the order of the kinds in results.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ finds them
_IDENT = re.compile(
    r"""(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,64})""",
    re.ASCII | re.IGNORECASE,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(
    r"""(?:https?|ftp|ssh|mysql|postgres(?:ql)?|mongodb|redis|amqp)://[^\s"'<>]{4,}|(?<![a-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++){2,}:[0-9]{2,5}"""
)

Part = tuple[str, int, int]


def _random_looking(s: str) -> bool:
    """Three classes of characters and at least 3.5 bits per character."""
    classes = any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s)
    n = len(s)
    return classes == 3 and -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.5


def strong_parts(text: str) -> list[Part]:
    """Base findings, leftmost and non-overlapping per kind; matches that fail their condition are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def weak_parts(text: str, strong: list[Part]) -> list[Part]:
    """Candidates that count only together; those that overlap a strong finding are left to it."""
    found: list[Part] = []
    if ":" in text or "=" in text:
        found += [("ident", m.start(1), m.end(1)) for m in _IDENT.finditer(text)]
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    found += [("opaque", *m.span()) for m in _OPAQUE.finditer(text) if _random_looking(m[0])]
    taken = sorted((s, e) for _, s, e in strong)
    out, k = [], 0
    for part in sorted(found, key=lambda p: p[1:]):
        while k < len(taken) and taken[k][1] <= part[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= part[2]:
            out.append(part)
    return out


PARTS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_WEAK, _SPANS = T.StructField("_weak", PARTS), T.StructField("spans", PARTS)


def _arrow(parts: list[list[Part]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in parts], pa.list_(kind))


def _scan() -> Callable[[list], dict[str, pa.Array]]:
    def columns(texts: list) -> dict[str, pa.Array]:
        strong = [strong_parts(t or "") for t in texts]
        weak = [weak_parts(t or "", s) for t, s in zip(texts, strong)]
        return {"spans": _arrow(strong), "_weak": _arrow(weak)}

    return columns


def _role(kind):
    return (
        F.when(kind.isin("assign", "hex", "opaque"), "secret").when(kind.isin("access", "ident"), "identifier").otherwise("endpoint")
    )


def link_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Weak rows of ``parts(row, kind, start, end)`` that have a complementary part within ``scope`` code points.

    An interval join in buckets: a part is placed in every bucket its scope touches (three or a few more), the sides of
    the join are different roles, and what leaves it is one row per weak part that has a partner.
    """
    placed = parts.withColumn("role", _role(F.col("kind")))
    weak = placed.where(F.col("kind").isin("ident", "opaque", "endpoint"))
    low, high = F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)
    asking = weak.withColumn("bucket", F.explode(F.sequence(low, high)))
    # A partner is met in the bucket of its start, or in that of its end when it reaches over from before.
    partner = placed.select(
        "row", F.col("role").alias("p_role"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bucket"),
    )
    fits = (
        ((F.col("role") == "secret") & F.col("p_role").isin("identifier", "endpoint"))
        | (F.col("role").isin("identifier", "endpoint") & (F.col("p_role") == "secret"))
    )
    near = (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") >= F.col("start") - scope)
    met = asking.join(partner, ["row", "bucket"]).where(fits & near)
    return met.groupBy("row", "kind", "start", "end").agg(F.count(F.lit(1)).alias("_met")).drop("_met")


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` without its text and with ``spans``: an array of (kind, start, end) in code points, end exclusive, by start
    and kind.

    Strong findings are always there; weak ones as the module text says.  A null text counts as empty and has no span.
    Each row is a text of its own, also where rows repeat; columns called ``spans`` are replaced, others kept; an empty
    table stays empty.  The texts themselves are read once and not shuffled: rows with weak parts carry only parts.
    """
    scanned = add_columns(without(docs, ["spans", "_weak", "_row"]), text, _scan, T.StructType([_SPANS, _WEAK]))
    # Two columns of one pass; the row number lives in the written table, so it is the same for every reader.
    rows = materialise(scanned.drop(text).withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    mixed = rows.where(F.size("_weak") > 0).select(F.col("_row").alias("row"), F.explode(F.concat("spans", "_weak")).alias("p"))
    linked = link_parts(mixed.select("row", "p.kind", "p.start", "p.end"), scope)
    per_row = linked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("_linked"))
    joined = rows.join(per_row, "_row", "left")
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    by_start = F.array_sort(F.transform(
        F.concat("spans", F.coalesce("_linked", F.array().cast(PARTS))),
        lambda p: F.struct(p["start"].alias("start"), order[p["kind"]].alias("at"), p["kind"].alias("kind"), p["end"].alias("end")),
    ))
    spans = F.transform(by_start, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return joined.withColumn("spans", spans).drop("_row", "_weak", "_linked")
