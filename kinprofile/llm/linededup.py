"""Line deduplication against a sharded minimal perfect hash of all distinct lines.

1. Every task reduces its documents to (line hash, number of documents) before the shuffle; the sums are the document
   counts of all distinct lines.
2. The distinct lines are dealt to shards by their hash.  A shard numbers its n hashes 0..n-1 by a minimal perfect hash
   (levels of bit arrays: a hash that is alone in its cell takes the cell, the others go on to the next level; the rank of
   the bit is the number) and stores, by number, a fingerprint and the document count.
3. Documents look their lines up in these arrays and drop those whose count is large enough.  As long as all arrays together
   are at most ``broadcast_bytes`` they travel with the tasks and no line is shuffled; beyond that, each (document, line
   hash) visits the shard of its hash and the hits come back.  A shard is copied as often as its counted visits ask for, so
   a line in a third of all documents is met by as many tasks as its documents need.  Both ways give the same rows.

Hashes have 128 bits: 64 number the line, the other 64 are its fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.common import SLICE, Steps, add_columns, materialise, settle, without

WHITE = b" \t\n\x0b\x0c\r"
GAMMA = 2.0  # cells of a level per hash that enters it
TWINS = 24  # from this level on the fingerprint counts too: two lines with one 64-bit hash part there
HASHED = np.dtype([("h", "<u8"), ("mark", "<u8")])


def line_keys(text: str | None) -> list[bytes]:
    """Key of every line: white space stripped at both ends, A-Z in lower case."""
    return [line.strip(WHITE).lower() for line in (text or "").encode().split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), HASHED)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def line_counts(docs: DataFrame, text: str, min_chars: int, held: int = 250_000) -> DataFrame:
    """``(h, mark, n)``: number of documents of every distinct line key; a task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows, n = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["h"].view(np.int64)), pa.array(rows["mark"].view(np.int64)), pa.array(n)], ["h", "mark", "n"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for value in batch.column(0).slice(at, SLICE).to_pylist():
                    keys = [k for k in {*line_keys(value)} if _long_enough(k, min_chars)]
                    if keys:
                        found.append(_hashes(keys))
                        size += len(keys)
                    if size >= held:
                        yield flush()
                        size = 0
        if found:
            yield flush()

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h long, mark long, n long")
    return parts.groupBy("h", "mark").agg(F.sum("n").alias("n"))


def _cell(h: np.ndarray, level: int, cells: int | np.ndarray) -> np.ndarray:
    mixed = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ mixed >> np.uint64(31)) % np.uint64(cells)).astype(np.int64)


def _entering(h: np.ndarray, marks: np.ndarray, level: int) -> np.ndarray:
    return h if level < TWINS else h ^ marks * np.uint64(2 * level + 1)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes with a fingerprint and a count per number."""

    def __init__(self, levels: list[np.ndarray], marks: np.ndarray, counts: np.ndarray) -> None:
        self.levels, self.marks, self.counts = levels, marks, counts
        self.ranks, before = [], 0
        for bits in levels:
            set_before = np.r_[0, np.cumsum(np.bitwise_count(bits.view("<u8")).astype(np.int64))] + before
            self.ranks.append(set_before)
            before = int(set_before[-1])

    @staticmethod
    def build(h: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(h))
        while len(left):
            cells = max(64, 64 * math.ceil(GAMMA * len(left) / 64))
            cell = _cell(_entering(h[left], marks[left], len(levels)), len(levels), cells)
            alone = np.bincount(cell, minlength=cells) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[cell]]
        out = PerfectHash(levels, np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8"))
        at = out.number(h, marks)
        out.marks[at], out.counts[at] = marks, counts
        return out

    def number(self, h: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where no level has its cell; an unknown hash may get a number of another."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            entering = h[open_] if level < TWINS else _entering(h[open_], marks[open_], level)
            cell = _cell(entering, level, 8 * len(bits))
            hit = bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1
            at = cell[hit]
            words = bits.view("<u8")[at >> 6]
            below = np.bitwise_count(words & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            out[open_[hit]] = rank[at >> 6] + below
            open_ = open_[~hit]
        return out

    def count(self, h: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Document count of each hash; 0 where the index does not hold it."""
        at = self.number(h, marks)
        known = at >= 0
        known[known] = self.marks[at[known]] == marks[known]
        out = np.zeros(len(h), np.int64)
        out[known] = self.counts[at[known]]
        return out

    def dump(self) -> dict[str, object]:
        width = next(w for w in ("<u1", "<u2", "<u4", "<u8") if not len(self.counts) or self.counts.max() <= np.iinfo(w).max)
        return {"levels": [b.tobytes() for b in self.levels], "marks": self.marks.tobytes(),
                "counts": self.counts.astype(width).tobytes(), "width": width}

    @staticmethod
    def load(row) -> PerfectHash:
        levels = [np.frombuffer(b, np.uint8) for b in row["levels"]]
        return PerfectHash(levels, np.frombuffer(row["marks"], "<u8"), np.frombuffer(row["counts"], row["width"]))


INDEX = "shard long, levels array<binary>, marks binary, counts binary, width string"


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the arrays of its perfect hash.  Distinct hashes spread evenly, so shards are near equal."""

    def build(key, rows):
        import pandas as pd

        h, mark = rows["h"].to_numpy().view(np.uint64), rows["mark"].to_numpy().view(np.uint64)
        # Two lines that agree in the first half of the hash: told apart by the second, so both halves number the line.
        mixed = h ^ (mark >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        return pd.DataFrame([{"shard": key[0], **PerfectHash.build(mixed, mark, rows["n"].to_numpy()).dump()}])

    dealt = counts.withColumn("shard", F.pmod("mark", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(build, INDEX)


def _probe(hash_: PerfectHash, rows: np.ndarray) -> np.ndarray:
    mixed = rows["h"] ^ (rows["mark"] >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    return hash_.count(mixed, rows["mark"])


DROPPED = [
    T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType()),
]


def _cut(value: str | None, drop: set[bytes]) -> tuple[int, int, str]:
    lines = (value or "").split("\n")
    if not drop:
        return len(lines), 0, value or ""
    kept = [line for line, key in zip(lines, line_keys(value)) if key not in drop]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", shard_lines: int = 1_000_000,
    broadcast_bytes: int = 64 << 20, visits: int = 1_000_000,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: lines found in ``min_docs`` documents are gone everywhere.

    A line's key is stripped of white space at both ends with A-Z in lower case; keys under ``min_chars`` code points
    always stay.  A null or empty text is one empty line and its ``kept_text`` is empty, as when all lines go.  Every row is
    a document, also where rows repeat.  Columns with those names are replaced, others kept; an empty table stays empty.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    counts = steps.write(line_counts(docs, text, min_chars), "line-counts")
    shards = max(1, math.ceil(counts.count() / shard_lines))
    index = steps.write(build_index(counts, shards), "line-index")
    size = F.length("marks") + F.length("counts") + F.aggregate("levels", F.lit(0), lambda a, b: a + F.length(b))
    total = index.agg(F.sum(size.cast("long"))).first()[0] or 0
    names = [f.name for f in DROPPED]
    if total <= broadcast_bytes:
        arrays = spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in index.collect()})
        steps.drop(counts)
        steps.drop(index)

        def make():
            index_of = {k: PerfectHash.load(r) for k, r in arrays.value.items()}

            def columns(values: list) -> dict[str, pa.Array]:
                keys_of = [[k for k in {*line_keys(value)} if _long_enough(k, min_chars)] for value in values]
                found = _hashes([k for keys in keys_of for k in keys])
                shard = found["mark"].view(np.int64) % shards
                frequent = np.zeros(len(found), bool)
                for k in index_of if len(found) else ():
                    own = np.flatnonzero(shard == k)
                    frequent[own] = _probe(index_of[k], found[own]) >= min_docs
                out, at = [], 0
                for value, keys in zip(values, keys_of):
                    drop = {keys[i] for i in np.flatnonzero(frequent[at : at + len(keys)]).tolist()}
                    at += len(keys)
                    out.append(_cut(value, drop))
                n_lines, n_dropped, kept = zip(*out) if out else ((), (), ())
                return {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()),
                        "kept_text": pa.array(kept, pa.string())}

            return columns

        return add_columns(without(docs, names), text, make, T.StructType(DROPPED))
    salts = shard_copies(counts, shards, visits)
    steps.drop(counts)
    return _dedup_by_visits(docs, index, salts, min_docs, min_chars, text)


def shard_copies(counts: DataFrame, shards: int, visits: int) -> np.ndarray:
    """Copies of every shard so that about ``visits`` (document, line) pairs meet one: the counts are the visits to come.

    One number per shard comes to the driver, that is one per ``shard_lines`` distinct lines.
    """
    out = np.ones(shards, np.int64)
    asked = counts.groupBy(F.pmod("mark", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("n"))
    for row in asked.collect():
        out[row["shard"]] = max(1, math.ceil(row["n"] / visits))
    return out


def _free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each name with as many underscores before it as no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _dedup_by_visits(
    docs: DataFrame, index: DataFrame, salts: np.ndarray, min_docs: int, min_chars: int, text: str, held: int = 100_000
) -> DataFrame:
    """The way for an index of any size: line hashes visit the copies of their shard, hits come back to their row."""
    docs = without(docs, [f.name for f in DROPPED])
    row_name, drop_name = _free_names(docs, "_row", "_drop")
    rows = materialise(docs.withColumn(row_name, F.monotonically_increasing_id()), "rows")
    names = ["_row", "h", "mark", "shard", "salt"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        own: list[np.ndarray] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, hashes = np.concatenate(own), np.concatenate(found)
            mark = hashes["mark"].view(np.int64)
            shard = mark % len(salts)
            salt = _cell(hashes["h"] ^ row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0, salts[shard])
            own.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (row, hashes["h"].view(np.int64), mark, shard, salt)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for row, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys = [k for k in {*line_keys(value)} if _long_enough(k, min_chars)]
                    if keys:
                        own.append(np.full(len(keys), row, np.int64))
                        found.append(_hashes(keys))
                        size += len(keys)
                    if size >= held:
                        yield flush()
                        size = 0
        if found:
            yield flush()

    asked = rows.select(row_name, text).mapInArrow(explode, ", ".join(f"{n} long" for n in names))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                for salt in range(int(salts[shard])):
                    yield batch.slice(i, 1).append_column("salt", pa.array([salt], pa.int64()))

    copies = index.mapInArrow(copy, f"{INDEX}, salt long")

    def visit(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"_row": [], "h": [], "mark": []}).astype("int64")
        found = np.empty(len(left), HASHED)
        found["h"], found["mark"] = left["h"].to_numpy().view(np.uint64), left["mark"].to_numpy().view(np.uint64)
        hit = _probe(PerfectHash.load(right.iloc[0]), found) >= min_docs
        return left.loc[hit, ["_row", "h", "mark"]]

    hits = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(visit, "_row long, h long, mark long")
    hits = hits.groupBy(F.col("_row").alias(row_name)).agg(F.collect_list(F.struct("h", "mark")).alias(drop_name))  # at most the lines of one document
    joined = rows.join(hits, row_name, "left")
    schema = T.StructType([f for f in joined.schema.fields if f.name not in (row_name, drop_name)] + DROPPED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, drop in zip(batch.column(text).to_pylist(), batch.column(drop_name).to_pylist()):
                gone = {(d["h"], d["mark"]) for d in drop or []}
                keys = list({*line_keys(value)}) if gone else []
                found = _hashes(keys) if keys else ()
                drop_keys = {
                    k for k, f in zip(keys, found)
                    if (int(f["h"].view(np.int64)), int(f["mark"].view(np.int64))) in gone and _long_enough(k, min_chars)
                }
                out.append(_cut(value, drop_keys))
            n_lines, n_dropped, kept = zip(*out) if out else ((), (), ())
            batch = batch.select([n for n in batch.schema.names if n not in (row_name, drop_name)])
            batch = batch.append_column("n_lines", pa.array(n_lines, pa.int64()))
            batch = batch.append_column("n_dropped", pa.array(n_dropped, pa.int64()))
            yield batch.append_column("kept_text", pa.array(kept, pa.string()))

    return joined.mapInArrow(cut, schema)
