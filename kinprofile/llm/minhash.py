"""MinHash near-duplicates with sequential verification.

1. Documents become sets of hashed 5-word shingles.  Equal sets form a class; one document stands for it.
2. Representatives get a signature of ``BANDS * ROWS`` minimum hashes.  A band is a bucket key; a bucket proposes the pairs
   (smallest member, other member).
3. Proposed pairs are verified batch by batch over their signatures; the numbers of agreeing hashes at which a pair is
   pruned are such that a pair at the threshold is lost by all looks together with chance ``miss`` at most.  Survivors are
   verified exactly on their full shingle sets, which are made again for the documents that still matter.
4. Links and classes give components.  A bucket whose members are now in different components still holds candidates
   that were not compared.  Its members meet inside a task (block by block, if there are many): who is outside the largest
   component is compared, again batch by batch, with everyone of another component.  Members with a survivor meet once more
   with their full sets; a pair is verified in the first bucket it shares, unless links found there already connect it.  No
   pair leaves a task but the links that join components, and no pair of one component is looked at, so a bucket of near
   copies costs its size.
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

from kinprofile.llm.common import Steps, components, settle, without

WORDS = 5
BANDS, ROWS = 50, 5
BATCH = 25  # hashes compared between two looks at the posterior
CELLS = 256  # a signature keeps one byte of each minimum; different minima share it once in 256 times
BLOCK = 2048  # members of a bucket that meet in one task
MEMO = 200_000

_RNG = np.random.default_rng(20_011)
_MULTIPLY = (_RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_ODD = _RNG.integers(0, 1 << 63, WORDS, np.uint64) << np.uint64(1) | np.uint64(1)


class _Words(dict):
    """Hash of a word, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words make one shingle, no word none."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        total = total + h[k : len(h) - WORDS + 1 + k] * _ODD[k]
    return np.unique(_mix(total + np.uint64(WORDS)))


def signature(own: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minimum of every hash function over a non-empty set."""
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), block):
        np.minimum(out, (low[at : at + block] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out)
    return out


def marks(sig: np.ndarray) -> bytes:
    """One byte of every minimum, for verification."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return h


def least_agreement(threshold: float, miss: float) -> np.ndarray:
    """Fewest agreeing bytes after each batch with which a pair stays.

    A pair at the threshold is pruned by all looks together with chance ``miss`` at most, a more similar one less often: each
    look may spend an equal share of what the looks before it left.
    """
    p = threshold + (1 - threshold) / CELLS
    step = np.array([math.comb(BATCH, k) * p**k * (1 - p) ** (BATCH - k) for k in range(BATCH + 1)])
    looks = BANDS * ROWS // BATCH
    out, alive, left = [], np.ones(1), miss
    for k in range(looks):
        alive = np.convolve(alive, step)
        below = np.cumsum(alive)
        need = int(np.searchsorted(below, left / (looks - k), side="right"))
        left -= float(below[need - 1]) if need else 0.0
        alive[:need] = 0.0
        out.append(need)
    return np.array(out)


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """One row per document: size and 128-bit hash of its set, signature and band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = _Words()
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                n, a, b, sigs, bands = [], [], [], [], []
                for value in part.column(1).to_pylist():
                    own = shingles(value, known)
                    n.append(len(own))
                    if len(own):
                        sig = signature(own)
                        both = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                        a.append(int(both[0]))
                        b.append(int(both[1]))
                        sigs.append(marks(sig))
                        bands.append(band_keys(sig).view(np.int64))
                    else:
                        for column in (a, b, sigs, bands):
                            column.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SKETCH)


def _prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that no look at their signatures, compared batch by batch, prunes."""
    least = least_agreement(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(rows.num_rows, -1) for c in ("sig_a", "sig_b")
            )
            alive, agree = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for k, need in enumerate(least.tolist()):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                agree[alive] += (left[alive, cut] == right[alive, cut]).sum(1)
                alive = alive[agree[alive] >= need]
            yield rows.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a long, b long")


def _by_bucket(df: DataFrame, work, schema: str, names: list[str]) -> DataFrame:
    """Run ``work(key, columns)`` on the rows of every (bucket, lo, hi), sorted by rep; it returns columns ``names``.

    Most buckets hold a handful of rows, so a task walks through its sorted rows instead of calling Python per group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        out: list[tuple] = []

        def groups(table: pa.Table, last: bool):
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "lo", "hi")], 1)
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            ends = np.r_[first[1:], len(keys)]
            columns = {c: table.column(c).to_numpy() if pa.types.is_integer(table.schema.field(c).type) else table.column(c).to_pylist() for c in table.column_names}
            for a, b in zip(first.tolist(), ends.tolist()):
                if b < len(keys) or last:
                    yield tuple(keys[a].tolist()), {c: v[a:b] for c, v in columns.items()}
            return None if last else table.slice(int(first[-1]))

        def flush() -> pa.RecordBatch:
            done = [np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in done], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            walk = groups(held, False)
            while True:
                try:
                    out.append(work(*next(walk)))
                except StopIteration as end:
                    held = end.value
                    break
            if out:
                yield flush()
        if held is not None:
            out += [work(*g) for g in groups(held, True)]
            yield flush()

    keys = ["bucket", "lo", "hi"]
    return df.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, schema)


def _survivors(rows, least: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of members of different components that survive the comparison, and their agreement.

    ``rows`` has rep, label, block and signature; ``apart`` compares members of different blocks only.
    """
    label, block = rows["label"], rows["block"]
    sig = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(label), -1)
    names, size = np.unique(label, return_counts=True)
    outside = label != names[size.argmax()]
    left, right, score = [], [], []
    for i in np.flatnonzero(outside).tolist():
        # Everyone of another component, once: two members outside the largest meet at the smaller place.
        meet = (label != label[i]) & ~(outside & (np.arange(len(label)) < i))
        if apart:
            meet &= block != block[i]
        at, agree = np.flatnonzero(meet), 0
        for k, need in enumerate(least.tolist()):
            cut = slice(k * BATCH, (k + 1) * BATCH)
            agree = agree + (sig[at, cut] == sig[i, cut]).sum(1)
            stay = agree >= need
            at, agree = at[stay], agree[stay]
            if not len(at):
                break
        if len(at):
            left.append(np.full(len(at), i))
            right.append(at)
            score.append(agree)
    if not left:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def _linked(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets share 100 * intersection >= per_cent * union."""
    if 100 * min(len(x), len(y)) < per_cent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= per_cent * (len(both) - shared)


def _across(
    docs: DataFrame, members: DataFrame, labels: DataFrame, signed: DataFrame, text: str, threshold: float, miss: float, steps: Steps
) -> DataFrame:
    """Links ``(a, b)`` that connect components which meet in a bucket; enough of them to connect all that are linked."""
    least, per_cent = least_agreement(threshold, miss), round(100 * threshold)
    placed = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "bucket", "rep", F.coalesce("label", "rep").alias("label")
    )
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("low < high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = placed.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = open_.select("bucket", "rep", "label", "block", other)
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

    def look(key, rows):
        i, j, _ = _survivors(rows, least, key[1] != key[2])
        some = np.unique(np.concatenate([i, j]))
        return *(np.full(len(some), k) for k in key), rows["rep"][some], rows["label"][some], rows["block"][some]

    place = "bucket long, lo long, hi long, rep long, label long, block long"
    columns = ["bucket", "lo", "hi", "rep", "label", "block"]
    signed = signed.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    met = steps.write(_by_bucket(dealt.join(signed, "rep"), look, place, columns), "met")
    own = steps.write(_sets(docs, met.select(F.col("rep").alias("doc_id")).distinct(), text), "sets")
    homes = met.groupBy("rep").agg(F.array_sort(F.collect_set("bucket")).alias("homes"))  # at most one per band
    known = own.withColumnRenamed("doc_id", "rep").join(homes, "rep").join(signed, "rep")
    full = met.join(known, "rep")

    def verify(key, rows):
        i, j, score = _survivors(rows, least, key[1] != key[2])
        rep, label = rows["rep"], rows["label"].tolist()
        sets = [np.frombuffer(b, np.uint64) for b in rows["own"]]
        homes = [{h for h in own if h < key[0]} for own in rows["homes"]]
        up = {x: x for x in label}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for at in np.lexsort((j, i, -score)).tolist():
            x, y = int(i[at]), int(j[at])
            a, b = top(label[x]), top(label[y])
            if a != b and homes[x].isdisjoint(homes[y]) and _linked(sets[x], sets[y], per_cent):
                up[max(a, b)] = min(a, b)
                out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return tuple(np.array(out, np.int64).reshape(-1, 2).T)

    links = steps.write(_by_bucket(full, verify, "a long, b long", ["a", "b"]).distinct(), "links")
    for t in (met, own):
        steps.drop(t)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Full shingle sets ``(doc_id, own)`` of the wanted documents, made again from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for rows in batches:
            found = [shingles(v, known).tobytes() for v in rows.column(1).to_pylist()]
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(found, pa.binary()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "own", "set_a", "set_b"]
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = chosen.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, own binary, set_a long, set_b long")
    return made.groupBy("doc_id").agg(F.min_by("own", F.struct("set_a", "set_b")).alias("own"))


def _exact(docs: DataFrame, pairs: DataFrame, text: str, threshold: float, steps: Steps) -> DataFrame:
    """Pairs that are links on their full shingle sets."""
    per_cent = round(100 * threshold)
    own = steps.write(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), text), "sets")
    joined = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("own").alias("set_a")), "a")
    joined = joined.join(own.select(F.col("doc_id").alias("b"), F.col("own").alias("set_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = zip(rows.column("set_a").to_pylist(), rows.column("set_b").to_pylist())
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), per_cent) for x, y in sets]
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = steps.write(joined.mapInArrow(compare, "a long, b long").distinct(), "links")
    steps.drop(own)
    return links


def near_duplicates(
    docs: DataFrame, text: str = "text", threshold: float = 0.75, miss: float = 1e-6
) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one per row of ``docs``.

    Documents with Jaccard similarity >= ``threshold`` of their shingle sets are linked; ``component_id`` is the smallest
    doc_id reachable.  A null or empty text, or one without words, has no shingle, links with nothing and is kept.  Rows
    that repeat a doc_id are one document (of different texts, the one with the smallest set hash is compared): they share
    the component, and each is returned with its own size.  A row with a null doc_id is returned with a null component and kept; it links nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    sketch = steps.write(sketches(docs, text), "sketches")
    node = sketch.where("doc_id is not null and n_shingles > 0")
    # A doc_id with several texts stands for the one with the smallest set hash.
    own = F.struct("set_a", "set_b")
    several = node.groupBy("doc_id").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first <> last")
    node = node.join(several.select("doc_id", "first"), "doc_id", "left").where(F.col("first").isNull() | (F.col("first") == own)).drop("first")
    classes = steps.write(node.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    same = node.join(classes.where("n > 1"), ["set_a", "set_b"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = node.join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi")
    bands = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))
    # Buckets with the same members (near copies share many bands) propose the same pairs: one of them stays.
    shared = bands.groupBy("bucket").agg(
        F.min("rep").alias("least"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"),
    ).where("least < most")
    once = steps.write(shared.groupBy("least", "most", "n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "least"), "buckets")
    members = steps.write(bands.join(once, "bucket"), "members")
    signed = steps.write(node.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "signature"), "signatures")

    first = steps.write(members.select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a < b").distinct(), "pairs")
    both = first.join(signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a")), "a")
    both = both.join(signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b")), "b")
    left = steps.write(_prune(both.select("a", "b", "sig_a", "sig_b"), threshold, miss).distinct(), "candidates")
    edges = steps.write(same.union(_exact(docs, left, text, threshold, steps)), "edges")
    for t in (first, left):
        steps.drop(t)
    links = _across(docs, members, components(edges), signed, text, threshold, miss, steps)
    labels = components(edges.union(links))
    out = sketch.select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("label", "doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns as they are; of rows that repeat a doc_id all or none."""
    kept = near_duplicates(docs, text, threshold).where("not kept").select("doc_id").distinct()
    return without(docs, []).join(kept, docs["doc_id"].cast(T.LongType()) == kept["doc_id"], "left_anti")
