"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

1. Each text is encoded once by both tokenizers.  Token byte lengths come from the vocabularies and give every token its
   byte range; a text whose tokens do not spell it has none.
2. Every token of a batch of documents points to its farthest-right overlapping token, on either side.  Successor doubling
   (``next = next[next]``) takes every token to the terminal token of its component in as many steps as the logarithm of
   the longest chain; tokens with the same terminal are a group, and groups end where tokens of both sides end.
3. Links (one token of each side that end together) are written next to the groups.  Pair counts are summed over many documents
   before they are shuffled; the highest count of every B id is a second, smaller aggregate.
4. Counts go back to the links.  While the table of counts has at most ``broadcast_bytes`` it travels as sorted arrays and
   links look it up; beyond that, the pairs of each batch of documents are joined with it.  Both ways give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from kinprofile.llm.common import Steps, materialise, settle

PART = 100  # documents a worker encodes together
LINKS = 400_000  # links whose pairs a worker counts together, at least
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Byte of every letter that byte-level vocabularies write: printable Latin-1 as itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    rest = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """Bytes of every id, as one array with offsets."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.r_[0, np.cumsum(self.length)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.flat[np.arange(n.sum()) + np.repeat(self.first[ids] - np.r_[0, np.cumsum(n)[:-1]], n)]


class ByteLevel:
    """Byte-level BPE of a tokenizers file (pattern of the common English vocabularies); special tokens are plain text."""

    def __init__(self, spec: bytes) -> None:
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in word): i for word, i in json.loads(spec)["model"]["vocab"].items()}
        # Merges make their tokens in the order of ids, so an id is also the rank of its merge.
        self.coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            tokens[i] = word
        self.spelling = Spelling(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Pieces of a sentencepiece model, which puts a space before the text."""

    def __init__(self, spec: bytes) -> None:
        self.coder = SentencePieceProcessor(model_proto=spec)
        tokens = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            tokens.append(bytes([int(piece[1:-1], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode())
        self.spelling = Spelling(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal token of the component of every A and every B token, as numbers that rise from left to right.

    ``end_a`` and ``end_b`` are the rising ends of two sequences of tokens, none empty, that cover the same bytes.
    """
    ends = np.concatenate([end_a, end_b])
    n = len(end_a)
    # The last token of the other side that begins before a token ends overlaps it, and reaches at least as far.
    over_b = np.searchsorted(end_b, end_a, "left")  # first B token with end >= own end
    over_a = np.searchsorted(end_a, end_b, "left")
    following = np.concatenate([n + over_b, over_a])
    # Two that end together both are terminal; the one of the B side stands for them.
    following[n:] = np.where(ends[over_a] == end_b, n + np.arange(len(end_b)), over_a)
    while True:
        onward = following[following]
        if (onward == following).all():
            return following[:n] - n, following[n:] - n
        following = onward


def _group_text(ids: np.ndarray, side: np.ndarray, group: np.ndarray, document: np.ndarray, n_documents: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document, from tokens in order of (document, group, side, place)."""
    places = len(str(int(ids.max()))) if len(ids) else 1
    digits = np.zeros((len(ids), places + 1), np.uint8)  # the last column holds the separator
    shown = np.ones((len(ids), places + 1), bool)
    left = ids.astype(np.int32)
    for k in range(places - 1, -1, -1):
        shown[:, k] = (left > 0) | (k == places - 1)
        left, digit = np.divmod(left, 10)
        digits[:, k] = 48 + digit
    last = np.r_[(document[1:] != document[:-1]), True]
    next_group = np.r_[group[1:] != group[:-1], True]
    next_side = np.r_[side[1:] != side[:-1], True]
    digits[:, -1] = np.where(next_group, ord(";"), np.where(next_side, ord("|"), ord(",")))
    shown[:, -1] = ~last
    text = digits[shown].tobytes()
    size = np.bincount(document, shown.sum(1), n_documents).astype(np.int64)
    cut = np.r_[0, np.cumsum(size)].tolist()
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def align(texts: list[str | None], one, two) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of every text: tokens of A, tokens of B, groups, group text; of all links: document and ``a << 32 | b``."""
    given = [t or "" for t in texts]
    whole = [(" " + t).encode() if t else b"" for t in given]
    sides = []
    fine = np.fromiter(map(bool, given), bool, len(given))
    for coder in (one, two):
        lists = coder.encode(given)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for own in lists for i in own), np.int64, int(n.sum()))
        document = np.repeat(np.arange(len(given)), n)
        sides.append((ids, document))
        spelled = coder.spelling.spell(ids).tobytes()
        sizes = np.bincount(document, coder.spelling.length[ids], len(given)).astype(np.int64)
        cut = np.r_[0, np.cumsum(sizes)].tolist()
        fine &= np.fromiter((spelled[a:b] == w for a, b, w in zip(cut, cut[1:], whole)), bool, len(given))
    (a, doc_a), (b, doc_b) = ((ids[fine[d]], d[fine[d]]) for ids, d in sides)
    # Documents lie one after another, so that no component reaches over two of them.
    end_a, end_b = np.cumsum(one.spelling.length[a]), np.cumsum(two.spelling.length[b])
    group_a, group_b = terminals(end_a, end_b)
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.concatenate([group_a, group_b])
    order = np.lexsort((side, group))  # groups rise with documents; lexsort keeps places
    text = _group_text(np.concatenate([a, b])[order], side[order], group[order], np.concatenate([doc_a, doc_b])[order], len(given))
    # A group ends with the only token of either side that ends there.
    last_a = np.flatnonzero(np.r_[group_a[1:] != group_a[:-1], True]) if len(a) else np.empty(0, np.int64)
    link = a[last_a] << 32 | b[group_a[last_a]]
    count = lambda d: np.bincount(d, minlength=len(given))
    return count(doc_a), count(doc_b), count(doc_a[last_a]), text, doc_a[last_a], link


ALIGNED = "kind string, doc_id long, row long, n_a long, n_b long, n_groups long, groups string, links binary, pair long, n long"


def _encode(docs: DataFrame, text: str, key: str, vocabulary_a: bytes, vocabulary_b: bytes) -> DataFrame:
    """Rows 'doc' (counts, group text, links as little-endian pairs) and 'pair' (how many links of a batch a pair has)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary_a, vocabulary_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        one, two = ByteLevel(shared.value[0]), Pieces(shared.value[1])
        fields = ["kind", "doc_id", "row", "n_a", "n_b", "n_groups", "groups", "links", "pair", "n"]
        types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.int64(), pa.int64()]

        def batch(kind: str, size: int, **columns) -> pa.RecordBatch:
            given = [pa.array([kind] * size, pa.string())] + [columns.get(c, pa.nulls(size, t)) for c, t in zip(fields[1:], types[1:])]
            return pa.RecordBatch.from_arrays(given, fields)

        def pairs_of(links: list[np.ndarray]) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(links), return_counts=True)
            return batch("pair", len(pairs), pair=pa.array(pairs), n=pa.array(n))

        held = []
        for rows in batches:
            for at in range(0, rows.num_rows, PART):
                part = rows.slice(at, PART)
                n_a, n_b, n_groups, groups, owner, links = align(part.column("text").to_pylist(), one, two)
                cut = np.r_[0, np.cumsum(n_groups)].tolist()
                own = [links[i:j].astype("<i8").tobytes() for i, j in zip(cut, cut[1:])]
                yield batch(
                    "doc", part.num_rows, doc_id=part.column("doc_id"), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups),
                    groups=pa.array([g.decode() for g in groups]), links=pa.array(own, pa.binary()),
                )
                held.append(links)
                if sum(map(len, held)) >= LINKS:
                    yield pairs_of(held)
                    held = []
        if held:
            yield pairs_of(held)

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, ALIGNED)


def _counted(documents: DataFrame, counts: DataFrame, bytes_: int) -> DataFrame:
    """``documents`` with ``n_best`` and ``count_sum``, from counts that every task holds as sorted arrays."""
    spark = documents.sparkSession
    found = counts.toPandas()  # at most ``broadcast_bytes`` by its counted rows
    order = np.argsort(found["pair"].to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(
        (found["pair"].to_numpy(np.int64)[order], found["n"].to_numpy(np.int64)[order], found["best"].to_numpy(bool)[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        pairs, n, best = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                rows = whole.slice(at, PART)
                lists = [np.frombuffer(x, "<i8") for x in rows.column("links").to_pylist()]
                place = np.searchsorted(pairs, np.concatenate(lists))
                first = np.r_[0, np.cumsum([len(x) for x in lists])]
                of = lambda v: np.diff(np.r_[0, np.cumsum(v[place])][first]).astype(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in KEPT] + [pa.array(of(best.astype(np.int64))), pa.array(of(n))], [*KEPT, "n_best", "count_sum"]
                )

    return documents.select(*KEPT, "links").mapInArrow(run, f"{KEPT_SCHEMA}, n_best long, count_sum long")


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
KEPT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups string"
LIST = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))


def _joined(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on the pair: each document brings each of its pairs once, with the number of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                rows = whole.slice(at, PART)
                found = [np.unique(np.frombuffer(x, "<i8"), return_counts=True) for x in rows.column("links").to_pylist()]
                offsets = np.r_[0, np.cumsum([len(p) for p, _ in found])].astype(np.int32)
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in (0, 1)], ["pair", "times"]
                )
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([rows.column("row"), lists], ["row", "pairs"])

    listed = documents.select("row", "links").mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("pairs", LIST)]))
    pairs = listed.select("row", F.explode("pairs").alias("own")).select("row", "own.*")
    sums = pairs.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    out = documents.select("row", *KEPT).join(sums, "row", "left")
    return out.select(*KEPT, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))


def align_tokenizers(
    docs: DataFrame, vocabulary_a: str, vocabulary_b: str, text: str = "text", key: str = "doc_id", broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """Rows ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, one per row of ``docs``.

    ``vocabulary_a`` is a byte-level tokenizers file, ``vocabulary_b`` a sentencepiece model; both are read on the driver.
    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of either side, groups cut where tokens of both end.  ``n_best`` counts links
    whose corpus-wide count is the highest of their B id (ties count), ``count_sum`` adds the counts of all links.  A text
    that is null or empty, or that either side does not spell, has zeros and no group text.  Null and repeated ids are
    documents of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    with open(vocabulary_a, "rb") as a, open(vocabulary_b, "rb") as b:
        coded = steps.write(_encode(docs, text, key, a.read(), b.read()), "aligned")
    total = coded.where("kind = 'pair'").groupBy("pair").agg(F.sum("n").alias("n"))
    total = steps.write(total, "pairs")
    highest = total.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("highest"))
    counts = total.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(highest, "b")
    counts = counts.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    documents = coded.where("kind = 'doc'")
    if 17 * total.count() <= broadcast_bytes:
        out = _counted(documents, counts, broadcast_bytes)
    else:
        # Numbers of rows must not change when a lost task runs again, so they are written.
        out = _joined(materialise(documents.withColumn("row", F.monotonically_increasing_id()), "aligned-rows"), counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
