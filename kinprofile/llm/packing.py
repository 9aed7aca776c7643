"""Packing by lexical retrieval: each window is a seed document followed by its unused BM25 neighbours.

1. Every text becomes token ids plus an end id; the table of ids is written once.  Each task also writes in how many of
   its documents every id occurs; their sum (one number per vocabulary entry) gives the corpus-wide BM25 weights.
2. Documents are dealt to index shards of about ``shard_tokens`` tokens by ranges of a similarity key (a min-hash of
   token pairs, then the document id), so look-alikes share a shard and a key of any weight is cut by id.
3. A shard builds its inverted index (postings by term, weights ready) and fills its windows: the seed is the document
   the last window cut off, else the next unused one; the index scores all unused documents of the shard for the seed's
   terms and they are appended, best first, until the window is full.  The document that does not fit is cut and its
   rest seeds the next window, so only the last window of a shard is short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.bpe import codec, forget
from kinprofile.llm.common import scratch_path, setting, settle

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])
TOKENS = "kind string, doc_id long, key long, n_tokens long, ids binary, counts binary"
K1, B = 1.2, 0.75
PART = 750  # documents that reach a worker and are tokenised together
MEMO = 400_000  # words whose ids a worker keeps


def similarity_keys(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Smallest hash of two neighbouring ids of every document: documents that share much text often share it.

    ``ids`` holds the documents one after another, none empty; a document of one id has the hash of that id.
    """
    ids = ids.astype(np.uint64)
    following = np.r_[ids[1:], np.zeros(1, np.uint64)]
    last = begin[1:] - 1
    single = np.diff(begin) == 1
    pairs = ids << np.uint64(32) | following
    pairs[last] = np.where(single, ids[last], np.uint64(0))
    pairs = (pairs ^ pairs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    pairs = (pairs ^ pairs >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    pairs[last[~single]] = np.uint64(0xFFFFFFFFFFFFFFFF)  # no pair begins with the last id
    return (np.minimum.reduceat(pairs, begin[:-1]) >> np.uint64(1)).astype(np.int64)


def _occurring(ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts`` in how many of the documents every id occurs."""
    few = 16
    latest = np.zeros(few * len(counts), np.int32)  # by document and id: the last token with it, read only where just written
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    cell = owner % few * len(counts) + ids
    for at in range(0, len(begin) - 1, few):
        first, end = int(begin[at]), int(begin[min(at + few, len(begin) - 1)])
        some, tokens = cell[first:end], np.arange(end - first, dtype=np.int32)
        latest[some] = tokens
        counts += np.bincount(ids[first:end][latest[some] == tokens], minlength=len(counts))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Written table of ``(doc_id, key, n_tokens, ids)`` rows (kind 'doc') and one row of document ``counts`` per task (kind 'df').

    Ids take two bytes each where the vocabulary allows it, else four.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(forget)
        own = codec(spec.value, MEMO)
        counts = np.zeros(max(len(own.labels), end_id + 1), "<i8")
        narrow = np.dtype("<u2" if len(counts) <= 1 << 16 else "<u4")
        names, n_docs, n_tokens = ["kind", "doc_id", "key", "n_tokens", "ids", "counts"], 0, 0
        for rows in batches:
            for at in range(0, rows.num_rows, PART):
                part = rows.slice(at, PART)
                ids, begin = own.encode_flat(part.column("text").to_pylist())
                ids = np.insert(ids, begin[1:], end_id).astype("<u4")
                begin = begin + np.arange(len(begin))
                sizes = np.diff(begin)
                _occurring(ids, begin, counts)
                n_docs += len(sizes)
                n_tokens += len(ids)
                kind, keys = pa.array(["doc"] * len(sizes), pa.string()), pa.array(similarity_keys(ids, begin))
                buffers = [None, pa.py_buffer(narrow.itemsize * begin), pa.py_buffer(ids.astype(narrow))]
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())
                none = pa.nulls(len(sizes), pa.binary())
                yield pa.RecordBatch.from_arrays([kind, part.column("doc_id"), keys, pa.array(sizes), stored, none], names)
        if n_docs:
            columns = [["df"], [None], [n_docs], [n_tokens], [None], [counts.tobytes()]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    path = scratch_path(spark, "tokens")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PART)):
        source.mapInArrow(run, TOKENS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


def corpus_counts(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document count of every id, number of documents, number of tokens: sums over all tasks' rows.

    What reaches the driver is one number per vocabulary entry, whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total, docs, size = np.zeros(0, np.int64), 0, 0
        for rows in batches:
            for row in rows.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                total = np.resize(np.r_[total, np.zeros(max(0, len(counts) - len(total)), np.int64)], max(len(total), len(counts)))
                total[: len(counts)] += counts
                docs, size = docs + row["key"], size + row["n_tokens"]
        some = np.flatnonzero(total)
        id_, n = np.r_[-2, -1, some], np.r_[docs, size, total[some]]
        yield pa.RecordBatch.from_arrays([pa.array(id_, pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    some = tokens.where("kind = 'df'").select("key", "n_tokens", "counts")
    rows = some.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r["id"]: r["n"] for r in rows}
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for i, n in found.items():
        if i >= 0:
            df[i] = n
    return df, found.get(-2, 0), found.get(-1, 0)


class Shard:
    """Inverted index over the documents of one shard, and the windows filled from it."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean_size: float) -> None:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(docs).astype(np.uint64)
        owner = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
        useful = weight[flat] > 0
        cell, times = np.unique(owner[useful] << np.uint64(32) | flat[useful], return_counts=True)
        doc, term = (cell >> np.uint64(32)).astype(np.int64), (cell & np.uint64(0xFFFFFFFF)).astype(np.int64)
        score = weight[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[doc] / mean_size))
        self.terms, self.first_term = term, np.searchsorted(doc, np.arange(len(docs) + 1))
        narrow = term.astype(np.uint16) if len(weight) <= 1 << 16 else term  # 16 bits are sorted by counting
        by_term = np.argsort(narrow, kind="stable")
        self.posting_doc, self.posting_score = doc[by_term], score[by_term]
        rising = term[by_term]
        first = np.flatnonzero(np.r_[True, rising[1:] != rising[:-1]]) if len(rising) else np.empty(0, np.int64)
        self.vocabulary, self.first_posting = rising[first], np.r_[first, len(by_term)]
        self.unused = np.ones(len(docs), bool)
        self.docs, self.sizes = docs, sizes

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by BM25 score for the terms of ``seed``, ties and zero scores in the shard's order."""
        at = np.searchsorted(self.vocabulary, self.terms[self.first_term[seed] : self.first_term[seed + 1]])
        begin, count = self.first_posting[at], self.first_posting[at + 1] - self.first_posting[at]
        rows = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) if len(at) else np.zeros(0, np.int64)
        rows += np.arange(len(rows))
        scores = np.bincount(self.posting_doc.take(rows), self.posting_score.take(rows), len(self.docs))
        left = np.flatnonzero(self.unused)
        found = scores[left] > 0
        some = left[found]
        yield from some[np.argsort(-scores[some], kind="stable")].tolist()
        yield from left[~found].tolist()

    def windows(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of pieces ``(document, start, length)``; every list but the last is exactly ``size`` long."""
        rest: tuple[int, int] | None = None
        following, room, window, ranked = 0, size, [], None
        while True:
            if rest is None and ranked is not None and window:
                doc = next(ranked, None)
            elif rest is None:
                while following < len(self.docs) and not self.unused[following]:
                    following += 1
                doc = following if following < len(self.docs) else None
            if rest is not None:
                doc, start = rest
            elif doc is None:
                break
            else:
                start = 0
                self.unused[doc] = False
            length = min(room, int(self.sizes[doc]) - start)
            first = not window
            window.append((doc, start, length))
            room -= length
            rest = (doc, start + length) if start + length < self.sizes[doc] else None
            if not room:
                yield window
                room, window, ranked = size, [], None
            elif first:
                ranked = self.neighbours(doc)
        if window:
            yield window


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, shard_tokens: int = 1_000_000
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens, see the module text.

    Rows ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``; ``ids`` is binary, little-endian unsigned
    32-bit.  A null or empty text is its end id alone.  Rows that repeat a ``doc_id`` are packed as documents of their
    own; a null ``doc_id`` stays null.  Other columns are ignored, an empty table gives no rows.
    Memory of a task: about ``shard_tokens`` tokens, or one document if that is longer.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, tokenizer, end_id)
    df, n_docs, n_tokens = corpus_counts(tokens)
    # Classic BM25 weight; ids in over half of all documents tell nothing and weigh 0.
    weight = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    mean_size = n_tokens / max(1, n_docs)
    shared = spark.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()  # a worker that tokenised still holds the automaton and its words
        task, made = TaskContext.get().partitionId(), 0

        def flush(ids: list, found: list) -> pa.RecordBatch:
            nonlocal made
            rows: list[tuple] = []
            shard = Shard(found, shared.value, mean_size)
            for window in shard.windows(size):
                offset = 0
                for doc, start, length in window:
                    piece = found[doc][start : start + length].astype("<u4").tobytes()
                    rows.append((ids[doc], start, length, piece, len(found[doc]), task << 32 | made, offset))
                    offset += length
                made += 1
            names = PIECES.fieldNames()
            types = [pa.binary() if n == "ids" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        ids, found, held = [], [], 0
        for rows in batches:
            for doc_id, n, b in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                if held > 1.5 * shard_tokens:
                    yield flush(ids, found)
                    ids, found, held = [], [], 0
                ids.append(doc_id)
                found.append(np.frombuffer(b, f"<u{len(b) // n}"))
                held += n
        if ids:
            yield flush(ids, found)

    shards = max(1, math.ceil(n_tokens / shard_tokens))
    dealt = tokens.where("kind = 'doc'").select("key", "doc_id", "n_tokens", "ids")
    if shards > 1:
        dealt = dealt.repartitionByRange(shards, "key", "doc_id")
    else:
        dealt = dealt.coalesce(1)
    return dealt.sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "n_tokens", "ids").mapInArrow(run, PIECES)
