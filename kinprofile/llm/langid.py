"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case letters with one blank between words.  Its character n-grams of every order are hashed into
a fixed number of buckets; a language is a smoothed log-probability per bucket.  The model is a matrix of buckets x
languages, broadcast; its size is fixed by parameters and the number of languages.  Scoring a batch is a sparse product:
the matrix rows of all n-grams of the batch are gathered and summed per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.common import add_columns, settle

_PLAIN = re.compile("[A-Za-z]")
_OTHERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_PLAIN.search(text) or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages: log P(n-gram | language)
    prior: np.ndarray  # log P(language)
    bits: int
    orders: tuple[int, ...]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each between two blanks, and the text of each character."""
    plain = [" " + _OTHERS.sub(" ", (t or "").lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.repeat(np.arange(len(plain)), np.fromiter(map(len, plain), np.int64, len(plain)))


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character but the last ``order - 1``."""
    h = np.full(max(0, len(codes) - order + 1), order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)


def _blocks(texts: list, chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``chars`` characters together, for arrays that stay in the processor's cache."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, docs_per_language: int = 4000,
    orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5,
) -> LanguageModel:
    """Learn from rows with a text that has a letter and a non-null ``lang``.

    The sample is bounded: of every language about ``docs_per_language`` rows (all, if there are fewer), those whose hash
    of ``key`` (the text, if not given) is smallest by share.  N-gram counts are summed inside the tasks; what is
    collected is one row per language and bucket.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = {r[lang]: min(1.0, docs_per_language / r["count"]) for r in known.groupBy(lang).count().collect()}
    languages = tuple(sorted(share))
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits, orders)
    limits = F.create_map(*[F.lit(x) for k in languages for x in (k, share[k])])
    draw = F.pmod(F.xxhash64(F.lit(29), key if key is not None else F.col(text)), F.lit(1_000_003)) / 1_000_003
    sample = known.where(draw < F.element_at(limits, F.col(lang))).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total = np.zeros((len(languages), 1 << bits), np.int64)
        at = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                own = [t for t, n in zip(texts, names) if n == name and has_letter(t)]
                for begin, end in _blocks(own):
                    codes, _ = _codes(own[begin:end])
                    for order in orders:
                        total[at[name]] += np.bincount(_buckets(codes, order, bits), minlength=1 << bits)
        lang_at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang_at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang_at, bucket])],
            ["lang", "bucket", "n"],
        )

    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((1 << bits, len(languages)), smoothing)
    for r in found.toLocalIterator():
        counts[r["bucket"], r["lang"]] += r["n"]
    prior = np.full(len(languages), -np.log(len(languages)))  # a text's language is not guessed from the corpus' mix
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32), prior, bits, orders)


def score(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; ``und`` and 0 for a null text, one without a letter, or an empty model."""
    names, scores = [], np.zeros(len(texts))
    for begin, end in _blocks(texts):
        part = texts[begin:end]
        if not model.languages:
            names += [UNKNOWN] * len(part)
            continue
        codes, owner = _codes(part)
        total = np.zeros((len(part), len(model.languages)))
        first = np.searchsorted(owner, np.arange(len(part)))
        for order in model.orders:
            bucket = _buckets(codes, order, model.bits)
            # N-grams that reach into the next text belong to none of them.
            inside = owner[: len(bucket)] == owner[order - 1 :] if order > 1 else slice(None)
            bucket, own = bucket[inside], owner[: len(bucket)][inside]
            first = np.searchsorted(own, np.arange(len(part)))
            some = np.flatnonzero(np.diff(np.r_[first, len(own)]))
            for k in range(len(model.languages)):
                gathered = model.weights[:, k][bucket]
                total[some, k] += np.add.reduceat(gathered, first[some], dtype=np.float64)
        total += model.prior
        best = total.argmax(1)
        scores[begin:end] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, t in enumerate(part):
            if has_letter(t):
                names.append(model.languages[best[i]])
            else:
                names.append(UNKNOWN)
                scores[begin + i] = 0.0
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior, 0 to 1), from the whole text and nothing else.

    A null text or one without a letter is ``und`` with score 0; ties go to the alphabetically first language.  Columns
    of these names are replaced, all others kept; every row is its own, an empty table stays empty.
    """
    weights = model.weights.T.copy()  # one contiguous row per language
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, weights, model.prior, model.bits, model.orders))

    def make():
        languages, rows, prior, bits, orders = shared.value
        own = LanguageModel(languages, rows.T, prior, bits, orders)

        def columns(texts: list) -> dict[str, pa.Array]:
            names, scores = score(own, texts)
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

        return columns

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return add_columns(docs, text, make, added)
