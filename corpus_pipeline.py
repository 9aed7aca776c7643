"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns a DataFrame; ``run`` writes
each stage as Parquet below ``spark.checkpoint.dir`` and reads it again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprofile.llm import langid, linededup, minhash, packing, pii
from kinprofile.llm.common import materialise, table
from kinprofile.llm.queries import TOKENIZER, language_model, pii_model


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the column ``text`` as its text (and its length, where the table has one); other columns as they were."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return docs.withColumns(new)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: those without any letter go, and those no language explains by half."""
    found = langid.predict(docs, language_model(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; documents stay, a null text becomes empty."""
    return _with_text(linededup.dedup_lines(docs, min_docs=10, min_chars=1), "kept_text").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return _with_text(pii.detect(docs, pii_model(docs)), "pii_redacted").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=2, size=4096)


STAGES = [
    ("language", language), ("lines", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("pack", pack),
]

#: Learned models and tokenization are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
