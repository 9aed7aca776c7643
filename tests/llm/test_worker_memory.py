"""What a worker keeps from one stage to the next."""

import uuid

import public_tokenizers
import pytest

from kinprofile.llm import alignment, packing
from kinprofile.llm.queries import TOKENIZER

DOCS = [(i, f"some words, {i % 7} of them {'again ' * (i % 5)}") for i in range(600)]


@pytest.fixture
def calls(tmp_path, monkeypatch):
    """What the tasks of either operator said they keep."""
    folder = str(tmp_path)

    def told(own=None):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(getattr(own, "__name__", "nothing"))

    monkeypatch.setattr(packing, "settle", told, raising=False)
    monkeypatch.setattr(alignment, "settle", told)
    return lambda: sorted(p.read_text() for p in tmp_path.iterdir())


def test_packing_drops_the_tokeniser_before_it_fills_windows(spark, calls):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    assert packing.pack(docs, public_tokenizers.path(TOKENIZER)).count() >= len(DOCS)
    assert calls() == ["forget", "nothing", "nothing"]  # tokens, counts, windows


def test_alignment_starts_every_stage_clean_and_counts_pairs_together(spark, calls):
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    assert alignment.align_tokenizers(docs, *paths).count() == len(DOCS)
    assert len(calls()) >= 2
    with open(paths[0], "rb") as a, open(paths[1], "rb") as b:
        pairs = alignment._encode(docs, "text", "doc_id", a.read(), b.read()).where("kind = 'pair'")
        assert pairs.count() == pairs.select("pair").distinct().count()  # a small task sends every pair once
