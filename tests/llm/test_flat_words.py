"""Words of many texts at once: found again by their bytes in arrays, new ones read together."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import prose
from tokenizers import Tokenizer

from kinprofile.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def test_plain_and_known_words_are_not_handled_one_by_one(spec, monkeypatch):
    own = bpe.Codec(spec)
    learn, read, seen, rows = own._learn, own.tables._read, set(), []
    monkeypatch.setattr(own, "_learn", lambda chunks: (seen.update(chunks), learn(chunks)))
    monkeypatch.setattr(own.tables, "_read", lambda text, size: (rows.append(len(text)), read(text, size))[1])
    texts = [" Some plain words.&&& here, straße### x2 end%%%", "plain words,*** again"] * 3
    flat, begin = own.encode_flat(texts)
    assert seen == {".&&&", ",", "###", "x2", "%%%", ",***"} and sum(rows) >= 7
    seen.clear()
    rows.clear()
    again, _ = own.encode_flat(texts[::-1])
    assert not seen and not rows
    assert sorted(flat.tolist()) == sorted(again.tolist()) and begin[-1] == len(flat)


def test_ids_stay_right_while_the_memo_starts_anew(spec):
    library, own, rng = Tokenizer.from_file(PATH), bpe.Codec(spec, memo=40), random.Random(3)
    letters = "abcdefghijklmnoéß日"
    stems = ["a" * n for n in (30, 31, 32, 33, 63, 64, 65, 200)] + ["é" * n for n in (15, 16, 17, 32, 33)]
    words = [*stems, *(w + "b" for w in stems), "a\x00", "a", "a\x00\x00", "a'", "a's", "a's!", "'s", "a1##", "a##1", "b^`~", "b_c_", "日本。", "b¡¡"]
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + prose(6, 200).split()
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(20)]
        flat, begin = own.encode_flat(texts)
        for text, a, b in zip(texts, begin, begin[1:]):
            assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    assert own._words.count < 40 + len(words) * 2


@pytest.mark.parametrize("meeting", [False, True])
def test_words_are_told_apart_when_their_hashes_meet(monkeypatch, meeting):
    if meeting:
        monkeypatch.setattr(bpe.Words, "_slot", lambda self, keys: np.full(len(keys), len(self.slots) - 2))
    store, n = bpe.Words(), 150 if meeting else 60_000
    column = pa.array([f"{k:b}"[-20:] + f"{k}" for k in range(n)], pa.large_string())
    begin = np.frombuffer(column.buffers()[1], np.int64)[: n + 1]
    data = np.r_[np.frombuffer(column.buffers()[2], np.uint8), np.zeros(32, np.uint8)]
    keys = store.keys_of(data, begin[:-1], np.diff(begin))
    some = np.arange(n) % 3 > 0
    size = np.arange(n)[some] % 4
    numbers = store.add(keys[some], np.arange(size.sum(), dtype="<u4"), np.cumsum(size) - size, size, np.arange(some.sum()) % 5 > 0)
    found = store.find(keys)
    assert (found[~some] == -1).all()
    assert np.array_equal(found[some], np.where(np.arange(some.sum()) % 5 > 0, numbers, -1))
    assert np.array_equal(store.first[numbers], np.cumsum(size) - size) and np.array_equal(store.size[numbers], size)


def test_document_counts_equal_a_plain_count():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, rng.integers(1, 90)).astype("<u4") for _ in range(70)]
    counts = np.ones(60, "<i8")
    packing._occurring(np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])], counts)
    plain = np.ones(60, np.int64)
    for d in docs:
        plain[np.unique(d)] += 1
    assert np.array_equal(counts, plain)


def test_ids_are_written_as_narrow_as_the_vocabulary_allows(spark):
    docs = spark.createDataFrame([(i, f"row {i} {'of more words ' * (i % 9)}") for i in range(60)], "doc_id long, text string")
    sizes, pieces = [], []
    for end_id in (2, 70_000):
        tokens = packing.tokenise(docs, PATH, end_id)
        sizes.append({len(r["ids"]) // r["n_tokens"] for r in tokens.where("kind = 'doc'").collect()})
        rows = packing.pack(docs, PATH, end_id=end_id).collect()
        own = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4") for r in rows}
        whole = {d: np.concatenate([own[k] for k in sorted(own) if k[0] == d]) for d in range(60)}
        assert {int(ids[-1]) for ids in whole.values()} == {end_id}
        pieces.append({d: ids[:-1].tolist() for d, ids in whole.items()})
    assert sizes == [{2}, {4}] and pieces[0] == pieces[1]
