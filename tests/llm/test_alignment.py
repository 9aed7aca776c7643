"""Tokenizer alignment against the tokenizers' own libraries and the definition."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import awkward, empty
from tokenizers import Tokenizer

from kinprofile.llm import alignment
from kinprofile.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "a  b", "<s>x</s><0x41>", "\n\tq  \r\n", "héé ﬁ ½ ▁z", "日本 \x00 x", " lead", "trail ", "​x\xa0y", "<|endoftext|>", "▁", " ", "\n",
    "a" * 3000, "don't I'LL 1234½", "é́ \U0001f600\U0001f468‍\U0001f469", "  b 　 c \x85 d  ",
]


@pytest.fixture(scope="module")
def coders():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def by_definition(rows, coders):
    one, two = coders
    letters = alignment.byte_letters()
    aligned, counts = [], Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            b = [
                (i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())
                for i in two.encode(text)
            ]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), [i for i, _ in side])) for side in (a, b))
        common = sorted(ends_a.keys() & ends_b.keys())
        links = [(ends_a[e], ends_b[e]) for e in common]
        counts.update(links)
        sides = [(sorted(side), side) for side in (ends_a, ends_b)]
        cuts = [[0, *(bisect.bisect(rising, e) for e in common)] for rising, _ in sides]
        groups = []
        for g in range(len(common)):
            own = [[str(side[x]) for x in rising[cut[g] : cut[g + 1]]] for (rising, side), cut in zip(sides, cuts)]
            groups.append("|".join(",".join(s) for s in own))
        aligned.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((d, n, m, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), t) for d, n, m, g, ls, t in aligned),
        key=repr,
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_equals_the_definition_on_odd_texts(spark, coders, broadcast_bytes):
    rows = list(enumerate(ODD + ODD[:3])) + [(None, "x y"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align_tokenizers(df, A, B, broadcast_bytes=broadcast_bytes)) == by_definition(rows, coders)


def test_equals_the_definition_on_the_given_documents(spark, coders):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = by_definition(rows, coders)
    found = QUERIES["op13_alignment"](spark, SF).collect()
    got = sorted(
        ((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found), key=repr
    )
    assert got == sorted(((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[1] else "") for w in want), key=repr)


def test_ids_are_those_of_the_tokenizers_library(spark, coders):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    own = alignment.ByteLevel(open(A, "rb").read()).encode(texts)
    assert own == [e.ids for e in coders[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_terminals_of_long_chains():
    # One side's tokens straddle the other's all along: a single component of 10,001 tokens.
    end_a = np.r_[np.arange(2, 10_002, 2), 10_001]
    end_b = np.r_[np.arange(1, 10_001, 2), 10_001]
    group_a, group_b = alignment.terminals(end_a, end_b)
    assert set(group_a.tolist()) == set(group_b.tolist()) == {len(end_b) - 1}
    one = np.arange(1, 50)
    group_a, group_b = alignment.terminals(one, one)
    assert group_a.tolist() == group_b.tolist() == list(range(49))


def test_awkward_rows(spark, coders):
    df = awkward(spark, pair="x", kind="y", links="z", row="r")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for broadcast_bytes in (64 << 20, 0):
        assert rows_of(alignment.align_tokenizers(df, A, B, broadcast_bytes=broadcast_bytes)) == by_definition(rows, coders)
    for broadcast_bytes in (64 << 20, -1):
        assert alignment.align_tokenizers(empty(spark), A, B, broadcast_bytes=broadcast_bytes).count() == 0
