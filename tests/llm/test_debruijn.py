"""Substring dedup against its definition."""

import random
import re

import pytest
from fixtures import awkward, empty, prose

from kinprofile.llm import debruijn

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_definition(rows, k):
    """Expected (n_words, n_removed, kept_text) of every row."""
    first: dict[tuple, int] = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - k + 1) if doc is not None else ():
            own = tuple(words[i : i + k])
            first[own] = min(first.get(own, doc), doc)
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - k + 1) if doc is not None else ():
            if first[tuple(words[i : i + k])] < doc:
                gone.update(range(i, i + k))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def found(df, k):
    rows = debruijn.drop_repeats(df, k=k).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(map(tuple, rows), key=repr)


def collage(seed, n, k):
    """Documents that share passages, whole texts and single repeated words."""
    rng = random.Random(seed)
    passages = [prose(1000 + i, rng.randrange(k - 3, 6 * k)) for i in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice(passages).split(" ")
            a = rng.randrange(len(own))
            parts += [" ".join(own[a : a + rng.randrange(1, len(own) + 1)]), prose(rng.randrange(10**6), rng.randrange(1, 9))]
        if rng.random() < 0.2:
            parts.append("na " * rng.randrange(1, 60))
        rows.append((rng.randrange(n), rng.choice([" ", "\n", "\t  "]).join(parts)))
        if rng.random() < 0.2:
            rows.append((1000 + i, rows[-1][1] if rng.random() < 0.5 else rows[-1][1].replace(" ", "\n")))
    return rows


@pytest.mark.parametrize(("seed", "k"), [(1, 13), (2, 3), (3, 6)])
def test_equals_the_definition(spark, seed, k):
    rows = collage(seed, 150, k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, k) == by_definition(rows, k)


def test_equals_the_definition_on_the_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(df, 13) == by_definition([tuple(r) for r in df.collect()], 13)


def test_spans_carry_true_source_coordinates_and_paths_do_not_branch(spark):
    rows = [(i, t) for i, (_, t) in enumerate(collage(5, 80, 13))]
    repeats = debruijn.find(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {d: WORD.findall(t) for d, t in rows}
    spans = repeats.spans.collect()
    assert spans
    for s in spans:
        assert s["sdoc"] < s["doc"]
        assert text[s["doc"]][s["pos"] : s["pos"] + s["n"] + 12] == text[s["sdoc"]][s["spos"] : s["spos"] + s["n"] + 12]
    ends = {(s["sdoc"], p) for s in spans for p in (s["spos"], s["spos"] + s["n"])}
    paths = repeats.paths().collect()
    for p in paths:
        windows = p["n_words"] - 12
        crossing = [s for s in spans if s["sdoc"] == p["doc_id"] and s["spos"] <= p["start"] and p["start"] + windows <= s["spos"] + s["n"]]
        assert windows >= 1 and len(crossing) == p["n_spans"] > 0
        assert not any((p["doc_id"], q) in ends for q in range(p["start"] + 1, p["start"] + windows))


def test_awkward_rows(spark):
    df = awkward(spark, N_Words="x", kept_text="y", own_t="z", hits="w")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(df, 13) == by_definition(rows, 13)
    out = debruijn.drop_repeats(df)
    assert {r["own_t"] for r in out.collect()} == {"z"} and {r["hits"] for r in out.collect()} == {"w"}
    assert debruijn.drop_repeats(empty(spark)).count() == 0
