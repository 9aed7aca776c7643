"""Similarity operators against all pairs, and on awkward rows."""

import random

import numpy as np
import pytest
from fixtures import awkward, empty, prose, vectors
from pyspark.sql import functions as F

from kinprofile.llm import ann, embdedup, minhash, sharding
from kinprofile.llm.common import components

SF = "/root/testdata/sf0.001"


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(999 - k, 998 - k) for k in range(40)]
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(5, 5)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(df).collect()}
    links = [e for e in links if e[0] != e[1]]  # a loop is no link
    want = smallest_reachable({n for e in links for n in e}, links)
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicate documents ---


def sets_of(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def variants():
    rng = random.Random(7)
    rows = []
    for group in range(12):
        words = prose(100 + group, 80).split()
        for _ in range(14):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(1000)}"
            rows.append(" ".join(own))
    rows += [prose(k, 60) for k in range(40)] + ["one two", "ONE  two", "one two three", "", None]
    return list(enumerate(rows))


def test_near_duplicates_equal_all_pairs(spark):
    rows = variants()
    own = {k: sets_of(t) for k, t in rows}
    links = [
        (a, b) for a in own for b in own
        if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])
    ]
    want = smallest_reachable(own, links)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["n_shingles"] == len(own[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_sequential_pruning_misses_few_links():
    rng = np.random.default_rng(3)
    least = minhash.least_agreement(0.75, 1e-4)
    lost = 0
    for _ in range(4000):
        agree = np.cumsum((rng.random(minhash.BANDS * minhash.ROWS) < 0.76).reshape(-1, minhash.BATCH).sum(1))
        lost += bool((agree < least).any())
    assert lost <= 8
    far = np.cumsum((rng.random(minhash.BANDS * minhash.ROWS) < 0.3).reshape(-1, minhash.BATCH).sum(1))
    assert far[0] < least[0]


@pytest.mark.parametrize("threshold, miss", [(0.75, 1e-4), (0.75, 1e-6), (0.9, 1e-5), (0.5, 1e-3)])
def test_all_looks_together_lose_at_most_miss(threshold, miss):
    least = minhash.least_agreement(threshold, miss)
    p = threshold + (1 - threshold) / minhash.CELLS
    alive, lost = {0: 1.0}, 0.0  # chance of every number of agreeing bytes, one byte at a time
    for n in range(1, minhash.BANDS * minhash.ROWS + 1):
        step = {}
        for m, chance in alive.items():
            step[m] = step.get(m, 0.0) + chance * (1 - p)
            step[m + 1] = step.get(m + 1, 0.0) + chance * p
        alive = step
        if n % minhash.BATCH == 0:
            need = least[n // minhash.BATCH - 1]
            lost += sum(chance for m, chance in alive.items() if m < need)
            alive = {m: chance for m, chance in alive.items() if m >= need}
    assert miss / 10 < lost <= miss
    assert (least[0] > 0) and (np.diff(least) > 0).all()


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 1500, np.uint64)
    a, b = minhash.signature(pool[:1000]), minhash.signature(pool[200:1200])
    assert (a == b).mean() == pytest.approx(800 / 1200, abs=0.09)
    assert (minhash.signature(pool[:1]) == minhash.signature(pool[1:2])).mean() < 0.05


def test_near_duplicates_awkward_rows(spark):
    rows = minhash.near_duplicates(awkward(spark, n_shingles="x", kept="y")).collect()
    assert len(rows) == 11
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["kept"] and by_id[1]["n_shingles"] == 0 and by_id[1]["component_id"] == 1
    assert by_id[6]["component_id"] == 5 and not by_id[6]["kept"] and by_id[4]["n_shingles"] > 50_000
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = minhash.keep_one(awkward(spark, kept="y"))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8] and "kept" in kept.columns


# --- embeddings ---


def clouds(seed=1, groups=20, each=30, d=16, noise=0.06):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, each, 0) + rng.normal(size=(groups * each, d)) * noise
    return (rows * rng.uniform(0.5, 4, (len(rows), 1))).astype(np.float32)


def test_embedding_links_equal_all_pairs(spark):
    rows = clouds()
    rows[7] = rows[3]
    rows[400] = rows[3]
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    given = [(k, [float(x) for x in r]) for k, r in enumerate(rows)]
    found = embdedup.near_duplicates(vectors(spark, given), leaf_size=64, block=40).collect()
    want = smallest_reachable(range(len(rows)), np.argwhere(near).tolist())
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(near.sum(1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in found} == want


def links_of(rows, threshold=0.95):
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


def test_deeper_splits_lose_no_link(spark):
    """A sample of 200 rows places four levels at most; the other levels come from samples of the leaves."""
    rows = clouds()
    given = vectors(spark, [(k, [float(x) for x in r]) for k, r in enumerate(rows)])
    near = links_of(rows)
    want = smallest_reachable(range(len(rows)), np.argwhere(near).tolist())
    found = embdedup.near_duplicates(given, leaf_size=16, sample=200, block=40).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(near.sum(1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in found} == want


def test_forest_finds_planted_links_of_the_given_table(spark, monkeypatch):
    """Copies of the given vectors at cosine 0.95 to 0.96, default parameters: the trees split, and no link is lost."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    rows = np.array([r["embedding"] for r in table], float)
    rng = np.random.default_rng(8)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    aside = rng.normal(size=rows.shape)
    aside -= (aside * unit).sum(1, keepdims=True) * unit
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, size=(len(rows), 1))
    every = np.r_[rows, cosine * unit + np.sqrt(1 - cosine**2) * aside].astype(np.float32)
    depths, plain = [], embdedup.Forest.__init__

    def noted(self, d, depth, *rest):
        depths.append(depth)
        plain(self, d, depth, *rest)

    monkeypatch.setattr(embdedup.Forest, "__init__", noted)
    given = vectors(spark, [(k, [float(x) for x in r]) for k, r in enumerate(every)])
    found = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(given).collect()}
    near = links_of(every)
    assert near.sum() >= 2 * len(rows) and min(depths) >= 2
    assert sum(found.values()) == near.sum() and found == dict(enumerate(near.sum(1).tolist()))


def test_pairs_at_the_threshold_do_not_depend_on_blocks(spark):
    """Cosine 0.95 within rounding: 3-4-5 like vectors whose ordered sum decides."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    every = np.r_[base, 0.95 * base + np.sqrt(1 - 0.95**2) * aside]
    given = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(every)], "vec_id long, embedding array<double>")
    answers = [
        {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(given, block=b, leaf_size=s).collect()}
        for b, s in ((7, 512), (2048, 512))
    ]
    assert answers[0] == answers[1]


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]),
        (8, [inf, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]),
    ]


def test_embedding_links_awkward_rows(spark):
    rows = embdedup.near_duplicates(vectors(spark, odd_vectors()).withColumn("kept", F.lit("x"))).collect()
    assert len(rows) == 13
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert links[1] == (1, 1) and links[2] == (1, 1) and links[9] == (1, 9) and links[10] == (1, 9) and links[11] == (1, 11)
    assert all(links[k] == (0, k) for k in (3, 4, 5, 6, 7, 8)) and links[None] == (0, None)
    assert embdedup.near_duplicates(vectors(spark, [])).count() == 0


def best_by_hand(rows, asked, k):
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(rows)), scores.shape), -scores), axis=1)
    return order[:, :k]


def test_search_recall_and_scores(spark):
    rows = clouds(2, 60, 50, 24, 0.15).astype(float)
    given = vectors(spark, [(k, [float(x) for x in r]) for k, r in enumerate(rows)])
    found = ann.search(given.where("vec_id % 20 = 0"), given, k=20, list_size=64, group_rows=500).collect()
    asked = list(range(0, len(rows), 20))
    want = best_by_hand(rows, asked, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), rel=1e-12)
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert all(len(x) == 20 and x == sorted(x, key=lambda p: (-p[0], p[1])) for x in got.values())
    hits = sum(len({v for _, v in got[q]} & set(w.tolist())) for q, w in zip(asked, want))
    assert hits / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_search_recall_on_the_given_table(spark, scale, monkeypatch):
    table = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding")
    rows = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], float)
    lists, plain = [], ann.CentroidGraph.__init__

    def noted(self, centres):
        lists.append(len(centres))
        plain(self, centres)

    monkeypatch.setattr(ann.CentroidGraph, "__init__", noted)
    found = ann.search(table.where("vec_id % 20 = 0"), table, k=20).collect()
    asked = list(range(0, len(rows), 20))
    want = {q: set(w.tolist()) for q, w in zip(asked, best_by_hand(rows, asked, 20))}
    assert lists == [-(-len(rows) // 256)] and lists[0] > 1  # never searched whole
    recall = sum(r["vec_id"] in want[r["query_id"]] for r in found) / (20 * len(asked))
    print(f"recall at {scale}: {recall:.4f}")
    assert recall >= 0.9


def test_search_awkward_rows(spark):
    given = vectors(spark, odd_vectors())
    found = ann.search(given, given, k=3).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by[1] == [(2, 2.0), (11, 0.0)] and set(by) == {1, 2, 11}
    assert ann.search(vectors(spark, []), vectors(spark, [])).count() == 0
    same = vectors(spark, [(k, [1.0, 1.0]) for k in range(50)])
    first = ann.search(same.where("vec_id = 40"), same, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in first] == [0, 1, 2, 3, 4]


# --- sharding ---


def test_matrix_margins_and_mean():
    rows, columns = [100, 0, 37, 263], [57, 57, 56, 56, 56, 56, 31, 31]
    total = np.zeros((4, 8))
    for seed in range(300):
        drawn = np.array(sharding.communication_matrix(rows, columns, seed))
        assert drawn.sum(1).tolist() == rows and drawn.sum(0).tolist() == columns and (drawn >= 0).all()
        total += drawn
    want = np.outer(rows, columns) / 400
    assert np.abs(total / 300 - want).max() < 1


def test_large_urns_follow_the_law():
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 3_000_000_000, 1_000_000_000, 400) for _ in range(2000)]
    assert np.mean(draws) == pytest.approx(300, abs=1) and np.var(draws) == pytest.approx(75, rel=0.2)


@pytest.mark.parametrize("rows_per_task", [500_000, 40])
def test_shuffle_is_exact_uniform_and_gapless(spark, rows_per_task):
    df = spark.range(2003).repartition(7).withColumn("slot", F.lit("clash"))
    out = sharding.shuffle_into_shards(df, 8, rows_per_task=rows_per_task).collect()
    assert sorted(r["id"] for r in out) == list(range(2003))
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append((r["slot"], r["id"]))
    assert sorted(map(len, by.values())) == [250] * 5 + [251] * 3
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    slots = np.array([r["slot"] for r in sorted(out, key=lambda r: r["id"])], float)
    assert abs(np.corrcoef(np.arange(2003), slots)[0, 1]) < 0.08
    shards = np.array([r["shard"] for r in sorted(out, key=lambda r: r["id"])], float)
    assert abs(np.corrcoef(shards[1:], shards[:-1])[0, 1]) < 0.08


def test_sharding_query_and_awkward_rows(spark):
    import zlib

    from kinprofile.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_sharding"](spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), None, "rows")
    assert sharding.shuffle_into_shards(awkward(spark, shard="x"), 8).count() == 11
    assert sharding.shuffle_into_shards(empty(spark), 8).count() == 0
