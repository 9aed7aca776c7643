import numpy as np
import pandas as pd
import pytest
from helpers import (
    SPEC, brute_ari, brute_dbscan, brute_hdbscan, components, distances, planted_rows, points, random_rows,
)
from pyspark.sql import functions as F

from kinprofile.operators import agglomerative, dbscan, hdbscan, kmeans, metrics, resampling, tendency
from kinprofile.operators.neighbours import extreme_distance, neighbour_counts, spread_labels
from kinprofile.operators.projection import principal_axes, projection_2d
from kinprofile.operators.quantiles import grouped_quantiles
from kinprofile.operators.sampling import sample_positions, sample_rows
from kinprofile.operators.vectors import distinct_vectors, vector_table
from kinprofile.plans import typology
from kinprofile.session import materialise
from kinprofile.spec import FeatureSpec, Nominal, Ordinal


@pytest.fixture(scope="module")
def vectors(spark):
    return vector_table(random_rows(spark), SPEC)


@pytest.fixture(scope="module")
def collected(vectors):
    return vectors.toPandas().sort_values(["g", "vid"]).reset_index(drop=True)


def _group(collected, g):
    part = collected[collected["g"] == g].reset_index(drop=True)
    return part, distances(points(part)), part["w"].to_numpy()


def test_vectors_keep_every_row(spark, collected):
    assert collected["w"].sum() == 400
    assert (collected["o_scale"] == 4).all()


def test_specification_bound():
    """Vectors are counted, not refused by their declared levels; only ids beyond 64 bits are."""
    features = tuple(Nominal(f"n{i}", tuple("abcdefghij")) for i in range(20))
    assert FeatureSpec("g", "id", features[:8]).max_vectors == 11**8
    with pytest.raises(ValueError):
        FeatureSpec("g", "id", features)


def test_neighbour_counts_match_pairs(vectors, collected):
    found = neighbour_counts(vectors, SPEC).toPandas()
    for g in ("u", "v"):
        part, d, w = _group(collected, g)
        mine = found[found["g"] == g]
        for i in range(0, len(part), 7):
            got = mine[mine["vid"] == part["vid"][i]].sort_values("dist")
            values = np.unique(np.round(d[i], 9))
            assert np.allclose(got["dist"], values)
            assert list(got["cnt"]) == [w[np.abs(d[i] - v) < 1e-8].sum() for v in values]


@pytest.mark.parametrize("farthest", [True, False])
def test_extreme_distance(vectors, collected, farthest):
    members = vectors.filter("vid % 3 = 0")
    found = extreme_distance(members, vectors, SPEC, ["g"], ["vid"], farthest).toPandas().set_index(["g", "vid"])["sq"]
    for g in ("u", "v"):
        part, d, _ = _group(collected, g)
        inside = (part["vid"] % 3 == 0).to_numpy()
        want = (d[:, inside].max(1) if farthest else d[:, inside].min(1)) ** 2
        assert np.allclose([found[(g, v)] for v in part["vid"]], want)


def test_dbscan_matches_row_scan(spark, vectors, collected):
    counts = materialise(neighbour_counts(vectors, SPEC), "t")
    radii = [0.25, 0.75, 1.0, 1.0308, 1.4143, 1.75]
    table = spark.createDataFrame([(g, e) for g in ("u", "v") for e in radii], "g string, eps double")
    for least in (4, 25):
        found = dbscan.dbscan(vectors, counts, table, SPEC, least).toPandas()
        for g in ("u", "v"):
            part, d, w = _group(collected, g)
            for eps in radii:
                mine = found[(found["g"] == g) & (found["eps"] == eps)].set_index("vid")["label"]
                want = brute_dbscan(d, w, part["first_row"].to_numpy(), eps, least)
                assert list(mine.reindex(part["vid"])) == list(want), (g, eps, least)


def test_hdbscan_matches_top_down_tree(spark):
    rows = random_rows(spark, 1600, seed=11)
    vectors = vector_table(rows, SPEC)
    collected = vectors.toPandas().sort_values(["g", "vid"]).reset_index(drop=True)
    epsilons = (0.0, 0.3, 0.8, 1.05, 1.5)
    found = hdbscan.hdbscan_sweep(vectors, SPEC, epsilons).toPandas()
    several = 0
    for g in ("u", "v"):
        part, d, w = _group(collected, g)
        want = brute_hdbscan(d, w, part["first_row"].to_numpy(), 20, epsilons)
        for eps in epsilons:
            mine = found[(found["g"] == g) & (found["eps"] == eps)].set_index("vid")["label"].reindex(part["vid"])
            assert list(mine) == list(want[eps]), (g, eps)
            several += len(set(want[eps])) > 2
    assert several


def _greedy(d, w, linkage):
    d, w = d.copy(), w.astype(float).copy()
    if linkage == "ward":
        d = d * np.sqrt(2 * w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(d, np.inf)
    heights = []
    for _ in range(len(w) - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        h = d[i, j]
        heights.append(h)
        if linkage == "average":
            new = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        else:
            gone = ~(np.isfinite(d[i]) & np.isfinite(d[j]))
            a, b = np.where(gone, 0, d[i]), np.where(gone, 0, d[j])
            new = np.sqrt(np.maximum(((w[i] + w) * a**2 + (w[j] + w) * b**2 - w * h * h) / (w[i] + w[j] + w), 0))
            new[gone] = np.inf
        w[i] += w[j]
        d[i] = new
        d[:, i] = new
        d[j] = np.inf
        d[:, j] = np.inf
        d[i, i] = np.inf
    return sorted(heights)


def test_linkage_heights_match_greedy(spark):
    # price-like steps and unequal weights leave few equal distances
    vectors = vector_table(random_rows(spark, 500, groups=("u",), seed=5), SPEC)
    part, d, w = _group(vectors.toPandas(), "u")
    history = agglomerative.linkage_history(vectors, SPEC)
    merges = agglomerative.merge_table(history, SPEC).toPandas()
    for linkage in ("ward", "average"):
        mine = merges[merges["linkage"] == linkage].sort_values("height")
        assert np.allclose(mine["height"], _greedy(d, w, linkage), atol=0.2)
        assert len(mine) == len(part) - 1
    # whatever the order of ties, every merge has the height its linkage defines
    place, x = {v: i for i, v in enumerate(part["vid"])}, points(part)
    steps = history.toPandas()
    for linkage in ("ward", "average", "complete"):
        sets = {v: [place[v]] for v in part["vid"]}
        for (_, cluster), step in steps[steps["linkage"] == linkage].groupby(["round", "cluster"]):
            a, b = (sets.pop(v) for v in sorted(step["before"].unique()))
            wa, wb = w[a].sum(), w[b].sum()
            if linkage == "ward":
                gap = (w[a] @ x[a]) / wa - (w[b] @ x[b]) / wb
                want = np.sqrt(2 * wa * wb / (wa + wb) * (gap @ gap))
            elif linkage == "average":
                want = (w[a] @ d[np.ix_(a, b)] @ w[b]) / (wa * wb)
            else:
                want = d[np.ix_(a, b)].max()
            assert step["height"].iloc[0] == pytest.approx(want, abs=1e-8)
            sets[cluster] = a + b
        assert len(sets) == 1
    assert (merges.groupby("linkage")["rows"].max() == 500).all()
    labels = agglomerative.flat_clusters(history, vectors, SPEC, (2, 5)).toPandas()
    counts = labels.groupby(["linkage", "k"])["label"].nunique()
    assert (counts <= counts.index.get_level_values("k")).all()


TIE_FREE = FeatureSpec("g", "id", (), tuple(Ordinal(f"o{i}", tuple((str(v), v) for v in range(1, 400)), 0) for i in range(3)))


@pytest.mark.parametrize("block", [2048, 12])  # 12: over tiles, with clusters that are spread over several blocks
def test_linkage_heights_equal_greedy_without_ties(spark, monkeypatch, block):
    monkeypatch.setattr(agglomerative, "BLOCK", block)
    rng = np.random.default_rng(8)
    values = rng.integers(1, 400, (40, 3)).tolist()
    rows = [("u", i, *map(str, v)) for i, v in enumerate(values + values[:15])]
    vectors = vector_table(spark.createDataFrame(rows, "g string, id bigint, o0 string, o1 string, o2 string"), TIE_FREE)
    part = vectors.toPandas().sort_values("vid").reset_index(drop=True)
    x, w = part[[o.scaled for o in TIE_FREE.ordinals]].to_numpy(), part["w"].to_numpy()
    merges = agglomerative.merge_table(agglomerative.linkage_history(vectors, TIE_FREE), TIE_FREE).toPandas()
    for linkage in agglomerative.LINKAGES:
        mine = np.sort(merges[merges["linkage"] == linkage]["height"])
        assert np.allclose(mine, _greedy(distances(x), w, linkage), rtol=0, atol=2e-9)


def test_complete_linkage_bounds_diameter(spark):
    vectors = vector_table(random_rows(spark, 300, groups=("u",), seed=8), SPEC)
    part, d, _ = _group(vectors.toPandas(), "u")
    place = {v: i for i, v in enumerate(part["vid"])}
    history = agglomerative.linkage_history(vectors, SPEC, ("complete",)).toPandas()
    for (_, cluster), step in history.groupby(["round", "cluster"]):
        inside = [place[v] for v in step["vid"]]
        assert d[np.ix_(inside, inside)].max() == pytest.approx(step["height"].iloc[0], abs=1e-8)


def test_metrics_match_pairs(spark, vectors, collected):
    members = vectors.select("g", "vid", F.pmod(F.col("vid"), F.lit(4)).cast("int").alias("label"), "w").withColumn(
        "label", F.col("label") - 1
    )
    found = metrics.cluster_quality(members, vectors, SPEC, ["g"], digits=9).toPandas().set_index("g")
    for g in ("u", "v"):
        part, _, w = _group(collected, g)
        label = (part["vid"] % 4 - 1).to_numpy()
        rows = np.repeat(np.arange(len(part)), w)
        rows = rows[label[rows] >= 0]
        x, y = points(part)[rows], label[rows]
        apart = (x[:, None] != x[None]).sum(2)
        size = np.bincount(y)
        total = np.stack([apart[:, y == c].sum(1) for c in range(3)], 1)
        a = total[np.arange(len(y)), y] / (size[y] - 1)
        mean = total / size
        mean[np.arange(len(y)), y] = np.inf
        b = mean.min(1)
        assert found.loc[g, "silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=1e-8)
        centres = np.stack([x[y == c].mean(0) for c in range(3)])
        spread = np.array([np.linalg.norm(x[y == c] - centres[c], axis=1).mean() for c in range(3)])
        gap = distances(centres)
        np.fill_diagonal(gap, np.inf)
        assert found.loc[g, "davies_bouldin"] == pytest.approx(((spread[:, None] + spread) / gap).max(1).mean(), abs=1e-8)
        widest = max(distances(x[y == c]).max() for c in range(3))
        assert found.loc[g, "dunn"] == pytest.approx(gap.min() / widest, abs=1e-8)


@pytest.mark.parametrize("label", ["-1", "0", "CASE WHEN vid % 50 = 0 THEN 0 WHEN vid % 51 = 0 THEN 1 ELSE -1 END"])
def test_metrics_are_null_without_two_clusters_or_twenty_rows(vectors, label):
    members = vectors.filter("g = 'u'").select("g", "vid", F.expr(label).cast("int").alias("label"), F.lit(1).alias("w"))
    row = metrics.cluster_quality(members, vectors, SPEC, ["g"]).first()
    assert row["silhouette"] is None and row["davies_bouldin"] is None and row["dunn"] is None


def test_weighted_kmeans_equals_duplicated_rows(spark, vectors):
    members, curve = kmeans.kmeans(vectors, SPEC, (2, 3, 4), 3)
    pdf = members.join(vectors, ["g", "vid"]).select("g", "k", "vid", "label", vectors["w"], *SPEC.code_columns, "o_scaled").toPandas()
    wcss = {(r["g"], r["k"]): r["wcss"] for r in curve.collect()}
    for (g, k), part in pdf.groupby(["g", "k"]):
        x, w = points(part.reset_index()), part["w"].to_numpy()
        x = np.repeat(x, w, axis=0)
        y = np.repeat(part["label"].to_numpy(), w)
        centres = np.stack([x[y == c].mean(0) for c in range(k)])
        assert wcss[(g, k)] == pytest.approx(((x - centres[y]) ** 2).sum(), rel=1e-3)
        nearest = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert (nearest == y).mean() > 0.98
    assert all(wcss[(g, 4)] < wcss[(g, 2)] for g in ("u", "v"))


def test_ari_matches_pairs(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    df = spark.createDataFrame(pd.DataFrame({"g": "u", "a": a, "b": b}))

    def ari(left, right):
        cells = df.groupBy("g", F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("cnt"))
        return metrics.adjusted_rand(cells, ["g"], "l", "r").first()["ari"]

    assert ari("a", "b") == pytest.approx(brute_ari(a, b))
    assert ari("a", "b") == pytest.approx(ari("b", "a"))
    assert ari("a", "a") == 1.0


def test_kmeans_of_blocks_equals_whole_units(spark, vectors, collected, monkeypatch):
    """Every model is at rest, has the error of its members, and does not depend on how its unit is cut."""
    fitted = {}
    for block in (8192, 12):
        monkeypatch.setattr(kmeans, "BLOCK", block)
        rows = kmeans.fit(vectors, SPEC, ["g"], (2, 5), 3).collect()
        fitted[block] = {(r["g"], r["k"], r["start"]): r for r in rows}
    assert fitted[8192].keys() == fitted[12].keys() and len(fitted[12]) == 2 * 2 * 3
    for key, r in fitted[8192].items():
        part, _, w = _group(collected, key[0])
        x, centres = points(part), np.array(r["centres"])
        sq = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert r["settled"] and r["wcss"] == pytest.approx((w * sq.min(1)).sum())
        label = sq.argmin(1)
        for c in range(len(centres)):
            if (label == c).any():
                assert np.allclose(centres[c], np.average(x[label == c], axis=0, weights=w[label == c]), atol=5e-3)
        other = fitted[12][key]
        assert other["settled"] and other["wcss"] == pytest.approx(r["wcss"])
        assert np.allclose(other["centres"], r["centres"])


def test_kmeans_reports_models_that_did_not_rest(spark, vectors, monkeypatch):
    for block in (8192, 12):
        monkeypatch.setattr(kmeans, "BLOCK", block)
        rows = kmeans.fit(vectors, SPEC, ["g"], (4,), 3, max_iter=1).collect()
        assert len(rows) == 6 and not all(r["settled"] for r in rows)


def test_kmeans_seeds_follow_weight_and_distance():
    x, w, vid = np.array([[0.0], [1.0], [1.0], [3.0]]), np.array([1.0, 1.0, 0.0, 2.0]), np.arange(4)
    second = {0: [], 1: [], 3: []}
    for start in range(4000):
        seeds = kmeans._seeds(x, w, vid, 4, start, 42)[:, 0].tolist()
        assert sorted(seeds) == [0.0, 1.0, 3.0]  # nothing is left to draw after three different points
        second[int(seeds[0])].append(seeds[1])
    assert len(second[3]) / 4000 == pytest.approx(0.5, abs=0.04)
    assert np.mean([v == 3.0 for v in second[0]]) == pytest.approx(2 * 9 / (2 * 9 + 1), abs=0.03)


def test_bootstrap_has_the_size_of_the_group_however_it_is_cut(spark, vectors, collected, monkeypatch):
    drawn = {}
    for block in (8192, 4):
        monkeypatch.setattr(resampling, "BLOCK", block)
        rows = resampling.bootstrap_weights(vectors, "g", 60).collect()
        drawn[block] = {(r["g"], r["replicate"], r["vid"]): r["w"] for r in rows}
    assert drawn[8192] == drawn[4] and all(n > 0 for n in drawn[4].values())
    for g in ("u", "v"):
        part, _, w = _group(collected, g)
        counts = np.array([[drawn[4].get((g, r, v), 0) for v in part["vid"]] for r in range(1, 61)])
        assert (counts.sum(1) == w.sum()).all()
        # mean w and variance w (1 - w / n) of a multinomial count
        z = (counts.mean(0) - w) / np.sqrt(w * (1 - w / w.sum()) / 60)
        assert np.abs(z).max() < 4.5 and 0.3 < (z * z).mean() < 1.9
        spread = counts.var(0, ddof=1) / (w * (1 - w / w.sum()))
        assert spread.mean() == pytest.approx(1, abs=0.15)


def test_draws_and_starts_stay_in_tasks_of_their_own(spark, vectors):
    drawn = resampling.bootstrap_weights(vectors, "g", 20)
    assert drawn.select(F.spark_partition_id()).distinct().count() > 3
    fitted = kmeans.fit(vectors, SPEC, ["g"], ks=(2, 3), n_init=8)
    assert fitted.select(F.spark_partition_id()).distinct().count() > 3


def test_binomial_of_many_rows_is_exact():
    for n, p in ((10**8, 0.37), (10**9, 0.002)):
        drawn = resampling.binomial(n, p, 0.25)
        assert (drawn - n * p) / (n * p * (1 - p)) ** 0.5 == pytest.approx(-0.67449, abs=2e-3)  # the lower quartile


def test_binomial_inverts_its_distribution():
    for n, p in ((1, 0.3), (10, 0.5), (400, 0.02), (5000, 0.9)):
        draws = [resampling.binomial(n, p, (i + 0.5) / 2000) for i in range(2000)]
        assert draws == sorted(draws) and min(draws) >= 0 and max(draws) <= n
        assert np.mean(draws) == pytest.approx(n * p, rel=0.01) and np.var(draws) == pytest.approx(n * p * (1 - p), rel=0.02)
    assert resampling.binomial(7, 0.0, 0.5) == 0 and resampling.binomial(7, 1.0, 0.5) == 7


def test_planted_profiles_are_recovered_by_all_algorithms(spark):
    rows = planted_rows(spark)
    algorithms = {
        "KMeans": lambda v, s: typology.run_kmeans(v, s, ks=(3, 4), n_init=4),
        "DBSCAN": typology.run_dbscan,
        "HDBSCAN": lambda v, s: typology.run_hdbscan(v, s, (0.0, 0.5)),
        "Agglomerative": lambda v, s: typology.run_agglomerative(v, s, (3, 4), ("ward", "average")),
    }
    solutions = typology.run_typology(rows, SPEC, algorithms)
    for name, solution in solutions.items():
        labels = typology.row_labels(rows, SPEC, solution).join(rows.select("id", "truth"), "id").toPandas()
        assert len(labels) == 3 * 130
        for _, part in labels.groupby("g"):
            assert brute_ari(part["label"], part["truth"]) == pytest.approx(1.0), name
    table = typology.compare(solutions, SPEC).toPandas()
    assert len(table) == 18 and (table["ari"] == 1.0).all() and (table["n_points"] == 130).all() and table["aligned"].all()


def test_quantiles_with_forced_narrowing(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(np.arange(6000) % 3 == 0, "hot", "cold"), "x": rng.lognormal(0, 3, 6000)})
    pdf.loc[:800, "x"] = 0.5
    df = spark.createDataFrame(pdf)
    probs = (0.0, 0.005, 0.5, 0.9, 1.0)
    found = grouped_quantiles(df, ["g"], "x", probs, window_rows=50).toPandas()
    for g, part in pdf.groupby("g"):
        mine = found[found["g"] == g].sort_values("prob")["value"]
        assert np.allclose(mine, np.quantile(part["x"], probs), rtol=1e-12)


def test_sample_has_exact_size(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4900, "hot").otherwise("small"))
    sizes = dict(sample_rows(df, "g", "id", 120).groupBy("g").count().collect())
    assert sizes == {"hot": 120, "small": 100}


def test_constant_group_scales_to_zero(spark):
    df = spark.createDataFrame([("u", i, "x", "p", "o0") for i in range(5)], "g string, id bigint, a string, b string, o string")
    row = distinct_vectors(df, SPEC).first()
    assert row["w"] == 5 and row["o_scaled"] == 0.0 and row["o_scale"] == 1.0


def test_group_with_a_single_vector(spark):
    df = spark.createDataFrame([("u", i, "x", "p", "o1") for i in range(30)], "g string, id bigint, a string, b string, o string")
    vectors = vector_table(df, SPEC)
    history = agglomerative.linkage_history(vectors, SPEC, ("average",))
    labels = agglomerative.flat_clusters(history, vectors, SPEC, (2,), ("average",))
    assert [(r["label"], r["w"]) for r in labels.collect()] == [(0, 30)]
    # every distance is 0: the one radius left to try is 1, and all rows are one cluster
    assert [(r["eps"], r["label"]) for r in dbscan.dbscan_sweep(vectors, SPEC).collect()] == [(1.0, 0)]
    # one cluster that never splits is no partition: the rows stay noise
    assert [r["label"] for r in hdbscan.hdbscan_sweep(vectors, SPEC, (0.0,)).collect()] == [-1]
    members, _ = kmeans.kmeans(vectors, SPEC, (2,), 1)
    assert [(r["label"], r["w"]) for r in members.collect()] == [(0, 30)]


def test_dbscan_keeps_its_groups_when_rows_repeat(spark):
    rows = random_rows(spark, 60, groups=("u", "w"), seed=3)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("id", F.col("id") * 100 + F.col("copy")).drop("copy")
    labels = dbscan.dbscan_sweep(vector_table(many, SPEC), SPEC)
    found = labels.groupBy("g").agg(F.countDistinct("eps").alias("radii"), F.sum("w").alias("w"), F.max("label").alias("top")).collect()
    assert len(found) == 2 and all(r["radii"] >= 1 and r["top"] >= 0 and r["w"] == r["radii"] * many.count() / 2 for r in found)


def test_components_of_a_long_chain_settle(spark):
    """5,000 steps of an ordinal, each within reach of the next only: labels take shortcuts instead of 5,000 passes."""
    steps = tuple((f"s{i}", i) for i in range(5001))
    spec = FeatureSpec("g", "id", (Nominal("a", ("x", "y")),), (Ordinal("o", steps),))
    df = spark.range(5001).select(F.lit("u").alias("g"), "id", F.lit("x").alias("a"), F.concat(F.lit("s"), "id").alias("o"))
    links = spark.range(5000).select(
        F.lit("u").alias("g"), F.explode(F.array("id", F.col("id") + 1)).alias("vid"), F.col("id").alias("block")
    )
    cores = spark.range(5001).select(F.lit("u").alias("g"), F.col("id").alias("vid"), F.concat(F.lit("row"), F.format_string("%05d", "id")).alias("label"))
    assert {r["label"] for r in spread_labels(cores, links, ["g"]).collect()} == {"row00000"}
    assert vector_table(df, spec).count() == 5001


def test_positions_are_distinct_and_exact(spark):
    sizes = spark.createDataFrame([("a", 10, 10), ("b", 1000, 150), ("c", 10**12, 150), ("d", 160, 150)], "g string, n long, m long")
    found = sample_positions(sizes, ["g"]).toPandas()
    for g, part in found.groupby("g"):
        n, m = sizes.where(F.col("g") == g).first()[1:]
        assert len(part) == m == part["position"].nunique() and part["position"].between(1, n).all()


def test_sampled_vectors_follow_the_weights(spark):
    vectors = spark.createDataFrame([("u", v, w) for v, w in ((0, 5), (3, 1), (700, 994), (1000, 10))], "g string, vid long, w long")
    positions = spark.createDataFrame([("u", 0, p) for p in (1, 5, 6, 7, 1000, 1001, 1010)], "g string, run int, position long")
    found = {r["vid"]: r["taken"] for r in tendency._sampled_vectors(vectors, positions, "g").collect()}
    assert found == {0: 2, 3: 1, 700: 2, 1000: 2}


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([("u", 0.0), ("u", 1.0)], "g string, h double")
    assert sorted((r["bin"], r["cnt"]) for r in tendency.histogram(df, "g", "h").collect()) == [(1, 1)] + [(b, 0) for b in range(2, 8)] + [(8, 1)]


def test_models_of_thousands_of_clusters_meet_in_tiles(spark, monkeypatch):
    rows = random_rows(spark, 900, groups=("u",), seed=11)
    vectors = vector_table(rows, SPEC)
    members = vectors.select("g", "vid", F.monotonically_increasing_id().alias("i"), "w").withColumn("label", (F.col("i") % 97).cast("int")).drop("i")
    members = materialise(members, "many")
    coded = metrics.coded_members(members, vectors, SPEC, ["g"])
    counts = metrics.cluster_counts(coded, SPEC, ["g"])
    found = []
    for size in (1000, 5):
        monkeypatch.setattr(metrics, "TILE", size)
        bouldin = metrics.davies_bouldin_and_gap(coded, counts, SPEC, ["g"]).first()
        found.append([metrics.silhouette(coded, counts, SPEC, ["g"]).first()["silhouette"], bouldin["davies_bouldin"], bouldin["min_gap"]])
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_components_helper_is_consistent():
    near = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], bool)
    assert list(components(near, np.ones(3, bool))) == [0, 0, 1]


def test_projection_has_the_components_of_each_group(spark):
    rng = np.random.default_rng(4)
    mix = {g: rng.normal(size=(5, 5)) for g in "ab"}
    rows = [(g, f"{g}{i}", (rng.normal(size=5) @ mix[g] + 3).tolist(), i % 3) for g in "ab" for i in range(200)]
    odd = [("a", "null", None, 0), ("a", "nan", [float("nan")] * 5, 0), ("a", "hole", [1.0, None, 1.0, 1.0, 1.0], 0), ("a", "empty", [], 0)]
    odd += [("b", f"short{i}", [float(i)], 0) for i in range(3)] + [(None, "n1", [1.0, 2.0], 0), (None, "n2", [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "g string, id string, v array<double>, k int").repartition(7)
    found = {r["id"]: (r["x"], r["y"]) for r in projection_2d(df.where("g is not null"), "g", "id", "v", "k", "k", 10_000).collect()}
    assert all(found[i] == (None, None) for i in ("null", "nan", "hole", "empty"))
    for g in "ab":
        own = np.array([v for name, _, v, _ in rows if name == g])
        ids = [i for name, i, _, _ in rows if name == g]
        centred = own - own.mean(0)
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        for at in range(2):
            points_ = np.array([found[i][at] for i in ids])
            truth = centred @ axes[at]
            assert min(np.abs(points_ - truth).max(), np.abs(points_ + truth).max()) < 1e-9
    assert [found[f"short{i}"] for i in range(3)] == [(-1.0, None), (0.0, None), (1.0, None)]
    axes = {(r["group"], r["d"]): r for r in principal_axes(df, "g", "v").collect()}
    assert set(axes) == {("a", 5), ("b", 5), ("b", 1), (None, 2)} and axes[None, 2]["n"] == 2
    assert axes["a", 5]["total"] == pytest.approx(np.array([v for g, _, v, _ in rows if g == "a"]).var(0).sum())
    assert projection_2d(df.limit(0), "g", "id", "v", "k", "k").count() == 0
