"""The study: every year that has a file, columns without values, clusters of all states."""

import numpy as np
from conftest import TESTDATA
from helpers import brute_ari
from pyspark.sql import functions as F

from kinprofile.functions import mortality
from kinprofile.operators import describe
from kinprofile.plans import mortality as study
from kinprofile.plans import queries, typology
from kinprofile.sources import dbf


def test_study_reads_all_years(spark):
    want = mortality.homicides(queries.death_records(spark, TESTDATA)).groupBy("ANO").count()
    kept = queries._study(spark, TESTDATA)[1]
    found = kept.groupBy("ANO").count()
    assert len(want.collect()) == 7
    assert sorted((str(r["ANO"]), r["count"]) for r in found.collect()) == sorted((str(r["ANO"]), r["count"]) for r in want.collect())
    assert kept.select(dbf.RECORD).distinct().count() == kept.count()


def test_row_labels_cover_all_homicides(spark):
    homicides = mortality.homicides(queries.death_records(spark, TESTDATA)).count()
    assert queries.study_row_labels(spark, TESTDATA).count() == homicides


def test_columns_without_values_are_flagged_and_stay_null(spark):
    rows = [("u", 1.0, None), ("u", None, None), ("v", 2.0, 5.0), ("v", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    found = {(r["g"], r["variable"]): (r["n_valid"], r["usable"]) for r in describe.usable_columns(df, "g", ["a", "b"]).collect()}
    assert found == {("u", "a"): (1, True), ("u", "b"): (0, False), ("v", "a"): (1, True), ("v", "b"): (1, True)}
    filled = describe.standardise(describe.impute(df, "g", ["a"], ["b"]), "g", ["a", "b"]).collect()
    assert all((r["b"] is None) == (r["b_z"] is None) == (r["g"] == "u") and r["a"] is not None for r in filled)
    assert describe.usable_columns(df.limit(0), "g", ["a"]).count() == 0


def test_study_clusters_every_state_and_compares_the_partitions(spark):
    kept = mortality.homicides(queries.death_records(spark, TESTDATA))
    chosen = {
        "KMeans": lambda v, s: typology.run_kmeans(v, s, range(2, 4), 2),
        "Fixed": lambda v, s: typology.run_kmeans(v, s, range(4, 6), 1),
    }
    solutions, agreed = study.cluster(kept, "row_id", algorithms=chosen)
    rows = {r["ESTADO"]: r for r in agreed.collect()}
    states = {r["ESTADO"] for r in kept.select("ESTADO").distinct().collect()}
    assert set(rows) == states
    wide = solutions["KMeans"].members.select("ESTADO", "vid", "w", F.col("label").alias("k")).join(
        solutions["Fixed"].members.select("ESTADO", "vid", F.col("label").alias("d")), ["ESTADO", "vid"]
    ).toPandas()
    assert wide["w"].sum() == kept.count()
    for state, part in wide.groupby("ESTADO"):
        both = part[(part["k"] >= 0) & (part["d"] >= 0)]
        assert rows[state]["n_points"] == both["w"].sum() and rows[state]["aligned"]
        if rows[state]["ari"] is not None:
            k, d = (np.repeat(both[c].to_numpy(), both["w"].to_numpy()) for c in "kd")
            assert abs(rows[state]["ari"] - brute_ari(k, d)) < 1e-9


def test_distributions_count_the_imputed_rows_once(spark, monkeypatch):
    kept = mortality.homicides(queries.death_records(spark, TESTDATA))
    counted, count = [], describe.value_counts
    monkeypatch.setattr(describe, "value_counts", lambda *args: counted.append(args[1:]) or count(*args))
    shared = study.distributions(kept)
    assert len(counted) == 2  # once for the fill values, once for curves and summary
    filled = describe.impute(mortality.describe_numeric(kept), study.GROUP, study.CONTINUOUS, study.CATEGORICAL)
    alone = {
        "density": describe.density_curves(filled, study.GROUP, study.CONTINUOUS),
        "summary": describe.group_summary(filled, study.GROUP, study.CONTINUOUS, study.CATEGORICAL, mortality.DISPLAY_LABELS),
    }
    for name, table in alone.items():
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]
        assert sorted(map(str, shared[name].select(rounded).collect())) == sorted(map(str, table.select(rounded).collect()))
