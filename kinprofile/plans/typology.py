"""Clustering driver: one vector table, any number of algorithms, all groups in one plan.

An algorithm is a callable ``(vectors, spec) -> Solution``.  The four built-in ones sweep their
parameter, score every solution, adopt one per group by their rule and profile it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprofile.operators import agglomerative, dbscan, hdbscan, kmeans
from kinprofile.operators.agreement import agreement
from kinprofile.operators.metrics import model_report
from kinprofile.operators.profile import cluster_profile
from kinprofile.operators.selection import pick_balanced_solution, pick_density_solution, pick_k
from kinprofile.operators.vectors import encode, vector_table
from kinprofile.session import materialise
from kinprofile.sources.store import ResultStore
from kinprofile.spec import FeatureSpec


@dataclass(frozen=True)
class Solution:
    """Sweep table, adopted parameter per group, and labels of the adopted partition."""

    metrics: DataFrame
    chosen: DataFrame
    members: DataFrame


Algorithm = Callable[[DataFrame, FeatureSpec], Solution]


def _adopt(members: DataFrame, chosen: DataFrame, keys: list[str], group: str) -> DataFrame:
    return materialise(
        members.join(chosen.select(*keys), keys).select(group, "vid", "label", "w"), "adopted"
    )


def run_kmeans(vectors: DataFrame, spec: FeatureSpec, ks=kmeans.K_RANGE, n_init: int = kmeans.N_INIT) -> Solution:
    members, report = kmeans.kmeans_sweep(vectors, spec, ks, n_init)
    report = materialise(report, "kmeans-report")
    chosen = materialise(pick_k(report, [spec.group]).withColumn("k", F.col("k_adopted")), "kmeans-chosen")
    return Solution(report, chosen, _adopt(members, chosen, [spec.group, "k"], spec.group))


def run_dbscan(vectors: DataFrame, spec: FeatureSpec, min_samples: int = dbscan.MIN_SAMPLES) -> Solution:
    keys = [spec.group, "eps"]
    members = materialise(dbscan.dbscan_sweep(vectors, spec, min_samples), "dbscan-members")
    report = materialise(model_report(members, vectors, spec, keys), "dbscan-report")
    chosen = materialise(pick_density_solution(report, [spec.group], "eps", middle=True), "dbscan-chosen")
    return Solution(report, chosen, _adopt(members, chosen, keys, spec.group))


def run_hdbscan(vectors: DataFrame, spec: FeatureSpec, epsilons=hdbscan.SELECTION_EPSILONS) -> Solution:
    keys = [spec.group, "eps"]
    members = materialise(hdbscan.hdbscan_sweep(vectors, spec, epsilons), "hdbscan-members")
    report = materialise(model_report(members, vectors, spec, keys), "hdbscan-report")
    chosen = materialise(pick_density_solution(report, [spec.group], "eps", middle=False), "hdbscan-chosen")
    return Solution(report, chosen, _adopt(members, chosen, keys, spec.group))


def run_agglomerative(
    vectors: DataFrame, spec: FeatureSpec, ks=agglomerative.K_RANGE, linkages=agglomerative.LINKAGES,
    history: DataFrame | None = None,
) -> Solution:
    """``history`` is the result of ``linkage_history``, if it is there already."""
    keys = [spec.group, "linkage", "k"]
    history = agglomerative.linkage_history(vectors, spec, linkages) if history is None else history
    members = materialise(agglomerative.flat_clusters(history, vectors, spec, ks, linkages), "linkage-labels")
    report = materialise(model_report(members, vectors, spec, keys), "linkage-report")
    chosen = materialise(pick_balanced_solution(report, [spec.group], linkages), "linkage-chosen")
    return Solution(report, chosen, _adopt(members, chosen, keys, spec.group))


ALGORITHMS: Mapping[str, Algorithm] = {
    "KMeans": run_kmeans,
    "DBSCAN": run_dbscan,
    "HDBSCAN": run_hdbscan,
    "Agglomerative": run_agglomerative,
}


def run_typology(
    df: DataFrame, spec: FeatureSpec, algorithms: Mapping[str, Algorithm] = ALGORITHMS, store: ResultStore | None = None,
    replicates: int = 20,
) -> dict[str, Solution]:
    """Cluster every group with every algorithm; results go to ``store`` when one is given.

    The K-Means solution is also resampled ``replicates`` times (0: not at all); its agreement with itself is the
    ``stability`` table.
    """
    vectors = vector_table(df, spec)
    out = {}
    for name, algorithm in algorithms.items():
        solution = algorithm(vectors, spec)
        out[name] = solution
        if store is not None:
            store.write("metrics", name, solution.metrics)
            store.write("chosen", name, solution.chosen)
            store.write("labels", name, solution.members)
            store.write("profile", name, cluster_profile(solution.members, vectors, spec, [spec.group]))
            if algorithm is run_kmeans and replicates:
                store.write("stability", name, stability(vectors, spec, solution, replicates))
    return out


def stability(vectors: DataFrame, spec: FeatureSpec, solution: Solution, replicates: int = 20) -> DataFrame:
    """Mean and spread of the agreement between the adopted K-Means partition and those of resampled rows."""
    chosen = solution.chosen.select(spec.group, "k")
    members = solution.members.join(chosen, spec.group)
    return kmeans.stability_summary(kmeans.bootstrap_stability(vectors, spec, members, chosen, replicates), spec.group)


def compare(solutions: Mapping[str, Solution], spec: FeatureSpec) -> DataFrame:
    """Agreement of the adopted partitions; every row of a vector carries the vector's label."""
    tables = [s.members.withColumn("algorithm", F.lit(name)) for name, s in solutions.items()]
    labels = tables[0]
    for t in tables[1:]:
        labels = labels.unionByName(t)
    return agreement(labels, spec.group, "vid", list(solutions))


def row_labels(df: DataFrame, spec: FeatureSpec, solution: Solution) -> DataFrame:
    """Label of every row: (group, row id, label), joined on the computed vector id.

    A vector may hold a third of all rows.  The label table is written, so Catalyst sends it to the rows while its
    measured size allows; beyond that the join is shuffled and adaptive execution splits a vector's rows.
    """
    labels = materialise(solution.members.select(spec.group, "vid", "label"), "row-labels")
    return encode(df, spec).select(spec.group, spec.row_id, "vid").join(labels, [spec.group, "vid"]).drop("vid")
