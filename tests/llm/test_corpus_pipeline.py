"""The pipeline stage by stage against brute force, its checks in SQL, and the guard around the subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from fixtures import awkward, empty

import corpus_pipeline
from kinprofile.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(n) for n in names]
    want = sorted(repr(tuple(row[i] for i in at)) for row in cursor.fetchall())
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == names
    assert sorted(repr(tuple(r[n] for n in names)) for r in found.collect()) == want


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "personal_data", "pack"]


def test_stages_by_brute_force(spark):
    from test_similarity_operators import sets_of, smallest_reachable
    from test_text_operators import lines_by_hand, pii_by_pattern

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = stages["language"](spark, docs, SF).cache()
    assert known.schema == docs.schema
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in known.collect()} == letters

    cut = stages["lines"](spark, known, SF).cache()
    before = sorted(known.collect(), key=lambda r: r["doc_id"])
    after = sorted(cut.collect(), key=lambda r: r["doc_id"])
    want = [x[2] for x in lines_by_hand([r["text"] for r in before], 10)]
    assert [r["text"] for r in after] == want and [r["n_chars"] for r in after] == list(map(len, want))

    once = stages["near_copies"](spark, cut, SF).cache()
    own = {r["doc_id"]: sets_of(r["text"]) for r in after}
    links = [(a, b) for a in own for b in own if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])]
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(smallest_reachable(own, links).values()))

    clean = stages["personal_data"](spark, once, SF).cache()
    assert clean.count() == once.count() and clean.schema == once.schema
    text = {r["doc_id"]: r["text"] for r in once.collect()}
    for r in clean.collect():
        assert not pii_by_pattern(r["text"])
        if r["text"] != text[r["doc_id"]]:
            assert "[" in r["text"]
    pieces = stages["pack"](spark, clean, SF)
    assert {r["doc_id"] for r in pieces.collect()} == set(text)


def test_run_gives_the_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_awkward_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, awkward(spark, n_lines="a", ids="b", kept="c"), SF)
        assert rows.count() > 0, name
        if name != "pack":
            assert rows.columns == ["doc_id", "text", "lang", "n_lines", "ids", "kept"], name
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "kinprofile").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "kinprofile.llm" not in path.read_text()


def test_entry_works_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('kinprofile.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
