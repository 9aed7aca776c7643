import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinprofile.plans.dbf_files import write_dbf
from kinprofile.sources import dbf, tables
from kinprofile.sources.features import stored_vectors
from kinprofile.sources.store import ResultStore
from kinprofile.spec import FeatureSpec, Nominal


def _write(path, fields, rows, deleted=()):
    width, offset = 1 + sum(s for _, s in fields), 32 + 32 * len(fields) + 1
    body = [struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), offset, width)]
    body += [struct.pack("<11sc4xBB14x", n.encode(), b"C", s, 0) for n, s in fields] + [b"\r"]
    for i, row in enumerate(rows):
        body.append((b"*" if i in deleted else b" ") + b"".join(v.encode("latin-1").ljust(s) for v, (_, s) in zip(row, fields)))
    path.write_bytes(b"".join(body) + b"\x1a")


def test_dbf_union_ranges_and_file_columns(spark, tmp_path):
    _write(tmp_path / "DOAC2019.dbf", [("SEXO", 1), ("IDADE", 4)], [(str(i % 3), f"4{i:02d}") for i in range(50)], deleted={7})
    _write(tmp_path / "DOAM2020.dbf", [("IDADE", 3), ("OCUP", 9)], [("425", "pedágio"), ("430", "")])
    dbf.register(spark)
    whole = spark.read.format("dbf").option("rangeBytes", 40).load(str(tmp_path))
    assert whole.columns == ["SEXO", "IDADE", "OCUP", "ESTADO", "ANO"]
    assert whole.rdd.getNumPartitions() > 5
    rows = whole.collect()
    assert len(rows) == 51
    last = [r for r in rows if r["ESTADO"] == "AM"]
    assert [(r["SEXO"], r["IDADE"], r["OCUP"], r["ANO"]) for r in last] == [(None, "425", "pedágio", "2020"), (None, "430", "", "2020")]
    picked = spark.read.format("dbf").option("suffixes", "AC2019").load(str(tmp_path))
    assert picked.count() == 49 and picked.columns == ["SEXO", "IDADE", "ESTADO", "ANO"]


def test_small_dbf_files_share_tasks(spark, tmp_path):
    want = {}
    for f in range(120):
        state, year = ("AC", "AM", "PA")[f % 3], 2000 + f // 3
        name, fields = f"DO{state}{year}.dbf", [("SEXO", 1), ("CIDADE", 6)] if f % 4 else [("CIDADE", 8)]
        city = ("Belém", "Acará", "Juruti", "", "a\0b")[f % 5]
        _write(tmp_path / name, fields, [(str(i), city)[-len(fields):] for i in range(f % 7)], deleted={2})
        for i in set(range(f % 7)) - {2}:
            want[f"{name}#{i}"] = (str(i) if f % 4 else None, city.split("\0")[0], state, str(year))
    dbf.register(spark)
    df = spark.read.format("dbf").option("recordId", "true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    got = df.collect()
    assert len(got) == len(want)
    assert {r[dbf.RECORD]: (r["SEXO"], r["CIDADE"], r["ESTADO"], r["ANO"]) for r in got} == want
    cut = spark.read.format("dbf").options(recordId="true", rangeBytes=24).load(str(tmp_path))
    assert cut.rdd.getNumPartitions() > 120 and sorted(map(str, cut.collect())) == sorted(map(str, got))


def test_written_dbf_files_hold_the_rows(spark, tmp_path):
    rows = [("AC", "2001", "1", "Belém"), ("AC", "2001", None, "much too long"), ("AM", "2001", "3", None), (None, "2001", "4", "x"), ("AM", None, "5", "y")]
    df = spark.createDataFrame(rows, "uf string, year string, N string, CIDADE string").coalesce(1)
    assert write_dbf(df, str(tmp_path / "out"), {"N": 2, "CIDADE": 6}) == 3
    dbf.register(spark)
    got = spark.read.format("dbf").load(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == [("", "much t", "AC", "2001"), ("1", "Belém", "AC", "2001"), ("3", "", "AM", "2001")]
    assert sorted(p.name for p in (tmp_path / "out").glob("*.dbf")) == ["DOAC2001-0-0.dbf", "DOAM2001-0-0.dbf"]
    assert write_dbf(df.limit(0), str(tmp_path / "none"), {"N": 2}) == 0


def test_written_dbf_files_follow_the_bytes_not_the_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    rows = [(("AC", "AM", None)[i % 3], str(2001 + i % 2), str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "uf string, year string, N string").coalesce(1)
    try:
        assert write_dbf(df, str(tmp_path / "few"), {"N": 3}) == 200
        assert write_dbf(df, str(tmp_path / "more"), {"N": 3}, held_bytes=400) == 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    dbf.register(spark)
    want = sorted((n, uf, year) for uf, year, n in rows if uf)
    assert len(list((tmp_path / "few").glob("*.dbf"))) == 4 < len(list((tmp_path / "more").glob("*.dbf"))) < 20
    for folder in ("few", "more"):
        assert sorted(map(tuple, spark.read.format("dbf").load(str(tmp_path / folder)).collect())) == want
    few = spark.read.format("dbf").option("suffixes", "AC2001").load(str(tmp_path / "few"))
    assert [int(r["N"]) for r in few.coalesce(1).collect()] == list(range(0, 300, 6))  # in the order of the rows


def test_coverage_gap(spark):
    found = spark.createDataFrame([("AC", "2013"), ("AM", "2014")], "ESTADO string, ANO string")
    gap = tables.coverage_gap(found, {"ESTADO": ["AC", "AM"], "ANO": ["2013", "2014"]})
    assert sorted(map(tuple, gap.collect())) == [("AC", "2014"), ("AM", "2013")]


def test_delimited_dialect(spark, tmp_path):
    df = spark.createDataFrame([("a;b \\ c", 'say "x"', None)], "p string, q string, r string")
    tables.write_delimited(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text.splitlines()[0] == '"p";"q";"r"'
    assert text.splitlines()[1] == '"a;b \\\\ c";"say ""x""";""'


def test_dbf_columns_and_record_ids(spark, tmp_path):
    _write(tmp_path / "DOAC2019.dbf", [("SEXO", 1), ("IDADE", 4)], [(str(i % 3), f"4{i:02d}") for i in range(50)], deleted={7})
    _write(tmp_path / "DOAM2020.dbf", [("IDADE", 3)], [("425",)])
    dbf.register(spark)
    for size in (40, 1 << 20):
        df = spark.read.format("dbf").options(columns="IDADE,SEXO,ANO", recordId="true", rangeBytes=size).load(str(tmp_path))
        assert df.columns == ["IDADE", "SEXO", "ANO", "_record"]
        rows = {r["_record"]: r for r in df.collect()}
        assert len(rows) == 50 and "DOAC2019.dbf#7" not in rows
        assert rows["DOAC2019.dbf#31"]["IDADE"] == "431" and rows["DOAM2020.dbf#0"]["SEXO"] is None


def test_store_keeps_the_type_of_groups(spark, tmp_path):
    store = ResultStore(str(tmp_path / "store"), "g")
    store.write("chosen", "A", spark.createDataFrame([("01", 1), ("1", 2), ("1e3", 3)], "g string, k int"))
    store.write("chosen", "A", spark.createDataFrame([("1", 5)], "g string, k int"))
    found = store.read(spark, "chosen")
    assert dict(found.dtypes)["g"] == "string" and {r["g"]: r["k"] for r in found.collect()} == {"01": 1, "1": 5, "1e3": 3}


def test_conditions_on_file_columns_choose_the_files(spark, tmp_path):
    for state in ("AC", "AM", "PA"):
        for year in range(2013, 2017):
            _write(tmp_path / f"DO{state}{year}.dbf", [("SEXO", 1)], [("1",), ("2",)])
    (tmp_path / "DORR2013.dbf").write_bytes(b"not a table")  # opening it would fail
    dbf.register(spark)
    df = spark.read.format("dbf").option("columns", "SEXO,ESTADO,ANO").load(str(tmp_path))
    c = {n: F.col(n) for n in df.columns}
    cases = [
        (c["ESTADO"] == "AC", 4, 8), (c["ESTADO"].isin("AC", "PA") & (c["ANO"] >= "2015"), 4, 8),
        ((c["ESTADO"] == "AM") & (c["ANO"] < "2015") & (c["SEXO"] == "2"), 2, 2), ((c["ESTADO"] != "RR") & (c["ANO"] == "2013"), 3, 6),
        (c["ESTADO"].startswith("A") & ~c["ANO"].isin("2013", "2014"), 4, 8), (c["ESTADO"].isNull(), 0, 0), (c["ANO"] == "1999", 0, 0),
    ]
    for condition, files, rows in cases:
        found = df.where(condition)
        assert found.count() == rows
        assert found.rdd.getNumPartitions() <= max(files, 1)
    either = df.where(((c["ESTADO"] == "AC") | (c["SEXO"] == "2")) & (c["ESTADO"] < "RR"))  # needs the rows as well
    assert either.count() == 8 + 8


def test_store_shows_whole_writes_only(spark, tmp_path):
    store = ResultStore(str(tmp_path / "store"), "g")
    store.write("labels", "A", spark.createDataFrame([("x", 1), ("y", 2)], "g string, k int"))
    broken = spark.range(0, 2000, numPartitions=8).select(
        F.lit("x").alias("g"), F.when(F.col("id") < 1900, 7).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("k")
    )
    with pytest.raises(Exception, match="lost"):
        store.write("labels", "A", broken)
    old = {("x", 1), ("y", 2)}
    assert {(r["g"], r["k"]) for r in store.read(spark, "labels").collect()} == old
    before = store.read(spark, "labels")  # a reader that started earlier keeps its version
    store.write("labels", "A", spark.createDataFrame([("x", 3, "new")], "g string, k int, note string"))
    store.write("labels", "A", spark.createDataFrame([], "g string, k int"))
    assert {(r["g"], r["k"]) for r in before.collect()} == old
    found = {(r["g"], r["k"], r["note"]) for r in store.read(spark, "labels").collect()}
    assert found == {("x", 3, "new"), ("y", 2, None)}
    assert store.vacuum(spark, "labels") >= 3 and store.vacuum(spark, "labels") == 0
    assert {(r["g"], r["k"], r["note"]) for r in store.read(spark, "labels").collect()} == found
    with pytest.raises(FileNotFoundError):
        store.read(spark, "chosen")


def test_writers_that_meet_both_count(spark, tmp_path, monkeypatch):
    store, other = ResultStore(str(tmp_path / "store"), "g"), []
    one = spark.createDataFrame([("x", 1)], "g string, k int")
    look = ResultStore._manifest

    def meanwhile(self, *args):
        seen = look(self, *args)
        if not other:
            other.append(True)
            self.write("chosen", "B", one)  # commits between this writer's look and its rename
        return seen

    monkeypatch.setattr(ResultStore, "_manifest", meanwhile)
    store.write("chosen", "A", one)
    assert {r["algorithm"] for r in store.read(spark, "chosen").collect()} == {"A", "B"}


def test_kept_vectors_follow_files_and_specification(spark, tmp_path):
    folder, target = str(tmp_path / "rows"), str(tmp_path / "kept")
    spec = FeatureSpec("g", "i", (Nominal("a", ("p", "q")),))

    def call(spec, version=""):
        vectors, built = stored_vectors(spark.read.schema("g string, i long, a string").parquet(folder), spec, [folder], target, version)
        return built, sorted((r["g"], r["a_code"], r["w"]) for r in vectors.collect())

    def add(rows):
        spark.createDataFrame(rows, "g string, i long, a string").write.mode("append").parquet(folder)

    add([("x", 1, "p"), ("x", 2, "p")])
    assert call(spec) == (True, [("x", 0, 2)]) and call(spec) == (False, [("x", 0, 2)])
    add([("x", 3, "q")])
    assert call(spec) == (True, [("x", 0, 2), ("x", 1, 1)]) and not call(spec)[0]
    other = replace(spec, nominals=(Nominal("a", ("q", "p")),))
    assert call(other) == (True, [("x", 0, 1), ("x", 1, 2)])
    assert len([p for p in (tmp_path / "kept").iterdir() if p.is_dir()]) == 1
    assert call(spec)[0] and call(spec, "2")[0]
