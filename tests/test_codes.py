import pytest
from pyspark.sql import functions as F

from kinprofile.functions import mortality as m
from kinprofile.functions.scalar import lookup
from kinprofile.operators import quality

AGES = [
    ("425", 25.0), (" 425 ", 25.0), ("425.7", 25.0), ("4125", 125.0), ("400", 0.0), ("306", 0.5), ("215", 15 / 365),
    ("015", 5 / 8760), ("025", 5 / 365), ("501", None), ("999", None), ("4", None), ("", None), (None, None),
    ("abc", None), ("-425", None), ("nan", None), ("425D", None), ("425f", None), ("\t425\n", 25.0), ("4.25e2", 25.0),
]
BANDS = [
    (0.5, "recem_nascido"), (1.0, "crianca"), (11.9, "crianca"), (12.0, "adolescente"), (17.0, "adolescente"),
    (18.0, "jovem_adulto"), (29.0, "jovem_adulto"), (30.0, "adulto"), (59.0, "adulto"), (60.0, "idoso"), (None, "ignorado"),
]
HOURS = [
    ("0559", "madrugada"), ("0600", "manha"), ("1200", "tarde"), ("1800", "noite"), ("2359", "noite"),
    ("9999", "ignorado"), ("2400", "ignorado"), ("", "ignorado"), (None, "ignorado"), ("x1", "ignorado"), ("1d30", "ignorado"), ("2f", "ignorado"),
]
CATEGORIES = [
    (m.SEX_CATEGORY, "nao_decl", [("1", "masculino"), ("F", "feminino"), ("I", "nao_decl"), ("9", "nao_decl"), (None, "nao_decl")]),
    (m.RACE_CATEGORY, "nao_decl", [("4", "parda"), ("0", "nao_decl"), ("9", "nao_decl"), (" parda ", "parda")]),
    (m.MARITAL_CATEGORY, "ignorado", [("3", "vinculo_encerrado"), ("4", "vinculo_encerrado"), ("5", "com_vinculo"), ("0", "ignorado"), ("9", "ignorado")]),
    (m.SCHOOL_CATEGORY, "ignorado", [("2", "fundamental"), ("3", "fundamental"), ("5", "superior"), ("0", "ignorado")]),
    (m.PLACE_CATEGORY, "ignorado", [("1", "estab_saude"), ("2", "estab_saude"), ("4", "local_publico"), ("0", "ignorado"), ("6", "ignorado")]),
]


def _column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_age_codes(spark):
    found = _column(spark, [a for a, _ in AGES], m.age_years)
    assert found == pytest.approx([e for _, e in AGES])


def test_age_bands(spark):
    assert _column(spark, [a for a, _ in BANDS], m.age_band, "double") == [b for _, b in BANDS]


def test_shifts(spark):
    assert _column(spark, [h for h, _ in HOURS], lambda c: m.shift(m.raw_hour(c))) == [s for _, s in HOURS]


@pytest.mark.parametrize("table,default,rows", CATEGORIES)
def test_categories(spark, table, default, rows):
    assert _column(spark, [v for v, _ in rows], lambda c: lookup(c, table, default)) == [e for _, e in rows]


def test_descriptive_maps_have_no_default(spark):
    assert _column(spark, ["0", "9", "1"], lambda c: lookup(c, m.MARITAL_NUMBER)) == [None, 0, 1]
    assert _column(spark, ["0", "9", "5"], lambda c: lookup(c, m.RACE_NUMBER)) == [None, None, 5]
    assert _column(spark, ["", "I", "9"], lambda c: lookup(c, m.SEX_NUMBER)) == [0, 0, None]


def test_cause_filter(spark):
    df = spark.createDataFrame([("X849",), ("X850",), ("Y099",), ("Y10",), (None,)], "CAUSABAS_O string")
    assert sorted(r[0] for r in m.homicides(df).collect()) == ["X850", "Y099"]
    assert len(m.HOMICIDE_CODES) == 25


def test_ignored_codes_differ_by_column(spark):
    def state(column, value):
        df = spark.createDataFrame([(value,)], "v string")
        missing, ignored = quality.is_missing(F.col("v")), quality.is_ignored(F.col("v"), m.IGNORED_CODES[column])
        row = df.select(missing, ignored).first()
        return "missing" if row[0] else "ignored" if row[1] else "informative"

    assert state("SEXO", "0") == "ignored"
    assert state("ESTCIV", "0") == "informative"
    assert state("ESTCIV", "9") == "ignored"
    assert state("RACACOR", "0") == "informative"
    assert state("ESC", " NaN ") == "missing"


def test_preset_bound():
    spec = m.mortality_spec()
    assert spec.max_vectors == 7 * 6 * 4 * 7 * 5 * 5 * 4
    assert [f.dropped for f in spec.nominals] == ["ignorado", None, None, None, "ignorado"]
