"""Registered queries and, where SQL can express them, the SQL that checks them.

Every query reads the given tables; ``QUERIES`` maps a name to its callable and ``ORACLE`` a
name to its check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinprofile.functions import mortality
from kinprofile.functions.scalar import (
    agreement_reading, band, coded_in, lookup, poisson_one, stability_reading, uniform,
)
from kinprofile.operators import agglomerative, dbscan, describe, hdbscan, kmeans, metrics, quality, resampling, selection, tendency
from kinprofile.operators.agreement import agreement, agreement_matrix, pair_summary
from kinprofile.operators.neighbours import neighbour_counts
from kinprofile.operators.profile import cluster_profile, wide_profile
from kinprofile.operators.projection import principal_axes, projection_2d
from kinprofile.operators.quantiles import grouped_quantiles
from kinprofile.operators.sampling import sample_rows
from kinprofile.operators.vectors import distinct_vectors, feature_table, vector_table
from kinprofile.plans import mortality as study
from kinprofile.plans import typology
from kinprofile.plans.dbf_files import write_dbf
from kinprofile.plans.oracle_parts import CODED, FEATURES, FINE_VECTORS, KDIST, LABELS, ORD, PAIRS, VECTORS
from kinprofile.plans.oracle_parts import uniform as sql_uniform
from kinprofile.plans.workloads import FINE_ORDERS, LINES, ORDERS, fine_order_profiles, line_profiles, order_profiles, table
from kinprofile.session import materialise, qualified, scratch_path
from kinprofile.sources import dbf, tables
from kinprofile.sources.features import stored_vectors
from kinprofile.sources.store import ResultStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GROUP = ORDERS.group
PLACES = 6


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def r(name: str, alias: str | None = None):
    return F.round(name, PLACES).alias(alias or name)


def given_members(vectors: DataFrame) -> DataFrame:
    """Three given partitions: order status ("P" as noise), segment, price band (top as noise)."""
    choices = {
        "status": F.when(F.col("o_orderstatus_code") == 2, -1).otherwise(F.col("o_orderstatus_code")),
        "segment": F.col("c_mktsegment_code"),
        "band": F.when(F.col("price_band_code") == 4, -1).otherwise(F.col("price_band_code")),
    }
    labels = F.explode(F.array(*[
        F.struct(F.lit(name).alias("algorithm"), label.alias("label")) for name, label in choices.items()
    ]))
    return vectors.select(GROUP, "vid", "w", labels.alias("m")).select(GROUP, "m.algorithm", "vid", "m.label", "w")


# ---------------------------------------------------------------- sources, sinks, projections


@register(f"WITH {ORD} SELECT r_name, count(*)::BIGINT AS n FROM ord GROUP BY r_name")
def group_counts(spark, sf):
    return order_profiles(spark, sf).groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {ORD}, grid AS (
  SELECT r_name, y::INT AS order_year FROM region CROSS JOIN generate_series(1990, 2004) t(y))
SELECT r_name, order_year FROM grid WHERE (r_name, order_year) NOT IN (SELECT (r_name, year(o_orderdate)::INT) FROM ord)""")
def coverage_gap(spark, sf):
    """Regions of the region table x years without any order."""
    found = order_profiles(spark, sf).select(GROUP, F.year("o_orderdate").alias("order_year"))
    regions = [r[GROUP] for r in table(spark, sf, "region").select(GROUP).distinct().collect()]
    return tables.coverage_gap(found, {GROUP: regions, "order_year": list(range(1990, 2005))})


@register("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def parquet_projection(spark, sf):
    wanted = ["o_orderkey", "o_not_there", "o_orderstatus", "o_orderpriority"]
    return tables.project_present(table(spark, sf, "orders"), wanted)


@register(f"WITH {ORD} SELECT r_name, o_orderkey, o_totalprice, price_band FROM ord")
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "roundtrip")
    rows = order_profiles(spark, sf).select(GROUP, "o_orderkey", "o_totalprice", "price_band")
    tables.write_parquet(rows, path, partition_by=[GROUP])
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns)


@register("""SELECT c_custkey, c_name || '; "' || c_mktsegment || '" \\ end' AS note, c_acctbal FROM customer""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "delimited")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('" \\ end')).alias("note"), "c_acctbal"
    )
    tables.write_delimited(rows, path)
    return tables.read_delimited(spark, path, "c_custkey bigint, note string, c_acctbal double")


@register(r"""SELECT '"' || c_custkey || '";"' || c_name || '; ""' || c_mktsegment || '"" \\ end"' AS line FROM customer""")
def csv_lines(spark, sf):
    """The raw lines of the delimited sink: every field quoted, quotes and backslashes doubled."""
    path = scratch_path(spark, "delimited")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('" \\ end')).alias("note")
    )
    tables.write_delimited(rows, path)
    header = '"c_custkey";"note"'  # every file has it
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line") != header)


@register(f"WITH {ORD} SELECT r_name, count(*)::BIGINT AS n, round(avg(o_totalprice), 2) AS mean_price FROM ord GROUP BY r_name")
def report_roundtrip(spark, sf):
    path = scratch_path(spark, "report")
    report = order_profiles(spark, sf).groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")
    )
    tables.write_report(report, path)
    return tables.read_report(spark, path, "r_name string, n bigint, mean_price double")


@register("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return tables.union_tables([customers, suppliers])


@register("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


def _orders_as_dbf(spark: SparkSession, sf: str) -> str:
    """The orders as DBF files named DOUFAAAA-part.dbf."""
    rows = order_profiles(spark, sf).select(
        F.substring(GROUP, 1, 2).alias("uf"), F.year("o_orderdate").cast("string").alias("year"),
        F.col("o_orderkey").cast("string").alias("ORDERKEY"), F.col("o_orderstatus").alias("STATUS"),
        F.col("o_orderpriority").alias("PRIORITY"), F.format_string("%.2f", "o_totalprice").alias("PRICE"),
    )
    folder = scratch_path(spark, "dbf")
    write_dbf(rows, folder, {"ORDERKEY": 12, "STATUS": 1, "PRIORITY": 15, "PRICE": 12})
    return folder


@register(f"""WITH {ORD} SELECT substr(r_name, 1, 2) AS "ESTADO", year(o_orderdate)::VARCHAR AS "ANO", o_orderstatus AS status,
  count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, min(o_orderpriority) AS first_priority
FROM ord GROUP BY ALL""")
def dbf_scan(spark, sf):
    dbf.register(spark)
    scanned = spark.read.format("dbf").load(_orders_as_dbf(spark, sf))
    return scanned.groupBy("ESTADO", "ANO", F.col("STATUS").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("PRICE").cast("double")), 2).alias("total"),
        F.min("PRIORITY").alias("first_priority"),
    )


@register(f"""WITH {ORD} SELECT substr(r_name, 1, 2) AS uf, year(o_orderdate)::VARCHAR AS order_year, o_orderstatus AS status, count(*)::BIGINT AS n
FROM ord WHERE substr(r_name, 1, 2) IN ('AS', 'EU') AND year(o_orderdate) >= 1996 AND o_orderstatus <> 'P' GROUP BY ALL""")
def dbf_pushed_filter(spark, sf):
    """States and years asked for by conditions on columns: the other files are never opened."""
    dbf.register(spark)
    scanned = spark.read.format("dbf").option("columns", "STATUS,ESTADO,ANO").load(_orders_as_dbf(spark, sf))
    asked = scanned.where(F.col("ESTADO").isin("AS", "EU") & (F.col("ANO") >= "1996") & (F.col("STATUS") != "P"))
    keys = [F.col("ESTADO").alias("uf"), F.col("ANO").alias("order_year"), F.col("STATUS").alias("status")]
    return asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {ORD} SELECT DISTINCT substr(r_name, 1, 2) AS uf, year(o_orderdate)::VARCHAR AS order_year FROM ord
WHERE year(o_orderdate) IN (1996, 1997)""")
def file_partition_columns(spark, sf):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "DO??199[67]*.dbf").load(_orders_as_dbf(spark, sf))
    return tables.with_file_columns(files, uf=(3, 2), order_year=(5, 4)).select("uf", "order_year").distinct()


@register(f"""WITH {ORD} SELECT 'second' AS algorithm, r_name, o_orderstatus AS label, count(*)::BIGINT AS w FROM ord
WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL
UNION ALL SELECT 'first', r_name, o_orderpriority, count(*)::BIGINT FROM ord WHERE r_name = 'ASIA' GROUP BY ALL
UNION ALL SELECT 'first', r_name, o_orderstatus, count(*)::BIGINT FROM ord WHERE r_name <> 'ASIA' GROUP BY ALL""")
def result_store_overwrite(spark, sf):
    store = ResultStore(scratch_path(spark, "store"), GROUP)
    rows = order_profiles(spark, sf)
    by_status = rows.groupBy(GROUP, F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("w"))
    by_priority = rows.groupBy(GROUP, F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("w"))
    store.write("labels", "first", by_status)
    store.write("labels", "second", by_status.filter(F.col(GROUP).isin("ASIA", "EUROPE")))
    store.write("labels", "first", by_priority.filter(F.col(GROUP) == "ASIA"))
    return store.read(spark, "labels").select("algorithm", GROUP, "label", "w")


@register("""SELECT 'counts' AS algorithm, code, count(*)::BIGINT AS n FROM (
  SELECT CASE n_regionkey WHEN 0 THEN '01' WHEN 1 THEN '1' WHEN 2 THEN '1e3' WHEN 3 THEN '2020-01-01' ELSE 'x/y=z %' END AS code
  FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY code""")
def result_store_codes(spark, sf):
    """Groups that look like numbers or dates come back as the text they were."""
    codes = F.element_at(F.array(*map(F.lit, ["01", "1", "1e3", "2020-01-01", "x/y=z %"])), F.col("n_regionkey") + 1)
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    store = ResultStore(scratch_path(spark, "store"), "code")
    for _ in range(2):  # the second run replaces the first
        store.write("chosen", "counts", rows.select(codes.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    return store.read(spark, "chosen").select("algorithm", "code", "n")


@register(f"""WITH {VECTORS} SELECT r_name, count(*)::BIGINT AS vectors, sum(w)::BIGINT AS total_rows, max(w)::BIGINT AS heaviest
FROM v GROUP BY r_name""")
def feature_table_reuse(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    sizes = vectors.groupBy(GROUP).agg(F.count(F.lit(1)).alias("vectors"), F.sum("w").alias("total_rows"))
    return sizes.join(vectors.groupBy(GROUP).agg(F.max("w").alias("heaviest")), GROUP)


@register(f"""WITH {ORD}, step AS (SELECT * FROM (VALUES ('built', 1998, TRUE), ('kept', 1998, FALSE), ('rebuilt', 9999, TRUE)) t(step, below, built)),
v AS (SELECT step, built, r_name, o_orderpriority, o_orderstatus, c_mktsegment, price_band, count(*) AS w
  FROM ord JOIN step ON year(o_orderdate) < below GROUP BY ALL)
SELECT step, built, r_name, count(*)::BIGINT AS vectors, sum(w)::BIGINT AS total_rows FROM v GROUP BY ALL""")
def feature_table_versions(spark, sf):
    """A kept vector table: built, taken again as it is, and built anew once files came in."""
    folder, target = scratch_path(spark, "orders"), scratch_path(spark, "features")
    rows = order_profiles(spark, sf)
    early = F.year("o_orderdate") < 1998
    out = []
    for step, new in (("built", rows.where(early)), ("kept", None), ("rebuilt", rows.where(~early))):
        if new is not None:
            tables.write_parquet(new, folder, mode="append")
        vectors, built = stored_vectors(spark.read.schema(rows.schema).parquet(folder), ORDERS, [folder], target)
        sizes = vectors.groupBy(GROUP).agg(F.count(F.lit(1)).alias("vectors"), F.sum("w").alias("total_rows"))
        out.append(materialise(sizes.select(F.lit(step).alias("step"), F.lit(built).alias("built"), GROUP, "vectors", "total_rows"), "sizes"))
    return tables.union_tables(out)


# ---------------------------------------------------------------- predicates, codes, scalar functions


@register("""SELECT c_custkey, c_mktsegment, (substr(c_mktsegment, 1, 3) = 'AUT')::INT AS is_auto FROM customer
WHERE substr(c_mktsegment, 1, 3) IN ('AUT', 'BUI')""")
def coded_filter(spark, sf):
    customer = table(spark, sf, "customer").filter(coded_in(F.col("c_mktsegment"), ["AUT", "BUI"]))
    return customer.select(
        "c_custkey", "c_mktsegment", coded_in(F.col("c_mktsegment"), ["AUT"]).cast("int").alias("is_auto")
    )


@register("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS with_default,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS without_default FROM orders""")
def code_lookup(spark, sf):
    status = F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))
    return table(spark, sf, "orders").select(
        "o_orderkey", lookup(status, {"F": "finished", "O": "open"}, "other").alias("with_default"),
        lookup(status, {"F": 1, "O": 2}).alias("without_default"),
    )


def death_records(spark: SparkSession, sf: str) -> DataFrame:
    """Coded records shaped like the mortality input, derived from the order table."""
    orders = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    quantity = (cust % 100).cast("string")
    age = (
        F.when(key % 9 == 0, F.concat(F.lit("3"), F.lpad((cust % 12).cast("string"), 2, "0")))
        .when(key % 9 == 1, F.concat(F.lit("2"), F.lpad((cust % 30).cast("string"), 2, "0")))
        .when(key % 9 == 2, F.concat(F.lit("0"), F.lpad((cust % 60).cast("string"), 2, "0")))
        .when(key % 9 == 3, F.concat(F.lit(" 4"), F.lpad(quantity, 2, "0"), F.lit(" ")))
        .when(key % 9 == 4, F.lit("999")).when(key % 9 == 5, F.lit(None).cast("string"))
        .when(key % 9 == 6, F.concat(F.lit("4"), F.lpad(quantity, 2, "0"), F.lit(".7")))
        .otherwise(F.concat(F.lit("4"), F.lpad(quantity, 2, "0")))
    )
    hour = F.when(key % 13 == 0, F.lit("9999")).when(key % 13 == 1, F.lit("")).otherwise(
        F.concat(F.lpad((cust % 25).cast("string"), 2, "0"), F.lit("30"))
    )
    cause = F.concat(F.element_at(F.array(*map(F.lit, ["X84", "X85", "X99", "Y00", "Y09", "Y10", "I21"])), (key % 7 + 1).cast("int")), (cust % 10).cast("string"))

    def pick(codes: list[str], salt: int):
        return F.element_at(F.array(*map(F.lit, codes)), ((key * salt + cust) % len(codes) + 1).cast("int"))

    return orders.select(
        key.alias("row_id"), age.alias("IDADE"), hour.alias("HORAOBITO"), cause.alias("CAUSABAS_O"),
        pick(["1", "2", "0", "M", "F", "I", "9", ""], 3).alias("SEXO"),
        pick(["1", "2", "3", "4", "5", "0", "parda", " 2 ", "x"], 5).alias("RACACOR"),
        pick(["1", "2", "3", "4", "5", "9", "0", "casado"], 7).alias("ESTCIV"),
        pick(["1", "2", "3", "4", "5", "9", "0", "8 a 11 anos"], 11).alias("ESC"),
        pick(["1", "2", "3", "4", "5", "9", "0", "hospital"], 13).alias("LOCOCOR"),
        F.year("o_orderdate").cast("string").alias("ANO"),
        pick(["AC", "AM", "PA"], 17).alias("ESTADO"),
    )


def _sql_pick(codes: list[str], salt: int) -> str:
    return f"([{', '.join(repr(c) for c in codes)}])[(o_orderkey * {salt} + o_custkey) % {len(codes)} + 1]"


DEATHS = f"""deaths AS (SELECT o_orderkey AS row_id,
  CASE o_orderkey % 9 WHEN 0 THEN '3' || lpad((o_custkey % 12)::VARCHAR, 2, '0') WHEN 1 THEN '2' || lpad((o_custkey % 30)::VARCHAR, 2, '0')
    WHEN 2 THEN '0' || lpad((o_custkey % 60)::VARCHAR, 2, '0') WHEN 4 THEN '999' WHEN 5 THEN NULL
    ELSE '4' || lpad((o_custkey % 100)::VARCHAR, 2, '0') END AS idade,
  CASE o_orderkey % 13 WHEN 0 THEN '9999' WHEN 1 THEN '' ELSE lpad((o_custkey % 25)::VARCHAR, 2, '0') || '30' END AS hora,
  (['X84', 'X85', 'X99', 'Y00', 'Y09', 'Y10', 'I21'])[o_orderkey % 7 + 1] AS causa,
  {_sql_pick(["1", "2", "0", "M", "F", "I", "9", ""], 3)} AS sexo,
  {_sql_pick(["1", "2", "3", "4", "5", "0", "parda", "2", "x"], 5)} AS raca,
  {_sql_pick(["1", "2", "3", "4", "5", "9", "0", "casado"], 7)} AS estciv,
  {_sql_pick(["1", "2", "3", "4", "5", "9", "0", "8 a 11 anos"], 11)} AS esc,
  {_sql_pick(["1", "2", "3", "4", "5", "9", "0", "hospital"], 13)} AS lococor,
  year(o_orderdate)::INT AS ano, {_sql_pick(["AC", "AM", "PA"], 17)} AS estado FROM orders),
aged AS (SELECT *, CASE WHEN idade IS NULL OR idade = '999' THEN NULL ELSE idade::INT::VARCHAR END AS digits,
  CASE WHEN hora = '' OR substr(hora, 1, 2)::INT > 23 THEN NULL ELSE substr(hora, 1, 2)::INT END AS h FROM deaths),
decoded AS (SELECT *, CASE WHEN length(digits) < 2 THEN NULL ELSE
  CASE substr(digits, 1, 1) WHEN '4' THEN substr(digits, 2)::DOUBLE WHEN '3' THEN substr(digits, 2)::DOUBLE / 12
    WHEN '2' THEN substr(digits, 2)::DOUBLE / 365 WHEN '1' THEN substr(digits, 2)::DOUBLE / 8760 END END AS years FROM aged)"""


@register(f"""WITH {DEATHS} SELECT row_id, round(years, 6) AS years, ano,
  CASE WHEN years IS NULL THEN 'ignorado' WHEN years < 1 THEN 'recem_nascido' WHEN years < 12 THEN 'crianca' WHEN years < 18 THEN 'adolescente'
    WHEN years < 30 THEN 'jovem_adulto' WHEN years < 60 THEN 'adulto' ELSE 'idoso' END AS faixa,
  CASE WHEN h IS NULL THEN 'ignorado' WHEN h < 6 THEN 'madrugada' WHEN h < 12 THEN 'manha' WHEN h < 18 THEN 'tarde' ELSE 'noite' END AS turno,
  CASE WHEN sexo IN ('1', 'M') THEN 'masculino' WHEN sexo IN ('2', 'F') THEN 'feminino' ELSE 'nao_decl' END AS sexo,
  CASE raca WHEN '1' THEN 'branca' WHEN '2' THEN 'preta' WHEN '3' THEN 'amarela' WHEN '4' THEN 'parda' WHEN 'parda' THEN 'parda'
    WHEN '5' THEN 'indigena' ELSE 'nao_decl' END AS raca,
  CASE WHEN estciv = '1' THEN 'solteiro' WHEN estciv IN ('2', '5', 'casado') THEN 'com_vinculo' WHEN estciv IN ('3', '4') THEN 'vinculo_encerrado'
    ELSE 'ignorado' END AS estciv,
  CASE WHEN esc = '1' THEN 'sem_escolaridade' WHEN esc IN ('2', '3') THEN 'fundamental' WHEN esc IN ('4', '8 a 11 anos') THEN 'medio'
    WHEN esc = '5' THEN 'superior' ELSE 'ignorado' END AS esc,
  CASE WHEN lococor IN ('1', '2', 'hospital') THEN 'estab_saude' WHEN lococor = '3' THEN 'domicilio' WHEN lococor = '4' THEN 'local_publico'
    WHEN lococor = '5' THEN 'outros' ELSE 'ignorado' END AS lococor,
  (causa IN ('X85', 'X99', 'Y00', 'Y09'))::INT AS homicidio,
  CASE WHEN sexo IN ('1', 'M') THEN 1 WHEN sexo IN ('2', 'F') THEN 2 WHEN sexo IN ('0', 'I', '') THEN 0 END AS sexo_num,
  CASE WHEN raca IN ('1', '2', '3', '4', '5') THEN raca::INT WHEN raca = 'parda' THEN 4 END AS raca_num,
  CASE WHEN estciv IN ('1', '2', '3', '4', '5') THEN estciv::INT WHEN estciv = '9' THEN 0 WHEN estciv = 'casado' THEN 2 END AS estciv_num,
  CASE WHEN esc IN ('1', '2', '3', '4', '5') THEN esc::INT WHEN esc IN ('0', '9') THEN 0 ELSE 4 END AS esc_num,
  CASE WHEN lococor IN ('1', '2', '3', '4', '5') THEN lococor::INT WHEN lococor = '9' THEN 0 WHEN lococor = 'hospital' THEN 1 END AS lococor_num
FROM decoded""")
def mortality_codes(spark, sf):
    rows = mortality.describe_numeric(mortality.categorise(death_records(spark, sf)))
    return rows.select(
        "row_id", r("IDADE_NUM", "years"), F.col("ANO_NUM").alias("ano"), F.col("FAIXA_IDADE").alias("faixa"),
        F.col("TURNO_HORA").alias("turno"), F.col("CAT_SEXO").alias("sexo"), F.col("CAT_RACA").alias("raca"),
        F.col("CAT_ESTCIV").alias("estciv"), F.col("CAT_ESC").alias("esc"), F.col("CAT_LOCOCOR").alias("lococor"),
        F.col("HOMICIDIO").alias("homicidio"), F.col("SEXO_NUM").alias("sexo_num"), F.col("RACACOR_NUM").alias("raca_num"),
        F.col("ESTCIV_NUM").alias("estciv_num"), F.col("ESC_NUM").alias("esc_num"), F.col("LOCOCOR_NUM").alias("lococor_num"),
    )


@register(f"""WITH {DEATHS} SELECT estado, count(*)::BIGINT AS n FROM decoded WHERE causa IN ('X85', 'X99', 'Y00', 'Y09') GROUP BY estado""")
def homicide_counts(spark, sf):
    kept = mortality.homicides(death_records(spark, sf))
    return kept.groupBy(F.col("ESTADO").alias("estado")).agg(F.count(F.lit(1)).alias("n"))


DEATHS_KEPT = f"""{DEATHS}, kept AS (SELECT * FROM decoded WHERE causa IN ('X85', 'X99', 'Y00', 'Y09'))"""


def _pct(condition: str) -> str:
    return f"round(avg(({condition})::INT) * 100, 6)"


@register(f"""WITH {DEATHS_KEPT}, shares AS (SELECT estado AS "ESTADO", count(*)::BIGINT AS n,
  {_pct("sexo = ''")} AS "SEXO_missing", {_pct("sexo IN ('0', 'I')")} AS "SEXO_ignored",
  0.0::DOUBLE AS "RACACOR_missing", 0.0::DOUBLE AS "RACACOR_ignored", 0.0::DOUBLE AS "ESTCIV_missing", {_pct("estciv = '9'")} AS "ESTCIV_ignored",
  0.0::DOUBLE AS "ESC_missing", {_pct("esc = '9'")} AS "ESC_ignored", 0.0::DOUBLE AS "LOCOCOR_missing", {_pct("lococor = '9'")} AS "LOCOCOR_ignored",
  {_pct("years IS NULL")} AS "IDADE_invalid", {_pct("h IS NULL")} AS "HORA_invalid" FROM kept GROUP BY estado)
SELECT *, round("SEXO_missing" + "SEXO_ignored", 6) AS "SEXO_total", "RACACOR_ignored" AS "RACACOR_total", "ESTCIV_ignored" AS "ESTCIV_total",
  "ESC_ignored" AS "ESC_total", "LOCOCOR_ignored" AS "LOCOCOR_total" FROM shares""")
def mortality_diagnosis(spark, sf):
    return study.diagnosis(mortality.homicides(death_records(spark, sf)), PLACES)


@register(f"""WITH {DEATHS_KEPT}, middle AS (SELECT estado, median(years) AS y, median(h::DOUBLE) AS hh FROM kept GROUP BY estado),
  races AS (SELECT *, CASE WHEN raca IN ('1', '2', '3', '4', '5') THEN raca::INT WHEN raca = 'parda' THEN 4 END AS race FROM kept),
  tops AS (SELECT estado, race AS race_top FROM (SELECT estado, race, row_number() OVER (PARTITION BY estado ORDER BY count(*) DESC, race) AS place
    FROM races WHERE race IS NOT NULL GROUP BY estado, race) WHERE place = 1),
  filled AS (SELECT row_id, estado, coalesce(years, y) AS idade, coalesce(h::DOUBLE, hh) AS hora, coalesce(race, race_top)::DOUBLE AS raca
    FROM races JOIN middle USING (estado) JOIN tops USING (estado))
SELECT row_id, estado, round(idade, 6) AS idade, hora, raca, CASE WHEN stddev_pop(idade) OVER g = 0 THEN 0 ELSE round((idade - avg(idade) OVER g) / stddev_pop(idade) OVER g, 6) END AS idade_z,
  CASE WHEN stddev_pop(raca) OVER g = 0 THEN 0 ELSE round((raca - avg(raca) OVER g) / stddev_pop(raca) OVER g, 6) END AS raca_z FROM filled WINDOW g AS (PARTITION BY estado)""")
def mortality_descriptive(spark, sf):
    filled = study.descriptive_table(mortality.homicides(death_records(spark, sf)))
    return filled.select(
        "row_id", F.col("ESTADO").alias("estado"), r("IDADE_NUM", "idade"), F.col("HORA_NUM").alias("hora"),
        F.col("RACACOR_NUM").alias("raca"), r("IDADE_NUM_z", "idade_z"), r("RACACOR_NUM_z", "raca_z"),
    )


#: The grid of study_coverage; the other study queries read every year that has a file.
GRID_YEARS = [str(y) for y in range(1993, 1998)]


def _study(spark: SparkSession, sf: str, years: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The deaths laid out as DBF files and ingested: coverage gaps, and homicides with record ids.

    Without ``years`` every year that has a file is read.
    """
    folder, out = scratch_path(spark, "study-dbf"), scratch_path(spark, "study")
    rows = death_records(spark, sf).withColumnRenamed("row_id", "NUMERODO").withColumn("NUMERODO", F.col("NUMERODO").cast("string"))
    write_dbf(rows.withColumns({"uf": F.col("ESTADO"), "year": F.col("ANO")}).drop("ESTADO", "ANO"), folder, {
        "NUMERODO": 10, "IDADE": 5, "HORAOBITO": 4, "CAUSABAS_O": 4, "SEXO": 1, "RACACOR": 5, "ESTCIV": 6, "ESC": 11, "LOCOCOR": 8,
    })
    gaps = study.ingest(spark, folder, out, ["AC", "AM", "PA", "RO"], years or dbf.years(qualified(spark, folder)))
    return gaps, study.read_homicides(spark, out)


STUDY = f"""{DEATHS}, study AS (SELECT * FROM decoded WHERE causa IN ('X85', 'X99', 'Y00', 'Y09'))"""


@register(f"""WITH {DEATHS}, grid AS (SELECT s AS "ESTADO", y::VARCHAR AS "ANO" FROM unnest(['AC', 'AM', 'PA', 'RO']) t(s), generate_series(1993, 1997) u(y))
SELECT * FROM grid WHERE ("ESTADO", "ANO") NOT IN (SELECT estado, ano::VARCHAR FROM deaths)""")
def study_coverage(spark, sf):
    """State x year combinations without a file, from the file names alone."""
    return _study(spark, sf, GRID_YEARS)[0]


@register(f"""WITH {STUDY} SELECT estado AS "ESTADO", ano::VARCHAR AS "ANO", count(*)::BIGINT AS n, count(*)::BIGINT AS records,
  round(avg(years), 6) AS years FROM study GROUP BY ALL""")
def study_ingest(spark, sf):
    """The homicide table of the ingested files; every row has a record id of its own."""
    kept = mortality.decode(_study(spark, sf)[1])
    return kept.groupBy("ESTADO", "ANO").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(dbf.RECORD).alias("records"), F.round(F.avg("IDADE_NUM"), 6).alias("years")
    )


@register(f"""WITH {STUDY}, coded AS (SELECT estado, CASE WHEN sexo IN ('1', 'M') THEN 1 WHEN sexo IN ('2', 'F') THEN 2 WHEN sexo IN ('0', 'I', '') THEN 0 END AS sex FROM study),
  mode AS (SELECT estado, sex AS top FROM (SELECT estado, sex, row_number() OVER (PARTITION BY estado ORDER BY count(*) DESC, sex) AS place
    FROM coded WHERE sex IS NOT NULL GROUP BY estado, sex) WHERE place = 1),
  filled AS (SELECT estado, coalesce(sex, top) AS sex FROM coded JOIN mode USING (estado))
SELECT estado AS "ESTADO", c.code::INT AS code, c.label, round(count(*) FILTER (WHERE sex = c.code) * 100.0::DOUBLE / count(*), 6) AS pct
FROM filled CROSS JOIN (VALUES {', '.join(f"({k}, '{v}')" for k, v in mortality.DISPLAY_LABELS["SEXO_NUM"].items())}) c(code, label) GROUP BY ALL""")
def study_sex_profile(spark, sf):
    """One of the category profiles of the distributions step, with display labels."""
    shares = study.distributions(_study(spark, sf)[1])["profile_SEXO_NUM"]
    return shares.select("ESTADO", "code", "label", r("pct"))


NUMBERED_COLUMNS = [*study.CONTINUOUS, *study.CATEGORICAL]
#: The study's numeric columns, long, with the state's median or mode (lowest on ties) in place of nulls.
STUDY_FILLED = f"""{STUDY}, numbered AS (SELECT row_id, estado, years AS "IDADE_NUM", h::DOUBLE AS "HORA_NUM", ano::DOUBLE AS "ANO_NUM",
    (CASE WHEN sexo IN ('1', 'M') THEN 1 WHEN sexo IN ('2', 'F') THEN 2 WHEN sexo IN ('0', 'I', '') THEN 0 END)::DOUBLE AS "SEXO_NUM",
    (CASE WHEN raca IN ('1', '2', '3', '4', '5') THEN raca::INT WHEN raca = 'parda' THEN 4 END)::DOUBLE AS "RACACOR_NUM",
    (CASE WHEN estciv IN ('1', '2', '3', '4', '5') THEN estciv::INT WHEN estciv = '9' THEN 0 WHEN estciv = 'casado' THEN 2 END)::DOUBLE AS "ESTCIV_NUM",
    (CASE WHEN esc IN ('1', '2', '3', '4', '5') THEN esc::INT WHEN esc IN ('0', '9') THEN 0 ELSE 4 END)::DOUBLE AS "ESC_NUM",
    (CASE WHEN lococor IN ('1', '2', '3', '4', '5') THEN lococor::INT WHEN lococor = '9' THEN 0 WHEN lococor = 'hospital' THEN 1 END)::DOUBLE AS "LOCOCOR_NUM"
    FROM study),
  stacked AS (SELECT estado, variable, value FROM numbered UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(f'"{c}"' for c in NUMBERED_COLUMNS)}))),
  common AS (SELECT estado, variable, value AS top FROM (SELECT estado, variable, value, row_number() OVER (PARTITION BY estado, variable ORDER BY count(*) DESC, value) AS place
    FROM stacked WHERE value IS NOT NULL GROUP BY estado, variable, value) WHERE place = 1),
  middles AS (SELECT estado, variable, median(value) AS middle FROM stacked GROUP BY ALL),
  filled AS (SELECT estado, variable, coalesce(value, CASE WHEN variable IN ({', '.join(f"'{c}'" for c in study.CONTINUOUS)}) THEN middle ELSE top END) AS value
    FROM stacked JOIN middles USING (estado, variable) JOIN common USING (estado, variable))"""


@register(f"""WITH {STUDY_FILLED} SELECT estado AS "ESTADO", variable, count(value)::BIGINT AS n_valid, count(value) > 0 AS usable FROM stacked GROUP BY ALL""")
def study_columns(spark, sf):
    """Valid values of every numeric column and state; a column without any is flagged, not left out."""
    return study.model_columns(_study(spark, sf)[1])


@register(f"""WITH {STUDY_FILLED}, labels AS (SELECT * FROM (VALUES {', '.join(
    f"('{c}', {k}, '{v}')" for c in study.CATEGORICAL for k, v in mortality.DISPLAY_LABELS[c].items())}) l(variable, code, label)),
  ranked AS (SELECT estado, variable, value, count(*) AS c, sum(count(*)) OVER (PARTITION BY estado, variable) AS total,
    row_number() OVER (PARTITION BY estado, variable ORDER BY count(*) DESC, value) AS place FROM filled GROUP BY estado, variable, value),
  shown AS (SELECT estado, variable, label || ' (' || round(c * 100.0 / total)::INT || '%)' AS shown
    FROM ranked JOIN labels USING (variable) WHERE place = 1 AND code = value)
SELECT estado AS "ESTADO", {', '.join(f"""round(median(value) FILTER (WHERE variable = '{c}'), 1) AS "{c}" """ for c in study.CONTINUOUS)},
  {', '.join(f"""any_value(shown) FILTER (WHERE variable = '{c}') AS "{c}" """ for c in study.CATEGORICAL)}
FROM filled LEFT JOIN shown USING (estado, variable) GROUP BY estado""")
def study_summary(spark, sf):
    return study.distributions(_study(spark, sf)[1])["summary"]


@register(f"""WITH {STUDY_FILLED}, ends AS (SELECT variable, quantile_cont(value, 0.005) AS x_min, quantile_cont(value, 0.995) AS x_max FROM filled
    WHERE variable IN ({', '.join(f"'{c}'" for c in study.CONTINUOUS)}) GROUP BY variable),
  moments AS (SELECT estado, variable, stddev_samp(value) * pow(count(*), -0.2) AS bw FROM filled GROUP BY ALL HAVING min(value) < max(value)),
  counted AS (SELECT estado, variable, value, count(*) AS c FROM filled GROUP BY ALL),
  grid AS (SELECT estado, variable, bw, i, x_min + (x_max - x_min) * i / 399.0 AS x FROM moments JOIN ends USING (variable) CROSS JOIN generate_series(0, 399) t(i)),
  raw AS (SELECT estado, variable, i, x, sum(c * exp(-((x - value) / bw) * ((x - value) / bw) / 2)) AS raw
    FROM grid JOIN counted USING (estado, variable) GROUP BY ALL)
SELECT estado AS "ESTADO", variable, i::INT AS i, round(x, 6) AS x, round(raw / max(raw) OVER (PARTITION BY estado, variable), 6) AS density FROM raw""")
def study_density(spark, sf):
    """Density of age, hour and year per state on one grid per variable."""
    curves = study.distributions(_study(spark, sf)[1])["density"]
    return curves.withColumns({"x": r("x"), "density": r("density")})


@register()
def study_hopkins(spark, sf):
    return study.hopkins(_study(spark, sf)[1])


@register()
def mortality_typology(spark, sf):
    """The study from the files on with K-Means over all states: profiles and resampled stability, read from the store."""
    store = ResultStore(scratch_path(spark, "mortality"), "ESTADO")
    rows = mortality.categorise(_study(spark, sf)[1])
    typology.run_typology(rows, mortality.mortality_spec(dbf.RECORD), {"KMeans": typology.run_kmeans}, store)
    stable = store.read(spark, "stability").select("ESTADO", "algorithm", "mean_ari", "reading")
    return store.read(spark, "profile").join(stable, ["ESTADO", "algorithm"], "left")


@register()
def study_row_labels(spark, sf):
    """Every record of the ingested files with its K-Means label."""
    kept, spec = _study(spark, sf)[1], mortality.mortality_spec(dbf.RECORD)
    rows = mortality.categorise(kept)
    solutions = typology.run_typology(rows, spec, {"KMeans": typology.run_kmeans})
    return typology.row_labels(rows, spec, solutions["KMeans"])


@register("""SELECT event_type, CASE WHEN hour(ts) < 6 THEN 'madrugada' WHEN hour(ts) < 12 THEN 'manha' WHEN hour(ts) < 18 THEN 'tarde'
  ELSE 'noite' END AS turn, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def hour_shift(spark, sf):
    events = table(spark, sf, "events")
    turn = mortality.shift(F.hour("ts").cast("double")).alias("turn")
    return events.groupBy("event_type", turn).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT event_type, CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS level,
  count(*)::BIGINT AS n FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY ALL""")
def value_band(spark, sf):
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    level = band(value, [(10, "low"), (60, "mid")], "high", "none").alias("level")
    return table(spark, sf, "events").groupBy("event_type", level).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- quality


def _patchy(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    segment = F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 11 == 0, F.lit("  ")).when(
        key % 13 == 0, F.lit("NaN")
    ).otherwise(F.col("c_mktsegment"))
    return order_profiles(spark, sf).withColumn("segment", segment)


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.quality_report(
        _patchy(spark, sf),
        GROUP,
        {"o_orderpriority": ["4-NOT SPECIFIED", "5-LOW"], "segment": ["HOUSEHOLD"], "o_orderstatus": []},
        {"price": (F.col("o_totalprice") < 20000) | (F.col("o_totalprice") > 480000)},
        digits=PLACES,
    )
    return report


QUALITY = f"""{ORD}, patchy AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  '
    WHEN o_orderkey % 13 = 0 THEN 'NaN' ELSE c_mktsegment END AS segment FROM ord), quality AS (
  SELECT r_name, count(*)::BIGINT AS n, 0.0::DOUBLE AS o_orderpriority_missing,
    round(avg((o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW'))::INT) * 100, 6) AS o_orderpriority_ignored,
    round(avg((segment IS NULL OR lower(trim(segment)) IN ('', 'nan'))::INT) * 100, 6) AS segment_missing,
    round(avg((coalesce(segment, '') = 'HOUSEHOLD')::INT) * 100, 6) AS segment_ignored,
    0.0::DOUBLE AS o_orderstatus_missing, 0.0::DOUBLE AS o_orderstatus_ignored,
    round(avg((o_totalprice < 20000 OR o_totalprice > 480000)::INT) * 100, 6) AS price_invalid
  FROM patchy GROUP BY r_name), report AS (
  SELECT *, round(o_orderpriority_missing + o_orderpriority_ignored, 6) AS o_orderpriority_total,
    round(segment_missing + segment_ignored, 6) AS segment_total,
    round(o_orderstatus_missing + o_orderstatus_ignored, 6) AS o_orderstatus_total FROM quality), stacked AS (
  SELECT r_name, 'o_orderpriority' AS variable, o_orderpriority_total AS pct FROM report UNION ALL
  SELECT r_name, 'segment', segment_total FROM report UNION ALL SELECT r_name, 'o_orderstatus', o_orderstatus_total FROM report
  UNION ALL SELECT r_name, 'price', price_invalid FROM report)"""


@register(f"WITH {QUALITY} SELECT * FROM report")
def quality_report(spark, sf):
    return _quality(spark, sf)


@register(f"WITH {QUALITY} SELECT r_name, variable, pct, CASE WHEN pct > 30 THEN 'high' ELSE 'moderate' END AS severity FROM stacked WHERE pct > 15")
def quality_alerts(spark, sf):
    return quality.quality_alerts(_quality(spark, sf), GROUP)


@register(f"WITH {QUALITY} SELECT variable, round(avg(pct), 5) AS mean_pct FROM stacked GROUP BY variable")
def quality_means(spark, sf):
    return quality.quality_means(_quality(spark, sf), GROUP).select("variable", F.round("mean_pct", 5).alias("mean_pct"))


# ---------------------------------------------------------------- features and descriptions


@register(f"""WITH {CODED} SELECT r_name, o_orderkey, pb::DOUBLE / max(pb) OVER (PARTITION BY r_name) AS price_band,
  {", ".join(f'(pri = {i})::INT::DOUBLE AS "o_orderpriority={p}"' for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))},
  {", ".join(f'(sta = {i})::INT::DOUBLE AS "o_orderstatus={p}"' for i, p in enumerate("FOP"))},
  {", ".join(f'(seg = {i})::INT::DOUBLE AS "c_mktsegment={p}"' for i, p in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))}
FROM coded""")
def feature_table_rows(spark, sf):
    return feature_table(order_profiles(spark, sf), ORDERS)


@register(f"""WITH {VECTORS} SELECT r_name, vid, pri AS o_orderpriority_code, sta AS o_orderstatus_code, seg AS c_mktsegment_code,
  pb AS price_band_code, w, first_row, n, top AS price_band_scale, round(pb / top, 6) AS price_band_scaled FROM v""")
def distinct_vector_table(spark, sf):
    return distinct_vectors(order_profiles(spark, sf), ORDERS).withColumn("price_band_scaled", r("price_band_scaled"))


def _event_measures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(F.col("value") <= 150, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 9 != 0, F.hour("ts").cast("double")).alias("hour"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 5).cast("double").alias("bucket"),
    )


EVENTS = """measures AS (SELECT event_id, event_type, CASE WHEN value <= 150 THEN value END AS value,
    CASE WHEN event_id % 9 <> 0 THEN hour(ts)::DOUBLE END AS hour,
    CASE WHEN event_id % 11 <> 0 THEN (user_id % 5)::DOUBLE END AS bucket FROM events),
  middle AS (SELECT event_type, median(value) AS value_mid, median(hour) AS hour_mid FROM measures GROUP BY event_type),
  tops AS (SELECT event_type, bucket AS bucket_top, c AS top_rows FROM (SELECT event_type, bucket, count(*) AS c,
      row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, bucket) AS place
      FROM measures WHERE bucket IS NOT NULL GROUP BY event_type, bucket) WHERE place = 1),
  filled AS (SELECT event_id, event_type, coalesce(value, value_mid) AS value, coalesce(hour, hour_mid) AS hour,
      coalesce(bucket, bucket_top) AS bucket
    FROM measures JOIN middle USING (event_type) JOIN tops USING (event_type))"""


def _z(c: str) -> str:
    return (
        f"round(({c} - avg({c}) OVER (PARTITION BY event_type)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY event_type) = 0 "
        f"THEN 1 ELSE stddev_pop({c}) OVER (PARTITION BY event_type) END, 6) AS {c}_z"
    )


@register(f"""WITH {EVENTS} SELECT event_id, event_type, value, hour, bucket, {_z("value")}, {_z("hour")}, {_z("bucket")} FROM filled""")
def impute_scale(spark, sf):
    filled = describe.impute(_event_measures(spark, sf), "event_type", ["value", "hour"], ["bucket"])
    scaled = describe.standardise(filled, "event_type", ["value", "hour", "bucket"])
    return scaled.select("event_id", "event_type", "value", "hour", "bucket", r("value_z"), r("hour_z"), r("bucket_z"))


BUCKETS = {0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}


@register(f"""WITH {EVENTS}, shares AS (SELECT event_type, bucket, count(*) AS c, sum(count(*)) OVER (PARTITION BY event_type) AS total,
    row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, bucket) AS place FROM filled GROUP BY event_type, bucket)
SELECT event_type, round(median(value), 3) AS value, round(median(hour), 3) AS hour,
  any_value((['zero', 'one', 'two', 'three', 'four'])[bucket_m::INT + 1] || ' (' || round(c * 100.0 / total)::INT || '%)') AS bucket
FROM filled JOIN (SELECT event_type, bucket AS bucket_m, c, total FROM shares WHERE place = 1) USING (event_type) GROUP BY event_type""")
def group_summary(spark, sf):
    filled = describe.impute(_event_measures(spark, sf), "event_type", ["value", "hour"], ["bucket"])
    return describe.group_summary(filled, "event_type", ["value", "hour"], ["bucket"], {"bucket": BUCKETS}, digits=3)


@register(f"""WITH {EVENTS}, named AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS code, unnest(['zero', 'one', 'two', 'three', 'four', 'five']) AS label)
SELECT event_type, code, label, round(sum((bucket = code)::INT) * 100.0 / count(*), 6)::DOUBLE AS pct FROM filled CROSS JOIN named GROUP BY ALL""")
def category_profile(spark, sf):
    filled = describe.impute(_event_measures(spark, sf), "event_type", [], ["bucket"])
    return describe.category_shares(filled, "event_type", "bucket", BUCKETS).withColumn("pct", r("pct"))


@register(f"""WITH {EVENTS}, ends AS (SELECT quantile_cont(value, 0.005) AS x_min, quantile_cont(value, 0.995) AS x_max FROM filled),
  moments AS (SELECT event_type, stddev_samp(value) * pow(count(*), -0.2) AS bw FROM filled GROUP BY event_type),
  counted AS (SELECT event_type, value, count(*) AS c FROM filled GROUP BY ALL),
  grid AS (SELECT event_type, bw, i, x_min + (x_max - x_min) * i / 399.0 AS x FROM moments CROSS JOIN ends CROSS JOIN generate_series(0, 399) t(i)),
  raw AS (SELECT g.event_type, i, x, sum(c * exp(-((x - value) / bw) * ((x - value) / bw) / 2)) AS raw
    FROM grid g JOIN counted USING (event_type) GROUP BY ALL)
SELECT event_type, 'value' AS variable, i::INT AS i, round(x, 6) AS x, round(raw / max(raw) OVER (PARTITION BY event_type), 6) AS density FROM raw""")
def kde_curve(spark, sf):
    filled = describe.impute(_event_measures(spark, sf), "event_type", ["value"], [])
    return describe.density_curves(filled, "event_type", ["value"]).withColumns({"x": r("x"), "density": r("density")})


@register(f"""WITH {EVENTS}, probs AS (SELECT unnest([0.005, 0.5, 0.7, 0.85, 0.9, 0.995])::DOUBLE AS prob),
  stacked AS (SELECT 'value' AS variable, value AS x FROM measures UNION ALL SELECT 'hour', hour FROM measures),
  vals AS (SELECT variable, quantile_cont(x, [0.005, 0.5, 0.7, 0.85, 0.9, 0.995]) AS q FROM stacked GROUP BY variable)
SELECT variable, unnest([0.005, 0.5, 0.7, 0.85, 0.9, 0.995])::DOUBLE AS prob, round(unnest(q), 6) AS value FROM vals""")
def pooled_percentiles(spark, sf):
    counts = describe.value_counts(_event_measures(spark, sf), "event_type", ["value", "hour"])
    found = describe.pooled_percentiles(counts, (0.005, 0.5, 0.7, 0.85, 0.9, 0.995))
    return found.select("variable", "prob", r("value"))


@register("SELECT event_type, 0.5::DOUBLE AS prob, round(median(value), 6) AS value FROM events GROUP BY event_type")
def group_median(spark, sf):
    return grouped_quantiles(table(spark, sf, "events"), ["event_type"], "value", (0.5,), window_rows=100).select(
        "event_type", "prob", r("value")
    )


# ---------------------------------------------------------------- tendency


HOPKINS = f"""{FINE_VECTORS}, units AS (SELECT r_name, any_value(n) AS n, least(150, greatest(10, any_value(n) // 3))::BIGINT AS m FROM v GROUP BY r_name),
  runs AS (SELECT units.*, run FROM units CROSS JOIN generate_series(0, 9) t(run) WHERE n > m),
  floyd AS (SELECT r_name, run, n, m, 0::BIGINT AS i, []::BIGINT[] AS have FROM runs
    UNION ALL SELECT r_name, run, n, m, i, list_append(have, CASE WHEN list_contains(have, spot) THEN n - m + i ELSE spot END) FROM (
      SELECT r_name, run, n, m, have, i, floor({sql_uniform("'42'", "'row'", "r_name", "run", "i")} * (n - m + i))::BIGINT + 1 AS spot
      FROM (SELECT * REPLACE (i + 1 AS i) FROM floyd WHERE i < m))),
  picked AS (SELECT r_name, run, unnest(have) AS position FROM floyd WHERE i = m),
  axis AS (SELECT v.*, sum(w) OVER (PARTITION BY r_name ORDER BY vid) AS upto FROM v),
  taken AS (SELECT p.r_name, run, vid, count(*) AS taken FROM picked p JOIN axis a ON p.r_name = a.r_name AND position > upto - w AND position <= upto GROUP BY ALL),
  rest AS (SELECT v.r_name, r.run, v.vid, pri, sta, seg, pb, top, w, coalesce(taken, 0) AS taken FROM v JOIN runs r USING (r_name)
    LEFT JOIN taken t ON t.r_name = v.r_name AND t.run = r.run AND t.vid = v.vid),
  near AS (SELECT a.r_name, a.run, a.vid, a.taken, min((CASE WHEN a.pri = b.pri THEN 0 WHEN a.pri = -1 OR b.pri = -1 THEN 1 ELSE 2 END
      + CASE WHEN a.sta = b.sta THEN 0 ELSE 2 END + CASE WHEN a.seg = b.seg THEN 0 ELSE 2 END) + pow((a.pb - b.pb) / a.top, 2)) AS sq
    FROM rest a JOIN rest b ON a.r_name = b.r_name AND a.run = b.run AND b.w > b.taken WHERE a.taken > 0 GROUP BY ALL),
  real AS (SELECT r_name, run, sum(taken * sqrt(sq)) AS real FROM near GROUP BY ALL),
  box AS (SELECT r_name, [{", ".join(f"min({c})" for c in ("(pri = 0)::INT", "(pri = 1)::INT", "(pri = 2)::INT", "(pri = 3)::INT", "(sta = 0)::INT", "(sta = 1)::INT", "(sta = 2)::INT", "(seg = 0)::INT", "(seg = 1)::INT", "(seg = 2)::INT", "(seg = 3)::INT", "(seg = 4)::INT", "pb / top"))}]::DOUBLE[] AS low,
      [{", ".join(f"max({c})" for c in ("(pri = 0)::INT", "(pri = 1)::INT", "(pri = 2)::INT", "(pri = 3)::INT", "(sta = 0)::INT", "(sta = 1)::INT", "(sta = 2)::INT", "(seg = 0)::INT", "(seg = 1)::INT", "(seg = 2)::INT", "(seg = 3)::INT", "(seg = 4)::INT", "pb / top"))}]::DOUBLE[] AS high FROM v GROUP BY r_name),
  dims AS (SELECT r.r_name, run, i, j, low[j + 1] + {sql_uniform("'42'", "'box'", "r.r_name", "run", "i", "j")} * (high[j + 1] - low[j + 1]) AS p
    FROM runs r JOIN box USING (r_name), unnest(generate_series(1, m)) t(i), unnest(generate_series(0, 12)) s(j)),
  points AS (SELECT r_name, run, i, list(p ORDER BY j) AS p, sum(CASE WHEN j < 12 THEN p * p ELSE 0 END) AS norm FROM dims GROUP BY ALL),
  gaps AS (SELECT r.r_name, r.run, i, min(norm + CASE WHEN pri >= 0 THEN 1 - 2 * p[pri + 1] ELSE 0 END + (1 - 2 * p[sta + 5]) + (1 - 2 * p[seg + 8])
      + pow(pb / top - p[13], 2)) AS sq FROM rest r JOIN points q ON r.r_name = q.r_name AND r.run = q.run WHERE w > taken GROUP BY ALL),
  random AS (SELECT r_name, run, sum(sqrt(sq)) AS random FROM gaps GROUP BY ALL),
  h AS (SELECT r_name, run::INT AS run, random / (random + real) AS h FROM random JOIN real USING (r_name, run))"""


@register(f"WITH RECURSIVE {HOPKINS} SELECT r_name, run, round(h, 6) AS h FROM h")
def hopkins(spark, sf):
    vectors = vector_table(fine_order_profiles(spark, sf), FINE_ORDERS)
    return tendency.hopkins_runs(vectors, FINE_ORDERS).select(GROUP, "run", r("h"))


@register(f"""WITH RECURSIVE {HOPKINS} SELECT r_name, round(avg(h), 6) AS mean_h, round(stddev_pop(h), 6) AS std_h,
  CASE WHEN avg(h) >= 0.75 THEN 'strong' WHEN avg(h) >= 0.6 THEN 'moderate' WHEN avg(h) >= 0.5 THEN 'weak' ELSE 'random' END AS reading
FROM h GROUP BY r_name""")
def hopkins_summary(spark, sf):
    vectors = vector_table(fine_order_profiles(spark, sf), FINE_ORDERS)
    summary = tendency.hopkins_summary(tendency.hopkins_runs(vectors, FINE_ORDERS), GROUP)
    return summary.select(GROUP, r("mean_h"), r("std_h"), "reading")


@register(f"""WITH RECURSIVE {HOPKINS}, rounded AS (SELECT r_name, round(h, 9) AS h FROM h),
  ends AS (SELECT r_name, min(h) - CASE WHEN min(h) = max(h) THEN 0.5 ELSE 0 END AS lo,
    max(h) + CASE WHEN min(h) = max(h) THEN 0.5 ELSE 0 END AS hi FROM rounded GROUP BY r_name)
SELECT ends.r_name, b::INT AS bin, count(h)::BIGINT AS cnt FROM ends CROSS JOIN generate_series(1, 8) t(b)
LEFT JOIN rounded ON rounded.r_name = ends.r_name AND least(floor((h - lo) / (hi - lo) * 8) + 1, 8) = b GROUP BY ALL""")
def hopkins_histogram(spark, sf):
    vectors = vector_table(fine_order_profiles(spark, sf), FINE_ORDERS)
    runs = materialise(
        tendency.hopkins_runs(vectors, FINE_ORDERS).select(GROUP, F.round("h", 9).alias("h")), "hopkins-runs"
    )
    return tendency.histogram(runs, GROUP, "h")


# ---------------------------------------------------------------- partition metrics on given labels


KEYS = [GROUP, "algorithm"]

SILHOUETTE_OF = """sizes AS (SELECT r_name, algorithm, label, sum(w) AS size FROM labels_of WHERE label >= 0 GROUP BY ALL),
  toward AS (SELECT a.r_name, a.algorithm, a.vid, a.label, a.w, b.label AS other, sum(d.apart * d.w_b) AS apart
    FROM labels_of a JOIN d ON d.r_name = a.r_name AND d.vid = a.vid
    JOIN labels_of b ON b.r_name = a.r_name AND b.vid = d.vid_b AND b.algorithm = a.algorithm
    WHERE a.label >= 0 AND b.label >= 0 GROUP BY ALL),
  ab AS (SELECT r_name, algorithm, vid, label, w, max(CASE WHEN other = label THEN size END) AS size,
      max(CASE WHEN other = label THEN apart END) AS inside, min(CASE WHEN other <> label THEN apart / size END) AS b
    FROM toward JOIN (SELECT r_name, algorithm, label AS other, size FROM sizes) USING (r_name, algorithm, other) GROUP BY ALL),
  silhouette AS (SELECT r_name, algorithm, sum(w * CASE WHEN size = 1 OR greatest(inside / greatest(size - 1, 1), b) = 0 THEN 0
      ELSE (b - inside / (size - 1)) / greatest(inside / (size - 1), b) END) / sum(w) AS silhouette FROM ab GROUP BY ALL)"""

CENTRES_OF = f"""{FEATURES},
  spread AS (SELECT r_name, algorithm, label, sum(w * dist) / sum(w) AS s FROM (
      SELECT l.r_name, l.algorithm, l.label, l.vid, any_value(l.w) AS w, sqrt(sum((xj - c) * (xj - c))) AS dist
      FROM long l JOIN centre USING (r_name, algorithm, label, j) GROUP BY l.r_name, l.algorithm, l.label, l.vid) GROUP BY ALL),
  gap AS (SELECT a.r_name, a.algorithm, a.label, b.label AS other, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS gap
    FROM centre a JOIN centre b ON a.r_name = b.r_name AND a.algorithm = b.algorithm AND a.j = b.j AND a.label <> b.label GROUP BY ALL)"""


SILHOUETTE = f"{PAIRS}, {LABELS}, {SILHOUETTE_OF}"
CENTRES = f"{VECTORS}, {LABELS}, {CENTRES_OF}"
BOULDIN_OF = """bouldin AS (SELECT r_name, algorithm, avg(worst) AS davies_bouldin, min(nearest) AS min_gap FROM (
    SELECT g.r_name, g.algorithm, g.label, max(CASE WHEN gap > 0 THEN (a.s + b.s) / gap ELSE 0 END) AS worst, min(gap) AS nearest FROM gap g
    JOIN spread a ON a.r_name = g.r_name AND a.algorithm = g.algorithm AND a.label = g.label
    JOIN spread b ON b.r_name = g.r_name AND b.algorithm = g.algorithm AND b.label = g.other GROUP BY ALL) GROUP BY ALL)"""
WIDE_OF = """wide AS (SELECT a.r_name, a.algorithm, max(d.dist) AS diameter FROM labels_of a
    JOIN d ON d.r_name = a.r_name AND d.vid = a.vid
    JOIN labels_of b ON b.r_name = a.r_name AND b.vid = d.vid_b AND b.algorithm = a.algorithm AND b.label = a.label
    WHERE a.label >= 0 GROUP BY ALL)"""
SIZES_OF = """shares AS (SELECT r_name, algorithm, sum((label >= 0)::INT)::BIGINT AS n_clusters,
    sum(CASE WHEN label < 0 THEN size ELSE 0 END)::BIGINT AS n_noise,
    sum(CASE WHEN label < 0 THEN size ELSE 0 END) * 100.0::DOUBLE / sum(size) AS pct_noise,
    min(CASE WHEN label >= 0 THEN size END) * 100.0::DOUBLE / sum(size) AS min_cluster_pct,
    sum((label >= 0)::INT) >= 2 AND sum(CASE WHEN label >= 0 THEN size END) >= 20 AS scored
  FROM (SELECT r_name, algorithm, label, sum(w) AS size FROM labels_of GROUP BY ALL) GROUP BY ALL)"""
#: The sweep table of any labels_of: sizes, and the three quality numbers where there are two clusters and 20 rows.
REPORT_OF = f"""{SILHOUETTE_OF}, {CENTRES_OF}, {BOULDIN_OF}, {WIDE_OF}, {SIZES_OF},
  report AS (SELECT r_name, algorithm, n_clusters, n_noise, round(pct_noise, 2) AS pct_noise, round(min_cluster_pct, 2) AS min_cluster_pct,
    CASE WHEN scored THEN round(silhouette, 4) END AS silhouette, CASE WHEN scored THEN round(davies_bouldin, 4) END AS davies_bouldin,
    CASE WHEN scored THEN round(CASE WHEN diameter > 0 THEN min_gap / diameter ELSE 0 END, 4) END AS dunn
  FROM shares LEFT JOIN silhouette USING (r_name, algorithm) LEFT JOIN bouldin USING (r_name, algorithm) LEFT JOIN wide USING (r_name, algorithm))"""


def _given(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return vectors, given_members(vectors)


@register(f"WITH {SILHOUETTE} SELECT r_name, algorithm, round(silhouette, 6) AS silhouette FROM silhouette")
def silhouette_hamming(spark, sf):
    vectors, members = _given(spark, sf)
    coded = metrics.coded_members(members, vectors, ORDERS, KEYS)
    counts = metrics.cluster_counts(coded, ORDERS, KEYS)
    return metrics.silhouette(coded, counts, ORDERS, KEYS).select(*KEYS, r("silhouette"))


@register(f"""WITH {CENTRES} SELECT r_name, algorithm, round(avg(worst), 6) AS davies_bouldin, round(min(nearest), 6) AS min_gap FROM (
  SELECT g.r_name, g.algorithm, g.label, max((a.s + b.s) / gap) AS worst, min(gap) AS nearest FROM gap g
  JOIN spread a ON a.r_name = g.r_name AND a.algorithm = g.algorithm AND a.label = g.label
  JOIN spread b ON b.r_name = g.r_name AND b.algorithm = g.algorithm AND b.label = g.other GROUP BY ALL) GROUP BY ALL""")
def davies_bouldin(spark, sf):
    vectors, members = _given(spark, sf)
    coded = metrics.coded_members(members, vectors, ORDERS, KEYS)
    counts = metrics.cluster_counts(coded, ORDERS, KEYS)
    found = metrics.davies_bouldin_and_gap(coded, counts, ORDERS, KEYS)
    return found.select(*KEYS, r("davies_bouldin"), r("min_gap"))


@register(f"""WITH {PAIRS}, {LABELS}, {FEATURES}, gap AS (SELECT r_name, algorithm, min(gap) AS gap FROM (
    SELECT a.r_name, a.algorithm, a.label, b.label AS other, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS gap FROM centre a
    JOIN centre b ON a.r_name = b.r_name AND a.algorithm = b.algorithm AND a.j = b.j AND a.label < b.label GROUP BY ALL) GROUP BY ALL),
  wide AS (SELECT a.r_name, a.algorithm, max(d.dist) AS diameter FROM labels_of a
    JOIN d ON d.r_name = a.r_name AND d.vid = a.vid
    JOIN labels_of b ON b.r_name = a.r_name AND b.vid = d.vid_b AND b.algorithm = a.algorithm AND b.label = a.label
    WHERE a.label >= 0 GROUP BY ALL)
SELECT r_name, algorithm, round(gap / diameter, 6) AS dunn FROM gap JOIN wide USING (r_name, algorithm)""")
def dunn(spark, sf):
    vectors, members = _given(spark, sf)
    return metrics.cluster_quality(members, vectors, ORDERS, KEYS, digits=PLACES).select(*KEYS, "dunn")


@register(f"""WITH {VECTORS}, {LABELS}, s AS (SELECT r_name, algorithm, label, sum(w) AS size FROM labels_of GROUP BY ALL)
SELECT r_name, algorithm, sum((label >= 0)::INT)::BIGINT AS n_clusters, sum(CASE WHEN label < 0 THEN size ELSE 0 END)::BIGINT AS n_noise,
  round(sum(CASE WHEN label < 0 THEN size ELSE 0 END) * 100.0::DOUBLE / sum(size), 6) AS pct_noise,
  round(min(CASE WHEN label >= 0 THEN size END) * 100.0::DOUBLE / sum(size), 6) AS min_cluster_pct FROM s GROUP BY ALL""")
def partition_sizes(spark, sf):
    _, members = _given(spark, sf)
    return metrics.partition_sizes(members, KEYS, digits=PLACES)


@register(f"""WITH {VECTORS}, {LABELS} SELECT a.r_name, a.label::INT AS label_a, b.label::INT AS label_b, sum(a.w)::BIGINT AS cnt FROM labels_of a
  JOIN labels_of b ON a.r_name = b.r_name AND a.vid = b.vid WHERE a.algorithm = 'status' AND b.algorithm = 'segment' GROUP BY ALL""")
def label_contingency(spark, sf):
    _, members = _given(spark, sf)
    members = materialise(members, "given")
    return metrics.contingency(
        members.filter("algorithm = 'status'"), members.filter("algorithm = 'segment'"), [GROUP], "vid"
    )


def _ari_sql(source: str, a: str, b: str) -> str:
    return f"""WITH cells AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS c FROM {source} GROUP BY ALL),
  t AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS agree FROM cells),
  ra AS (SELECT sum(s * (s - 1) / 2) AS x FROM (SELECT sum(c) AS s FROM cells GROUP BY a)),
  rb AS (SELECT sum(s * (s - 1) / 2) AS y FROM (SELECT sum(c) AS s FROM cells GROUP BY b))
SELECT 'all' AS part, n::BIGINT AS n_points, round((agree - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM t, ra, rb"""


def _ari(df: DataFrame, a, b) -> DataFrame:
    cells = df.groupBy(F.lit("all").alias("part"), a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    return metrics.adjusted_rand(cells, ["part"], "a", "b").select("part", "n_points", r("ari"))


@register(_ari_sql("documents", "lang", "source"))
def ari_documents(spark, sf):
    return _ari(table(spark, sf, "documents"), F.col("lang"), F.col("source"))


@register(_ari_sql("embeddings", "label", "(embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT"))
def ari_embeddings(spark, sf):
    bucket = (F.col("embedding")[0] > 0).cast("int") * 2 + (F.col("embedding")[1] > 0).cast("int")
    return _ari(table(spark, sf, "embeddings"), F.col("label"), bucket)


PROFILE = f"""{VECTORS}, {LABELS}, stacked AS (
  SELECT r_name, algorithm, label, w, 'o_orderpriority' AS variable, coalesce((['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'])[pri + 1], '4-NOT SPECIFIED') AS value FROM labels_of
  UNION ALL SELECT r_name, algorithm, label, w, 'o_orderstatus', (['F', 'O', 'P'])[sta + 1] FROM labels_of
  UNION ALL SELECT r_name, algorithm, label, w, 'c_mktsegment', (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[seg + 1] FROM labels_of
  UNION ALL SELECT r_name, algorithm, label, w, 'price_band', 'p' || pb FROM labels_of),
  c AS (SELECT r_name, algorithm, label, variable, value, sum(w)::DOUBLE AS c FROM stacked GROUP BY ALL),
  k AS (SELECT *, sum(c) OVER (PARTITION BY r_name, algorithm, label, variable) AS n, sum(c) OVER (PARTITION BY r_name, algorithm, variable) AS total,
    sum(c) OVER (PARTITION BY r_name, algorithm, variable, value) AS vt,
    row_number() OVER (PARTITION BY r_name, algorithm, label, variable ORDER BY c DESC, value) AS place FROM c)"""


@register(f"""WITH {PROFILE} SELECT r_name, algorithm, label::INT AS label, n::BIGINT AS n, round(n * 100 / total, 6) AS pct, variable,
  value AS top_value, round(c / n * 100, 6) AS top_pct, round((c / n) / (vt / total), 6) AS lift FROM k WHERE place = 1""")
def profile_with_lift(spark, sf):
    vectors, members = _given(spark, sf)
    return cluster_profile(members, vectors, ORDERS, KEYS, digits=(PLACES, PLACES, PLACES))


@register(f"""WITH {PROFILE}, named AS (SELECT r_name, algorithm, label::INT AS label, CASE WHEN label < 0 THEN 'Ruído' ELSE 'Cluster ' || label END AS cluster,
    n::BIGINT AS n, round(n * 100 / total, 6) AS pct, variable, value, round((c / n) / (vt / total), 6) AS lift FROM k WHERE place = 1)
SELECT r_name, algorithm, label, cluster, n, pct, max(CASE WHEN variable = 'o_orderstatus' THEN value END) AS status_top,
  max(CASE WHEN variable = 'o_orderstatus' THEN lift END) AS status_lift, max(CASE WHEN variable = 'c_mktsegment' THEN value END) AS segment_top,
  max(CASE WHEN variable = 'c_mktsegment' THEN lift END) AS segment_lift FROM named GROUP BY ALL""")
def profile_wide(spark, sf):
    vectors, members = _given(spark, sf)
    wide = wide_profile(cluster_profile(members, vectors, ORDERS, KEYS, digits=(PLACES, PLACES, PLACES)), ORDERS, KEYS)

    def value(name: str):
        return F.regexp_replace(name, r" \(\d+%\)$", "")

    return wide.select(
        *KEYS, "label", "cluster", "n", "pct", value("o_orderstatus_top").alias("status_top"),
        F.col("o_orderstatus_lift").alias("status_lift"), value("c_mktsegment_top").alias("segment_top"),
        F.col("c_mktsegment_lift").alias("segment_lift"),
    )


AGREEMENT = f"""{VECTORS}, {LABELS}, pairs AS (SELECT a.r_name, a.algorithm AS algorithm_a, b.algorithm AS algorithm_b, a.label AS la, b.label AS lb, sum(a.w)::DOUBLE AS c
    FROM labels_of a JOIN labels_of b ON a.r_name = b.r_name AND a.vid = b.vid WHERE a.label >= 0 AND b.label >= 0 GROUP BY ALL),
  named AS (SELECT * FROM pairs WHERE (algorithm_a, algorithm_b) IN (('status', 'segment'), ('status', 'band'), ('segment', 'band'))),
  t AS (SELECT r_name, algorithm_a, algorithm_b, sum(c) AS n, sum(c * (c - 1) / 2) AS agree FROM named GROUP BY ALL),
  ra AS (SELECT r_name, algorithm_a, algorithm_b, sum(s * (s - 1) / 2) AS x FROM (SELECT r_name, algorithm_a, algorithm_b, la, sum(c) AS s FROM named GROUP BY ALL) GROUP BY ALL),
  rb AS (SELECT r_name, algorithm_a, algorithm_b, sum(s * (s - 1) / 2) AS y FROM (SELECT r_name, algorithm_a, algorithm_b, lb, sum(c) AS s FROM named GROUP BY ALL) GROUP BY ALL),
  agreed AS (SELECT r_name, algorithm_a, algorithm_b, n::BIGINT AS n_points,
      (agree - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)) AS ari
    FROM t JOIN ra USING (r_name, algorithm_a, algorithm_b) JOIN rb USING (r_name, algorithm_a, algorithm_b))"""


def _agreement(spark: SparkSession, sf: str) -> DataFrame:
    _, members = _given(spark, sf)
    return agreement(members, GROUP, "vid", ["status", "segment", "band"])


@register(f"WITH {AGREEMENT} SELECT r_name, algorithm_a, algorithm_b, n_points, round(ari, 6) AS ari, TRUE AS aligned FROM agreed")
def agreement_table(spark, sf):
    return _agreement(spark, sf).withColumn("ari", r("ari"))


@register(f"""WITH {AGREEMENT} SELECT r_name, round(max(CASE WHEN algorithm_a = 'status' AND algorithm_b = 'segment' THEN ari END), 6) AS status_vs_segment,
  round(max(CASE WHEN algorithm_a = 'status' AND algorithm_b = 'band' THEN ari END), 6) AS status_vs_band,
  round(max(CASE WHEN algorithm_a = 'segment' AND algorithm_b = 'band' THEN ari END), 6) AS segment_vs_band FROM agreed GROUP BY r_name""")
def agreement_wide(spark, sf):
    names = ["status", "segment", "band"]
    wide = agreement_matrix(_agreement(spark, sf), GROUP, names)
    return wide.select(GROUP, *[r(c) for c in wide.columns if c != GROUP])


@register(f"""WITH {AGREEMENT} SELECT algorithm_a, algorithm_b, round(avg(ari), 6) AS mean_ari, sum((ari > 0.3)::INT)::BIGINT AS moderate_groups,
  CASE WHEN avg(ari) > 0.3 THEN 'moderate' ELSE 'low' END AS reading FROM agreed GROUP BY ALL""")
def agreement_summary(spark, sf):
    return pair_summary(_agreement(spark, sf)).withColumn("reading", agreement_reading(F.col("mean_ari"))).withColumn(
        "mean_ari", r("mean_ari")
    )


# ---------------------------------------------------------------- selection rules on tables derived from the data


@register(f"""WITH {ORD}, curve AS (SELECT r_name, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS revenue FROM ord GROUP BY ALL)
SELECT r_name, year, revenue, round(revenue - lag(revenue) OVER w, 2) AS diff1, round(lead(revenue) OVER w - 2 * revenue + lag(revenue) OVER w, 2) AS diff2
FROM curve WINDOW w AS (PARTITION BY r_name ORDER BY year)""")
def curve_differences(spark, sf):
    found = selection.curve_differences(_revenue(spark, sf), [GROUP], "year", "revenue")
    return found.select(GROUP, "year", "revenue", F.round("diff1", 2).alias("diff1"), F.round("diff2", 2).alias("diff2"))


def _revenue(spark: SparkSession, sf: str) -> DataFrame:
    return order_profiles(spark, sf).groupBy(GROUP, F.year("o_orderdate").alias("year")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


BENDS = f"""{ORD}, curve AS (SELECT r_name, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS revenue FROM ord GROUP BY ALL),
  bends AS (SELECT r_name, year, lead(revenue) OVER w - 2 * revenue + lag(revenue) OVER w AS bend FROM curve WINDOW w AS (PARTITION BY r_name ORDER BY year))"""


@register(f"""WITH {BENDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY abs(bend) DESC, year) AS a,
    row_number() OVER (PARTITION BY r_name ORDER BY bend DESC, year) AS s FROM bends WHERE bend IS NOT NULL)
SELECT r_name, max(CASE WHEN a = 1 THEN year END) AS elbow, max(CASE WHEN s = 1 THEN year END) AS knee FROM ranked GROUP BY r_name""")
def elbow_and_knee(spark, sf):
    curve = _revenue(spark, sf)
    knee = selection.elbow(curve, [GROUP], "year", "revenue", absolute=False).withColumnRenamed("elbow", "knee")
    return selection.elbow(curve, [GROUP], "year", "revenue").join(knee, GROUP)


SWEEP = f"""{ORD}, sweep AS (SELECT r_name, month(o_orderdate)::INT AS k, o_orderstatus AS linkage,
    count(DISTINCT day(o_orderdate))::BIGINT % 17 AS n_clusters,
    round(avg((o_orderpriority = '4-NOT SPECIFIED')::INT) * 200, 6) AS pct_noise,
    CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(avg(o_totalprice) / 1000000, 6) END AS silhouette,
    round(avg(c_acctbal) / 1000, 6) AS davies_bouldin, round(min(o_totalprice) / 2000, 6) AS min_cluster_pct FROM ord GROUP BY ALL)"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A table shaped like a sweep report, aggregated from the orders."""
    return order_profiles(spark, sf).groupBy(
        GROUP, F.month("o_orderdate").alias("k"), F.col("o_orderstatus").alias("linkage")
    ).agg(
        (F.count_distinct(F.dayofmonth("o_orderdate")) % 17).alias("n_clusters"),
        F.round(F.avg((F.col("o_orderpriority") == "4-NOT SPECIFIED").cast("int")) * 200, PLACES).alias("pct_noise"),
        F.when(F.count(F.lit(1)) % 5 != 0, F.round(F.avg("o_totalprice") / 1_000_000, PLACES)).alias("silhouette"),
        F.round(F.avg("c_acctbal") / 1000, PLACES).alias("davies_bouldin"),
        F.round(F.min("o_totalprice") / 2000, PLACES).alias("min_cluster_pct"),
    )


K_CURVE = f"""{ORD}, curve AS (SELECT r_name, month(o_orderdate)::INT AS k, round(sum(o_totalprice), 2) AS wcss,
    CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(avg(o_totalprice) / 1000000, 6) END AS silhouette,
    round(avg(c_acctbal) / 1000, 6) AS davies_bouldin, round(max(o_totalprice) / 1000000, 6) AS dunn FROM ord GROUP BY ALL),
  ranked AS (SELECT *, lead(wcss) OVER along - 2 * wcss + lag(wcss) OVER along AS bend,
    row_number() OVER (PARTITION BY r_name ORDER BY silhouette IS NULL, -silhouette, k) AS by_silhouette,
    row_number() OVER (PARTITION BY r_name ORDER BY davies_bouldin IS NULL, davies_bouldin, k) AS by_boulding,
    row_number() OVER (PARTITION BY r_name ORDER BY dunn IS NULL, -dunn, k) AS by_dunn FROM curve WINDOW along AS (PARTITION BY r_name ORDER BY k)),
  bent AS (SELECT r_name, k FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY abs(bend) DESC, k) AS place FROM ranked WHERE bend IS NOT NULL) WHERE place = 1),
  rules AS (SELECT r.r_name, max(CASE WHEN by_silhouette = 1 THEN r.k END) AS k_silhouette, max(CASE WHEN by_boulding = 1 THEN r.k END) AS k_davies_bouldin,
    max(CASE WHEN by_dunn = 1 THEN r.k END) AS k_dunn, coalesce(max(b.k), min(r.k)) AS k_elbow FROM ranked r LEFT JOIN bent b USING (r_name) GROUP BY r.r_name)"""


def _k_curve(spark: SparkSession, sf: str) -> DataFrame:
    """A table shaped like a K sweep, aggregated from the orders by month."""
    return order_profiles(spark, sf).groupBy(GROUP, F.month("o_orderdate").alias("k")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("wcss"),
        F.when(F.count(F.lit(1)) % 5 != 0, F.round(F.avg("o_totalprice") / 1_000_000, PLACES)).alias("silhouette"),
        F.round(F.avg("c_acctbal") / 1000, PLACES).alias("davies_bouldin"),
        F.round(F.max("o_totalprice") / 1_000_000, PLACES).alias("dunn"),
    )


@register(f"WITH {K_CURVE} SELECT r_name, k_elbow, k_silhouette, k_davies_bouldin, k_dunn, k_dunn AS k_adopted FROM rules")
def k_rules(spark, sf):
    """The four K rules on a given sweep table."""
    return selection.pick_k(_k_curve(spark, sf), [GROUP])


@register(f"""WITH {K_CURVE} SELECT 7::INT AS expected_k, count(*)::BIGINT AS groups, sum((k_dunn = 7)::INT)::BIGINT AS agreeing,
  sum((k_dunn = 7)::INT) * 2 >= count(*) AS holds FROM rules""")
def k_premise(spark, sf):
    return selection.premise(selection.pick_k(_k_curve(spark, sf), [GROUP]))


@register(f"WITH {K_CURVE} SELECT r_name, k_dunn FROM rules WHERE k_dunn <> 7")
def k_divergent(spark, sf):
    return selection.divergent(selection.pick_k(_k_curve(spark, sf), [GROUP]), [GROUP])


@register(f"""WITH {SWEEP}, tiered AS (SELECT *, row_number() OVER (PARTITION BY r_name, linkage ORDER BY k) - 1 AS pos,
    count(*) OVER (PARTITION BY r_name, linkage) // 2 AS mid FROM sweep), scored AS (
  SELECT *, CASE WHEN n_clusters BETWEEN 2 AND 12 AND pct_noise < 50 AND silhouette IS NOT NULL THEN 1
      WHEN n_clusters >= 2 AND pct_noise < 50 AND silhouette IS NOT NULL THEN 2 WHEN pos = mid THEN 3 ELSE 4 END AS tier FROM tiered), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r_name, linkage ORDER BY tier, CASE tier WHEN 1 THEN -silhouette WHEN 2 THEN n_clusters::DOUBLE END, k) AS place FROM scored)
SELECT r_name, linkage, k, (['best silhouette', 'fewest clusters', 'fallback'])[tier] AS rule FROM ranked WHERE place = 1""")
def solution_select(spark, sf):
    return selection.pick_density_solution(_sweep(spark, sf), [GROUP, "linkage"], "k", middle=True)


@register(f"""WITH {SWEEP}, ranked AS (SELECT *, coalesce(min_cluster_pct >= 2 AND silhouette IS NOT NULL, FALSE) AS eligible,
    row_number() OVER (PARTITION BY r_name ORDER BY (NOT coalesce(min_cluster_pct >= 2 AND silhouette IS NOT NULL, FALSE))::INT,
      silhouette DESC NULLS LAST, CASE linkage WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, k) AS place FROM sweep)
SELECT r_name, linkage, k, silhouette, eligible FROM ranked WHERE place = 1""")
def balanced_select(spark, sf):
    return selection.pick_balanced_solution(_sweep(spark, sf), [GROUP], ("P", "O", "F"))


def _norm(c: str, inverted: bool) -> str:
    share = f"({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g)"
    return f"round(CASE WHEN max({c}) OVER g = min({c}) OVER g THEN 0.5 ELSE {'1 - ' + share if inverted else share} END, 6) AS {c}_norm"


@register(f"""WITH {SWEEP} SELECT r_name, linkage, k, {_norm("silhouette", False)}, {_norm("davies_bouldin", True)} FROM sweep
WINDOW g AS (PARTITION BY r_name, linkage)""")
def metric_heatmap(spark, sf):
    found = selection.normalise_metrics(_sweep(spark, sf), [GROUP, "linkage"], ["silhouette"], ["davies_bouldin"])
    return found.select(GROUP, "linkage", "k", r("silhouette_norm"), r("davies_bouldin_norm"))


# ---------------------------------------------------------------- neighbourhoods and density clustering


@register(f"""WITH {KDIST} SELECT r_name, vid, w, n, first_row, round(dist, 6) AS dist, cnt FROM hist""")
def distance_histogram(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return neighbour_counts(vectors, ORDERS).withColumn("dist", r("dist"))


@register(f"WITH {KDIST} SELECT r_name, vid, w, n, first_row, round(kdist, 6) AS kdist FROM kd")
def k_distance(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return dbscan.k_distances(neighbour_counts(vectors, ORDERS), ORDERS).withColumn("kdist", r("kdist"))


CANDIDATES = f"""{KDIST}, uniq AS (SELECT r_name, kdist, row_number() OVER (PARTITION BY r_name ORDER BY kdist DESC) AS top,
    least(count(*) OVER (PARTITION BY r_name), 72) AS size FROM kd GROUP BY r_name, kdist),
  picks AS (SELECT DISTINCT r_name, size, floor(i::DOUBLE * (size - 1) / 17)::BIGINT AS pos FROM (SELECT DISTINCT r_name, size FROM uniq) CROSS JOIN generate_series(0, 17) t(i)),
  tail AS (SELECT u.r_name, kdist FROM uniq u JOIN picks p ON p.r_name = u.r_name AND u.top <= 72 AND p.pos = u.size - u.top),
  everyrow AS (SELECT r_name, kdist FROM kd, unnest(generate_series(1, w)) t(i)),
  context AS (SELECT r_name, unnest(quantile_cont(kdist, [0.5, 0.7, 0.85])) AS kdist FROM everyrow GROUP BY r_name),
  candidates AS (SELECT DISTINCT r_name, round(kdist, 4) AS eps FROM (SELECT * FROM tail UNION ALL SELECT * FROM context) WHERE round(kdist, 4) > 0),
  occurring AS (SELECT DISTINCT r_name, ceil(dist * 10000) / 10000 AS eps FROM hist WHERE dist > 0 AND r_name NOT IN (SELECT r_name FROM candidates)),
  smallest AS (SELECT r_name, eps FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY eps) AS place FROM occurring) WHERE place <= 18),
  allradii AS (SELECT * FROM candidates UNION ALL SELECT * FROM smallest
    UNION ALL SELECT DISTINCT r_name, 1.0::DOUBLE FROM v WHERE r_name NOT IN (SELECT r_name FROM candidates UNION ALL SELECT r_name FROM smallest))"""


@register(f"WITH {CANDIDATES} SELECT * FROM allradii")
def eps_candidates(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    counts = materialise(neighbour_counts(vectors, ORDERS), "counts")
    kdist = materialise(dbscan.k_distances(counts, ORDERS), "kdist")
    return dbscan.eps_candidates(kdist, counts, ORDERS)


@register(f"""WITH {KDIST}, curve AS (SELECT r_name, kdist, row_number() OVER (PARTITION BY r_name ORDER BY kdist) AS pos FROM kd, unnest(generate_series(1, w)) t(i)),
  bends AS (SELECT *, (lead(kdist) OVER w - kdist) - (kdist - lag(kdist) OVER w) AS bend FROM curve WINDOW w AS (PARTITION BY r_name ORDER BY pos)),
  best AS (SELECT r_name, kdist FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY bend DESC, pos) AS place FROM bends WHERE bend IS NOT NULL) WHERE place = 1),
  p90 AS (SELECT r_name, quantile_cont(kdist, 0.9) AS p90, max(kdist) AS top FROM curve GROUP BY r_name)
SELECT r_name, round(CASE WHEN kdist > 0 THEN kdist WHEN p90 > 0 THEN p90 WHEN top > 0 THEN top ELSE 1 END, 6) AS knee_eps FROM best JOIN p90 USING (r_name)""")
def knee_radius(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    kdist = materialise(dbscan.k_distances(neighbour_counts(vectors, ORDERS), ORDERS), "kdist")
    return dbscan.knee(kdist, ORDERS).select(GROUP, r("knee_eps"))


@register(f"""WITH {KDIST}, curve AS (SELECT r_name, kdist, row_number() OVER (PARTITION BY r_name ORDER BY kdist) AS pos FROM kd, unnest(generate_series(1, w)) t(i))
SELECT r_name, round(kdist, 6) AS kdist, min(pos)::BIGINT AS first_place, max(pos)::BIGINT AS last_place FROM curve GROUP BY r_name, kdist""")
def k_distance_curve(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    curve = dbscan.sorted_curve(dbscan.k_distances(neighbour_counts(vectors, ORDERS), ORDERS), ORDERS)
    return curve.withColumn("kdist", r("kdist"))


RADII = [0.25, 0.5, 1.0]
CORE_ROWS = 25


DBSCAN = """deg AS (SELECT d.r_name, eps, vid, w, first_row, sum(w_b) AS degree FROM d JOIN radii ON radii.r_name = d.r_name AND dist <= eps GROUP BY ALL),
  edges AS (SELECT d.r_name, a.eps, d.vid, d.vid_b FROM d JOIN deg a ON a.r_name = d.r_name AND a.vid = d.vid AND d.dist <= a.eps AND a.degree >= {core}
    JOIN deg b ON b.r_name = d.r_name AND b.vid = d.vid_b AND b.eps = a.eps AND b.degree >= {core}),
  reach AS (SELECT r_name, eps, vid, first_row AS label FROM deg WHERE degree >= {core}
    UNION SELECT e.r_name, e.eps, e.vid_b, reach.label FROM reach JOIN edges e ON e.r_name = reach.r_name AND e.eps = reach.eps AND e.vid = reach.vid),
  comp AS (SELECT r_name, eps, vid, min(label) AS label FROM reach GROUP BY ALL),
  numbered AS (SELECT r_name, eps, vid, dense_rank() OVER (PARTITION BY r_name, eps ORDER BY label) - 1 AS num FROM comp),
  border AS (SELECT d.r_name, n.eps, d.vid, min(num) AS num FROM d JOIN numbered n ON n.r_name = d.r_name AND n.vid = d.vid_b AND d.dist <= n.eps GROUP BY ALL),
  dblabels AS (SELECT deg.r_name, deg.eps, deg.vid, deg.w, coalesce(n.num, b.num, -1)::INT AS label FROM deg
    LEFT JOIN numbered n ON n.r_name = deg.r_name AND n.eps = deg.eps AND n.vid = deg.vid
    LEFT JOIN border b ON b.r_name = deg.r_name AND b.eps = deg.eps AND b.vid = deg.vid)"""


@register(f"""WITH RECURSIVE {PAIRS}, radii AS (SELECT DISTINCT r_name, eps FROM v, unnest({RADII}::DOUBLE[]) t(eps)), {DBSCAN.format(core=CORE_ROWS)}
SELECT * FROM dblabels""")
def dbscan_labels(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    counts = materialise(neighbour_counts(vectors, ORDERS), "counts")
    radii = vectors.select(GROUP).distinct().withColumn("eps", F.explode(F.array(*map(F.lit, RADII))))
    return dbscan.dbscan(vectors, counts, radii, ORDERS, CORE_ROWS)


@register(f"""WITH RECURSIVE {CANDIDATES}, radii AS (SELECT * FROM allradii), {DBSCAN.format(core=10)},
  labels_of AS (SELECT l.r_name, l.vid, l.w, n, pri, sta, seg, pb, top, eps::VARCHAR AS algorithm, label FROM dblabels l JOIN v ON v.r_name = l.r_name AND v.vid = l.vid),
  {REPORT_OF}
SELECT r_name, algorithm::DOUBLE AS eps, n_clusters, n_noise, pct_noise, min_cluster_pct, silhouette, davies_bouldin, dunn FROM report""")
def dbscan_sweep(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return typology.run_dbscan(vectors, ORDERS).metrics


@register(f"""WITH RECURSIVE {KDIST}, needed AS (SELECT *, least(greatest(20, floor(n * 0.01))::BIGINT + 1, n) AS k FROM cum),
  core AS (SELECT r_name, vid, w, first_row, min(dist) AS core FROM needed WHERE reached >= k GROUP BY ALL),
  inside AS (SELECT * FROM core WHERE core <= 1.0),
  edges AS (SELECT d.r_name, d.vid, d.vid_b FROM d JOIN inside a ON a.r_name = d.r_name AND a.vid = d.vid
    JOIN inside b ON b.r_name = d.r_name AND b.vid = d.vid_b WHERE dist <= 1.0),
  reach AS (SELECT r_name, vid, first_row AS label FROM inside
    UNION SELECT e.r_name, e.vid_b, reach.label FROM reach JOIN edges e ON e.r_name = reach.r_name AND e.vid = reach.vid)
SELECT r.r_name, 1.0::DOUBLE AS eps, r.vid, i.w, min(r.label) AS label FROM reach r JOIN inside i ON i.r_name = r.r_name AND i.vid = r.vid GROUP BY ALL""")
def hdbscan_cut(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    counts = materialise(neighbour_counts(vectors, ORDERS), "counts")
    cores = materialise(hdbscan.core_distances(counts, ORDERS), "cores")
    radii = materialise(vectors.select(GROUP).distinct().withColumn("eps", F.lit(1.0)), "radii")
    return hdbscan.reachability_components(vectors, cores, radii, ORDERS).select(GROUP, "eps", "vid", "w", "label")


@register()
def hdbscan_sweep(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return typology.run_hdbscan(vectors, ORDERS).metrics


# ---------------------------------------------------------------- K-Means and hierarchy


STEP = ["F", "O", "P"]


def _fixed_models(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """One model per group whose centres are 0.9 on one order status and 0.1 elsewhere in the one-hot block."""
    at = [
        F.array(*[F.lit(0.9 if (f.name, level) == ("o_orderstatus", c) else 0.1) for f, level, _ in ORDERS.one_hot], F.lit(0.5))
        for c in range(3)
    ]
    norm = 11 * 0.1**2 + 0.9**2
    centres = F.array(*[F.struct(a.alias("at"), F.lit(norm).alias("norm")) for a in at])
    return vectors.select(GROUP).distinct().select(
        GROUP, F.lit(3).alias("k"), F.lit(1).alias("start"), centres.alias("centres")
    )


@register(f"""WITH {VECTORS}, moved AS (SELECT r_name, sta AS label, sum(w)::BIGINT AS size, sum(w * (pri = 0)::INT) / sum(w) AS urgent, sum(w * (seg = 1)::INT) / sum(w) AS building,
    sum(w * pb / top) / sum(w) AS price FROM v GROUP BY ALL)
SELECT r_name, label::INT AS label, round(urgent, 6) AS urgent, round(building, 6) AS building, round(price, 6) AS price FROM moved""")
def kmeans_one_step(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    moved = kmeans.lloyd_step(vectors, _fixed_models(spark, vectors), ORDERS, [GROUP])
    return moved.select(GROUP, F.posexplode("centres").alias("label", "c")).select(
        GROUP, "label", F.round(F.col("c.at")[0], PLACES).alias("urgent"),
        F.round(F.col("c.at")[8], PLACES).alias("building"), F.round(F.col("c.at")[12], PLACES).alias("price"),
    )


@register(f"""WITH RECURSIVE {CODED}, v AS (SELECT r_name, vid, count(*)::BIGINT AS w, floor({sql_uniform("'v'", "vid")} * pow(2, 52))::BIGINT AS place FROM keyed GROUP BY r_name, vid),
  nodes AS (SELECT r_name, level, place >> (52 - level)::INT AS node, sum(w)::BIGINT AS w, count(*) AS entries, min(vid) AS vid FROM v CROSS JOIN generate_series(0, 52) t(level) GROUP BY ALL),
  tree AS (SELECT r_name, rep, 0::BIGINT AS level, 0::BIGINT AS node, w AS n FROM nodes CROSS JOIN generate_series(1, 5) r(rep) WHERE level = 0
    UNION ALL SELECT r_name, rep, level + 1, 2 * node + side, CASE WHEN side = 0 THEN drawn ELSE n - drawn END FROM (
      SELECT r_name, rep, level, node, n, CASE WHEN p = 0 THEN 0 WHEN p = 1 THEN n ELSE list_reduce(
        list_transform(generate_series(-1, n), lambda x: {{'total': CASE WHEN x < 0 THEN 0 ELSE exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p)) END, 'hits': 0::BIGINT}}),
        lambda a, b: {{'total': a.total + b.total, 'hits': a.hits + (a.total + b.total <= u)::BIGINT}}).hits END AS drawn
      FROM (SELECT t.*, coalesce(l.w, 0) / o.w::DOUBLE AS p, {sql_uniform("'42'", "t.rep", "t.r_name", "t.level", "t.node")} AS u
        FROM tree t JOIN nodes o USING (r_name, level, node) LEFT JOIN nodes l ON l.r_name = t.r_name AND l.level = t.level + 1 AND l.node = 2 * t.node
        WHERE t.n > 0 AND o.entries > 1 AND t.level < 52)) CROSS JOIN (VALUES (0), (1)) s(side))
SELECT r_name, rep::INT AS replicate, vid, n AS w FROM tree JOIN nodes USING (r_name, level, node) WHERE n > 0 AND entries = 1""")
def bootstrap_weights(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return resampling.bootstrap_weights(vectors, GROUP, replicates=5).select(GROUP, "replicate", "vid", "w")


def _kmeans(spark: SparkSession, sf: str) -> tuple[DataFrame, typology.Solution]:
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return vectors, typology.run_kmeans(vectors, ORDERS)


@register()
def kmeans_sweep(spark, sf):
    return _kmeans(spark, sf)[1].metrics


@register()
def kmeans_select(spark, sf):
    return _kmeans(spark, sf)[1].chosen


@register()
def kmeans_premise(spark, sf):
    return selection.premise(_kmeans(spark, sf)[1].chosen)


@register()
def kmeans_profile(spark, sf):
    vectors, solution = _kmeans(spark, sf)
    return wide_profile(cluster_profile(solution.members, vectors, ORDERS, [GROUP]), ORDERS, [GROUP])


@register()
def kmeans_bootstrap(spark, sf):
    vectors, solution = _kmeans(spark, sf)
    return typology.stability(vectors, ORDERS, solution)


@register()
def kmeans_divergent(spark, sf):
    """Groups whose adopted K is not the expected one."""
    return selection.divergent(_kmeans(spark, sf)[1].chosen, [GROUP])


@register()
def agglomerative_sweep(spark, sf):
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    return typology.run_agglomerative(vectors, ORDERS).metrics


@register()
def dendrogram_tail(spark, sf):
    """Last merges of every group under its adopted linkage and K."""
    vectors = vector_table(order_profiles(spark, sf), ORDERS)
    history = agglomerative.linkage_history(vectors, ORDERS)
    chosen = typology.run_agglomerative(vectors, ORDERS, history=history).chosen
    return agglomerative.dendrogram_tail(history, ORDERS, chosen.select(GROUP, "linkage", "k"))


# ---------------------------------------------------------------- driver, sampling, projection


@register()
def typology_run(spark, sf):
    """All four algorithms over all groups through the store, with the mean agreement of each with the others."""
    store = ResultStore(scratch_path(spark, "results"), GROUP)
    solutions = typology.run_typology(order_profiles(spark, sf), ORDERS, store=store)
    agreed = typology.compare(solutions, ORDERS).select(GROUP, "algorithm_a", "algorithm_b", "ari")
    both = agreed.select(GROUP, F.col("algorithm_a").alias("algorithm"), "ari").union(agreed.select(GROUP, "algorithm_b", "ari"))
    mean = both.groupBy(GROUP, "algorithm").agg(F.avg("ari").alias("mean_ari"))
    return store.read(spark, "profile").join(mean, [GROUP, "algorithm"], "left")


@register()
def typology_agreement(spark, sf):
    """Adjusted Rand index of the six pairs of algorithms in every group, with its reading and the pair's mean."""
    table_ = materialise(typology.compare(typology.run_typology(order_profiles(spark, sf), ORDERS), ORDERS), "agreed")
    return table_.join(pair_summary(table_), ["algorithm_a", "algorithm_b"]).withColumn("reading", F.when(F.col("ari").isNotNull(), agreement_reading(F.col("ari"))))


@register()
def typology_lines(spark, sf):
    """The same driver on line items: K-Means profiles of every return flag."""
    rows = line_profiles(spark, sf)
    vectors = vector_table(rows, LINES)
    solution = typology.run_kmeans(vectors, LINES)
    return cluster_profile(solution.members, vectors, LINES, [LINES.group])


@register(f"""WITH hashed AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {sql_uniform("'42'", "event_id")}, event_id) AS place FROM events)
SELECT event_type, event_id FROM hashed WHERE place <= 150""")
def sample_per_group(spark, sf):
    return sample_rows(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 150)


@register()
def projection_points(spark, sf):
    """Components of every label of the embeddings, up to 10,000 points each."""
    rows = table(spark, sf, "embeddings").withColumn("part", F.col("label").cast("string")).withColumn("half", F.col("vec_id") % 2)
    return projection_2d(rows, "part", "vec_id", "embedding", "label", "half")


@register("""WITH x AS (SELECT label::VARCHAR AS part, vec_id, i, embedding[i]::DOUBLE AS v
  FROM embeddings, generate_series(1, (SELECT max(len(embedding)) FROM embeddings)) t(i)),
m AS (SELECT part, i, avg(v) AS mean, count(*) AS n FROM x GROUP BY part, i),
c AS (SELECT x.part, vec_id, i, v - mean AS v, n FROM x JOIN m USING (part, i))
SELECT part, n::BIGINT AS n, round(sum(v * v) / n, 6) AS total_variance FROM c GROUP BY part, n""")
def projection_variance(spark, sf):
    """Rows and total variance of every label, from the moments that the projection is fitted on."""
    rows = table(spark, sf, "embeddings").withColumn("part", F.col("label").cast("string"))
    axes = principal_axes(rows, "part", "embedding")
    return axes.select(F.col("group").alias("part"), "n", F.round("total", 6).alias("total_variance"))


@register(f"""WITH {ORD} SELECT o_orderstatus, sum(draw)::BIGINT AS drawn, CASE WHEN sum(draw) * 1.0 / count(*) > 0.6 THEN 'stable' ELSE 'unstable' END AS reading FROM (
  SELECT o_orderstatus, (SELECT count(*) FROM (SELECT sum(p) OVER (ORDER BY i) AS cut FROM (SELECT i, exp(-1) / gamma(i + 1) AS p FROM generate_series(0, 17) t(i))) c WHERE c.cut <= u.u) AS draw
  FROM (SELECT o_orderstatus, {sql_uniform("'7'", "o_orderkey")} AS u FROM ord) u) GROUP BY o_orderstatus""")
def poisson_draws(spark, sf):
    rows = table(spark, sf, "orders").withColumn("draw", poisson_one(uniform(7, F.col("o_orderkey"))))
    return rows.groupBy("o_orderstatus").agg(
        F.sum("draw").alias("drawn"), stability_reading(F.sum("draw") / F.count(F.lit(1))).alias("reading")
    )
