"""The mortality study as Spark plans: ingest, diagnosis, description, tendency, clustering, agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprofile.functions import mortality as m
from kinprofile.operators import describe, quality, tendency
from kinprofile.operators.vectors import vector_table
from kinprofile.plans import typology
from kinprofile.session import qualified
from kinprofile.sources import dbf, tables
from kinprofile.sources.store import ResultStore

GROUP = "ESTADO"
CONTINUOUS = ["IDADE_NUM", "HORA_NUM", "ANO_NUM"]
CATEGORICAL = ["SEXO_NUM", "RACACOR_NUM", "ESTCIV_NUM", "ESC_NUM", "LOCOCOR_NUM"]


def ingest(
    spark: SparkSession, folder: str, out: str, states: Sequence[str] = m.STATES, years: Sequence[str] = m.YEARS
) -> DataFrame:
    """Read the DBF files of the wanted states and years once, write the full, the selected and the
    homicide table below ``out`` and return the state x year combinations without a file.

    ``_record`` (file and record number) identifies a row from here to its label; the CSV files leave it out.
    """
    dbf.register(spark)
    folder = qualified(spark, folder)
    suffixes = [s + y for s in states for y in years]
    parsed = spark.read.format("dbf").options(suffixes=",".join(suffixes), recordId="true").load(folder)
    tables.write_parquet(parsed, f"{out}/all")
    deaths = spark.read.schema(parsed.schema).parquet(f"{out}/all")
    tables.write_delimited(deaths.drop(dbf.RECORD), f"{out}/all_csv")
    selected = tables.project_present(deaths, [*m.WANTED_COLUMNS, dbf.RECORD])
    tables.write_delimited(selected.drop(dbf.RECORD), f"{out}/selected_csv")
    tables.write_parquet(selected, f"{out}/selected")
    kept = m.homicides(spark.read.schema(selected.schema).parquet(f"{out}/selected"))
    tables.write_parquet(kept, f"{out}/homicides", partition_by=[GROUP])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][bB][fF]").load(folder)
    named = tables.with_file_columns(files, **{GROUP: (3, 2), "ANO": (5, 4)}).select(GROUP, "ANO")
    return tables.coverage_gap(named, {GROUP: list(states), "ANO": list(years)})


def read_homicides(spark: SparkSession, out: str) -> DataFrame:
    """The homicide table that ``ingest`` wrote, the state as text."""
    df = spark.read.parquet(f"{out}/homicides")
    return df.withColumn(GROUP, F.col(GROUP).cast("string"))


def diagnosis(df: DataFrame, digits: int = 1) -> DataFrame:
    """Missing, ignored and undecodable shares per state."""
    decoded = m.decode(df)
    checks = {"IDADE": F.col("IDADE_NUM").isNull(), "HORA": F.col("HORA_NUM").isNull()}
    return quality.quality_report(decoded, GROUP, m.IGNORED_CODES, checks, digits)


def model_columns(df: DataFrame) -> DataFrame:
    """Columns that enter the descriptive model of every state: those with at least one decodable value there."""
    return describe.usable_columns(m.describe_numeric(df), GROUP, [*CONTINUOUS, *CATEGORICAL])


def descriptive_table(df: DataFrame) -> DataFrame:
    """Numeric columns with the state's medians and modes in place of nulls, and their z-scores."""
    filled = describe.impute(m.describe_numeric(df), GROUP, CONTINUOUS, CATEGORICAL)
    return describe.standardise(filled, GROUP, [*CONTINUOUS, *CATEGORICAL])


def distributions(df: DataFrame) -> dict[str, DataFrame]:
    """Density curves, category profiles and the summary table of the imputed data."""
    filled = describe.impute(m.describe_numeric(df), GROUP, CONTINUOUS, CATEGORICAL)
    out = {f"profile_{c}": describe.category_shares(filled, GROUP, c, m.DISPLAY_LABELS[c]) for c in CATEGORICAL}
    counts = describe.value_counts(filled, GROUP, [*CONTINUOUS, *CATEGORICAL])
    out["density"] = describe.density_curves(filled, GROUP, CONTINUOUS, counts=counts)
    out["summary"] = describe.group_summary(filled, GROUP, CONTINUOUS, CATEGORICAL, m.DISPLAY_LABELS, counts=counts)
    return out


def hopkins(df: DataFrame, row_id: str = dbf.RECORD) -> DataFrame:
    spec = m.mortality_spec(row_id)
    return tendency.hopkins_summary(tendency.hopkins_runs(vector_table(m.categorise(df), spec), spec), GROUP)


def cluster(
    df: DataFrame, row_id: str = dbf.RECORD, store: ResultStore | None = None,
    algorithms: Mapping[str, typology.Algorithm] = typology.ALGORITHMS,
) -> tuple[dict[str, typology.Solution], DataFrame]:
    """All algorithms over all states, and the agreement of their adopted partitions."""
    spec = m.mortality_spec(row_id)
    solutions = typology.run_typology(m.categorise(df), spec, algorithms, store)
    return solutions, typology.compare(solutions, spec)
