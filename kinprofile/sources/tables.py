"""Reading and writing tables: projection, file-name columns, unions, coverage and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def project_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; columns a table lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_file_columns(df: DataFrame, **places: tuple[int, int]) -> DataFrame:
    """Columns cut out of the file name: name=(first character, length). File sources only."""
    name = F.col("_metadata.file_name")
    return df.select("*", *[F.substring(name, at, length).alias(c) for c, (at, length) in places.items()])


def coverage_gap(found: DataFrame, expected: dict[str, Sequence]) -> DataFrame:
    """Combinations of the expected values that ``found`` lacks.

    The grid is built from the literal value lists, one explode per key.
    """
    spark = found.sparkSession
    grid = spark.range(1).drop("id")
    for key, values in expected.items():
        grid = grid.withColumn(key, F.explode(F.array(*map(F.lit, values))))
    return grid.join(found.select(*expected).distinct(), list(expected), "left_anti")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Semicolon CSV, UTF-8, every field quoted; quotes inside are doubled and so are backslashes."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    doubled = df.withColumns({c: F.replace(c, F.lit("\\"), F.lit("\\\\")) for c in text}) if text else df
    doubled.write.mode(mode).options(
        sep=";", quoteAll=True, escape='"', header=True, encoding="UTF-8", emptyValue="", nullValue=""
    ).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The dialect of ``write_delimited``; an empty field is null."""
    df = spark.read.schema(schema).options(sep=";", escape='"', header=True, encoding="UTF-8").csv(path)
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.replace(c, F.lit("\\\\"), F.lit("\\")) for c in text}) if text else df


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain CSV with a header; the key column comes first."""
    df.write.mode(mode).option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
