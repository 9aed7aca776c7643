"""The feature specifications and base tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprofile.functions.scalar import band
from kinprofile.spec import FeatureSpec, Nominal, Ordinal

PRICE_CUTS = [(100_000, "p1"), (200_000, "p2"), (350_000, "p3")]

ORDERS = FeatureSpec(
    group="r_name",
    row_id="o_orderkey",
    nominals=(
        Nominal(
            "o_orderpriority",
            ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
            "4-NOT SPECIFIED",
        ),
        Nominal("o_orderstatus", ("F", "O", "P")),
        Nominal("c_mktsegment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ),
    ordinals=(Ordinal("price_band", (("p1", 1), ("p2", 2), ("p3", 3), ("p4", 4))),),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's region and segment, and a price band."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .withColumn("price_band", band(F.col("o_totalprice"), PRICE_CUTS, "p4"))
    )


PRICE_STEPS = 40
FINE_ORDERS = FeatureSpec(
    ORDERS.group,
    ORDERS.row_id,
    ORDERS.nominals,
    (Ordinal("price_step", tuple((f"s{i}", i) for i in range(1, PRICE_STEPS + 1))),),
)


def fine_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order profiles with 40 price steps, so that most vectors hold a single row."""
    step = F.least(F.floor(F.col("o_totalprice") / 12_500), F.lit(PRICE_STEPS - 1)) + 1
    return order_profiles(spark, sf_dir).withColumn("price_step", F.concat(F.lit("s"), step))


LINES = FeatureSpec(
    group="l_returnflag",
    row_id="line_id",
    nominals=(
        Nominal("l_linestatus", ("F", "O")),
        Nominal("discount_band", ("d0", "d1", "d2"), "d0"),
        Nominal("quantity_band", ("q1", "q2", "q3", "q4")),
        Nominal("ship_month", tuple(f"m{i:02d}" for i in range(1, 13))),
    ),
    ordinals=(Ordinal("tax_band", (("t0", 0), ("t1", 1), ("t2", 2))),),
)


def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as coded profiles (the bench-scale workload)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
        band(F.col("l_discount"), [(0.01, "d0"), (0.06, "d1")], "d2").alias("discount_band"),
        band(F.col("l_quantity"), [(13, "q1"), (26, "q2"), (39, "q3")], "q4").alias("quantity_band"),
        F.date_format("l_shipdate", "'m'MM").alias("ship_month"),
        band(F.col("l_tax"), [(0.01, "t0"), (0.05, "t1")], "t2").alias("tax_band"),
    )
