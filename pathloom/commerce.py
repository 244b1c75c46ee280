"""The commerce tables as a graph: customers buy parts, suppliers ship them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.timeutil import TimeWindow, WindowGroup
from pathloom.naming import edge_type_name
from pathloom.spec import EdgeType, GraphSpec, NodeType, TableSpec

BUYS, SHIPS = edge_type_name("Customer", "Part"), edge_type_name("Part", "Supplier")
HISTORY = WindowGroup(("count_*", "sum"), (TimeWindow(-9, 10, "year"),))
LAST_YEARS = WindowGroup(("count_*", "max"), (TimeWindow(0, 1, "year"), TimeWindow(-1, 1, "year")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: customer, part, supplier, year, quantity, price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("custkey"), F.date_format("o_orderdate", "yyyy").alias("year"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("partkey"), F.col("l_suppkey").cast("string").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("custkey", "partkey", "suppkey", "year", "quantity", "price")


def source(sf_dir: str, *cols: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: purchases(spark, sf_dir).select(*cols)


def part_attributes(sf_dir: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("partkey"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retailprice"))


def commerce_graph(sf_dir: str) -> GraphSpec:
    time = {"time_cols": ("year",), "time_formats": ("%Y",)}
    nodes = {
        "Customer": NodeType("Customer", ("Customer_Node",), (TableSpec("bought", (("custkey",),), source(sf_dir, "custkey", "year", "quantity"), ("quantity",), groups=(HISTORY, LAST_YEARS), **time),)),
        "Part": NodeType(
            "Part", ("Part_Node",),
            (
                TableSpec("sold", (("partkey",),), source(sf_dir, "partkey", "year", "quantity"), ("quantity",), groups=(HISTORY,), **time),
                TableSpec("attributes", (("partkey",),), part_attributes(sf_dir), ("size", "retailprice")),
            ),
        ),
        "Supplier": NodeType("Supplier", ("Supplier_Node",), (TableSpec("shipped", (("suppkey",),), source(sf_dir, "suppkey", "year"), groups=(WindowGroup(("count_*",), (TimeWindow(-9, 10, "year"),)),), **time),)),
    }
    history = WindowGroup(("first",), (TimeWindow(-9, 10, "year"),))
    edges = {
        BUYS: EdgeType(BUYS, ("Customer", "Part"), (TableSpec("buys", (("custkey",), ("partkey",)), source(sf_dir, "custkey", "partkey", "year", "quantity"), ("quantity",), groups=(HISTORY,), **time),)),
        SHIPS: EdgeType(SHIPS, ("Part", "Supplier"), (TableSpec("ships", (("partkey",), ("suppkey",)), source(sf_dir, "partkey", "suppkey", "year"), groups=(history,), **time),)),
    }
    return GraphSpec(("graph_year",), ("%Y",), nodes, edges)
