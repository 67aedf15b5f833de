"""Matrices and vectors made from the test tables.

Index sizes come from the small key tables, so they follow the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coordloom.sources import to_coo
from coordloom.table import CooTable

# Fixed value: order lines are numbered 1 to 7.
LINE_NUMBERS = 7

# The columns the queries read. A declared schema spares the job that
# would look into the files for one.
SCHEMAS = {
    "region": "r_regionkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_returnflag string",
    "events": "event_id bigint, user_id bigint, value double",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def key_space(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """One more than the largest key of a table."""
    return int(table(spark, sf_dir, name).agg(F.max(key)).first()[0]) + 1


def customers(spark: SparkSession, sf_dir: str) -> int:
    return key_space(spark, sf_dir, "customer", "c_custkey")


def suppliers(spark: SparkSession, sf_dir: str) -> int:
    return key_space(spark, sf_dir, "supplier", "s_suppkey")


def nations(spark: SparkSession, sf_dir: str) -> int:
    return key_space(spark, sf_dir, "nation", "n_nationkey")


def events(spark: SparkSession, sf_dir: str) -> int:
    return key_space(spark, sf_dir, "events", "event_id")


def round_up(n: int, unit: int) -> int:
    return -(-n // unit) * unit


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def customer_supplier(spark: SparkSession, sf_dir: str, cols: int | None = None,
                      merge: bool = True) -> CooTable:
    """Quantity (real) and number of lines (imaginary) by customer and supplier.

    Customers rarely meet a supplier twice, so a product does without merging.
    """
    dims = (customers(spark, sf_dir), cols or suppliers(spark, sf_dir))
    return to_coo(order_lines(spark, sf_dir), "o_custkey", "l_suppkey", "l_quantity",
                  F.lit(1.0), dims, merge=merge)


def supplier_line(spark: SparkSession, sf_dir: str, rows: int | None = None) -> CooTable:
    """Quantity and negated number of lines by supplier and line number."""
    return to_coo(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_linenumber") - 1,
                  "l_quantity", F.lit(-1.0),
                  (rows or suppliers(spark, sf_dir), LINE_NUMBERS))


def customer_supplier_counts(spark: SparkSession, sf_dir: str) -> CooTable:
    """Lines (real) and returned lines (imaginary) by customer and supplier."""
    returned = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    dims = (customers(spark, sf_dir), suppliers(spark, sf_dir))
    return to_coo(order_lines(spark, sf_dir), "o_custkey", "l_suppkey", F.lit(1.0),
                  returned, dims)


def supplier_part(spark: SparkSession, sf_dir: str) -> CooTable:
    """Number of lines by supplier and part."""
    dims = (suppliers(spark, sf_dir), key_space(spark, sf_dir, "part", "p_partkey"))
    return to_coo(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.lit(1.0),
                  dims=dims)


def returned_against_accepted(spark: SparkSession, sf_dir: str) -> CooTable:
    """Quantity returned less quantity accepted by supplier and part, zeros kept."""
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    signed = F.when(flag == "R", quantity).when(flag == "A", -quantity).otherwise(0.0)
    dims = (suppliers(spark, sf_dir), key_space(spark, sf_dir, "part", "p_partkey"))
    return to_coo(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", signed,
                  dims=dims)


def event_vector(spark: SparkSession, sf_dir: str, rows: int | None = None) -> CooTable:
    """Whole part of each event's value; ``event_id`` is the table's key."""
    return to_coo(table(spark, sf_dir, "events"), "event_id", F.lit(0), F.floor("value"),
                  dims=(rows or events(spark, sf_dir), 1), key=True)


def shaped_event_vector(spark: SparkSession, sf_dir: str) -> tuple[CooTable, tuple[int, ...]]:
    """The event vector padded to whole thousands, and its shape by digits."""
    rows = round_up(events(spark, sf_dir), 1000)
    return event_vector(spark, sf_dir, rows), (rows // 1000, 10, 10, 10)


def nation_operator(spark: SparkSession, sf_dir: str) -> CooTable:
    """-1, 0 or 1 by customer nation and supplier nation, from the line counts.

    The order lines are moved once, to meet the orders' nations, and counted by
    supplier before they meet the suppliers: a supplier of any size is then one
    row per nation.
    """
    order_nation = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_nationkey")
    by_supplier = table(spark, sf_dir, "lineitem").join(
        order_nation, F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy("c_nationkey", "l_suppkey").agg(F.count("*").alias("lines"))
    lines = by_supplier.join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).groupBy("c_nationkey", "s_nationkey").agg(F.sum("lines").alias("lines"))
    n = nations(spark, sf_dir)
    return to_coo(lines, "c_nationkey", "s_nationkey", F.col("lines") % 3 - 1,
                  dims=(n, n), key=True)


def nation_vector(spark: SparkSession, sf_dir: str, rows: int | None = None) -> CooTable:
    return to_coo(table(spark, sf_dir, "nation"), "n_nationkey", F.lit(0),
                  F.col("n_nationkey") - 12, dims=(rows or nations(spark, sf_dir), 1), key=True)


def region_nation(spark: SparkSession, sf_dir: str) -> CooTable:
    n = key_space(spark, sf_dir, "region", "r_regionkey"), nations(spark, sf_dir)
    return to_coo(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey",
                  F.col("n_nationkey") + 1, F.col("n_regionkey") + 1, dims=n, key=True)


def customer_vector(spark: SparkSession, sf_dir: str, rows: int | None = None) -> CooTable:
    return to_coo(table(spark, sf_dir, "customer"), "c_custkey", F.lit(0),
                  F.col("c_nationkey") - 12, dims=(rows or customers(spark, sf_dir), 1),
                  key=True)


def customer_pair_vector(spark: SparkSession, sf_dir: str, rows: int) -> CooTable:
    """Nation less 12 (real) and 1 plus a third of the nation's number (imaginary)."""
    return to_coo(table(spark, sf_dir, "customer"), "c_custkey", F.lit(0),
                  F.col("c_nationkey") - 12, F.expr("1 + c_nationkey % 3"), dims=(rows, 1), key=True)


def supplier_vector(spark: SparkSession, sf_dir: str, rows: int | None = None) -> CooTable:
    return to_coo(table(spark, sf_dir, "supplier"), "s_suppkey", F.lit(0),
                  F.col("s_nationkey") - 12, dims=(rows or suppliers(spark, sf_dir), 1), key=True)


def embedding_matrix(spark: SparkSession, sf_dir: str) -> CooTable:
    """One row per vector, whole thousandths of each component."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("position", "x"))
    return to_coo(cells, "vec_id", "position", F.floor(F.col("x").cast("double") * 1000),
                  dims=(key_space(spark, sf_dir, "embeddings", "vec_id"), width), key=True)
