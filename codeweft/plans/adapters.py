"""Contract tables made from the test tables, in Spark and in SQL.

``units`` are functions: an order with its lines as decisions, operators and operands.  ``classes`` are
customers with their units.  ``dependencies`` go from a line's supplier nation to its part's brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import load


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions: ``unit_id, class_id, file_id, language, n_*, operators, operands, loc, lloc, cloc``.

    The distinct counts are sizes of sets, as a unit has a handful of lines: one pass where several
    count_distinct would multiply the rows before the shuffle.
    """
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_if"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("n_elseif"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_loop"), F.count_if(F.col("l_discount") > 0.05).alias("n_case"), F.count_if(F.col("l_tax") > 0.07).alias("n_switch"),
        F.count(F.lit(1)).alias("n_operators"), F.size(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).cast("bigint").alias("n_distinct_operators"),
        F.count(F.lit(1)).alias("n_operands"), F.size(F.collect_set("l_suppkey")).cast("bigint").alias("n_distinct_operands"),
        F.sum("l_quantity").cast("int").alias("loc"), F.size(F.collect_set("l_partkey")).alias("lloc"), F.count_if(F.col("l_discount") < 0.03).cast("int").alias("cloc"),
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("class_id"), (F.col("o_custkey") % 97).alias("file_id"), F.col("o_orderpriority").alias("language"), F.col("o_orderstatus").alias("visibility")
    )
    return orders.join(lines, "unit_id")


UNITS = """
    units AS (SELECT o.o_orderkey AS unit_id, o.o_custkey AS class_id, o.o_custkey % 97 AS file_id, o.o_orderpriority AS language, o.o_orderstatus AS visibility,
        l.* EXCLUDE (l_orderkey)
      FROM orders o JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_if, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS n_elseif,
        count(*) FILTER (l_linestatus = 'O') AS n_loop, count(*) FILTER (l_discount > 0.05) AS n_case, count(*) FILTER (l_tax > 0.07) AS n_switch,
        count(*) AS n_operators, count(DISTINCT l_returnflag || l_linestatus) AS n_distinct_operators, count(*) AS n_operands, count(DISTINCT l_suppkey) AS n_distinct_operands,
        CAST(sum(l_quantity) AS INTEGER) AS loc, CAST(count(DISTINCT l_partkey) AS INTEGER) AS lloc, CAST(count(*) FILTER (l_discount < 0.03) AS INTEGER) AS cloc
        FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

CCN = "(n_loop + n_if + n_elseif + n_case + n_switch + 1)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table with NaN as null, which is how every aggregate reads it."""
    m = load(spark, sf_dir, "metrics")
    return m.withColumn("maintainability_index", F.when(~F.isnan("maintainability_index"), F.col("maintainability_index")))


MEASURED = "measured AS (SELECT * REPLACE (CASE WHEN isnan(maintainability_index) THEN NULL ELSE maintainability_index END AS maintainability_index) FROM metrics)"


def reduced_sql(c: str, depth: int) -> str:
    """SQL of ``reduce_namespace`` for names without a host."""
    parts, sep = f"string_split_regex({c}, '[^A-Za-z0-9]+')", f"regexp_extract({c}, '[^A-Za-z0-9]+')"
    return f"CASE WHEN len({parts}) <= {depth} THEN {c} ELSE " + f" || {sep} || ".join(f"{parts}[{i + 1}]" for i in range(depth)) + " END"
