"""Queries with spreadsheet semantics over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import cells
from lakeloom.operators import sheetops as ops
from lakeloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def n(name: str):
    return cells.number(F.col(name).cast("double"))


def s(name: str):
    return cells.text(F.col(name))


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 4) AS average, min(l_quantity) AS least, max(l_quantity) AS most, count(l_quantity) AS numbers, count(*) AS cells FROM lineitem GROUP BY l_returnflag")
def xl_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    c = n("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(ops.sum_(c), 4).alias("total"), F.round(ops.average(c)["num"], 4).alias("average"), ops.min_(c).alias("least"), ops.max_(c).alias("most"), ops.count(c).alias("numbers"), ops.counta(c).alias("cells"))


@query("SELECT n_regionkey, sum(n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) AS total, CASE WHEN count(*) FILTER (WHERE n_nationkey % 3 = 0) = 0 THEN '#DIV/0!' ELSE CAST(round(avg(n_nationkey) FILTER (WHERE n_nationkey % 3 = 0), 4) AS VARCHAR) END AS average, min(n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) AS least, max(n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) AS most, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS numbers, count(*) FILTER (WHERE n_nationkey % 9 <> 1) AS cells FROM nation GROUP BY n_regionkey")
def xl_text_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over ranges of numbers, texts, errors and empty cells: only numbers are summed up, and
    COUNTA takes all that is not empty."""
    k = F.col("n_nationkey")
    c = F.when(k % 3 == 0, cells.number(k.cast("double"))).when(k % 9 == 1, cells.text(F.lit(""))).when(k % 3 == 1, cells.text(F.col("n_name"))).otherwise(cells.error(cells.DIV0))
    rows = table(spark, folder, "nation").select("n_regionkey", c.alias("c"))
    c = F.col("c")
    agg = rows.groupBy("n_regionkey").agg(ops.sum_(c).cast("long").alias("total"), ops.average(c).alias("a"), ops.min_(c).cast("int").alias("least"), ops.max_(c).cast("int").alias("most"), ops.count(c).alias("numbers"), ops.counta(c).alias("cells"))
    average = F.coalesce("a.error", F.round("a.num", 4).cast("string"))
    return agg.select("n_regionkey", "total", average.alias("average"), "least", "most", "numbers", "cells")


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_quantity >= 25) AS big, count(*) FILTER (WHERE l_quantity = 10) AS ten, count(*) FILTER (WHERE l_quantity <> 10) AS other FROM lineitem GROUP BY l_linestatus")
def xl_countif_num(spark: SparkSession, folder: str) -> DataFrame:
    c = n("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(ops.count_if(c, ">=25").alias("big"), ops.count_if(c, "10").alias("ten"), ops.count_if(c, "<>10").alias("other"))


@query("SELECT count(*) FILTER (WHERE n_name ILIKE 'a%') AS starts, count(*) FILTER (WHERE n_name ILIKE '_r%') AS second, count(*) FILTER (WHERE NOT n_name ILIKE '%a%') AS without FROM nation")
def xl_countif_wild(spark: SparkSession, folder: str) -> DataFrame:
    c = s("n_name")
    return table(spark, folder, "nation").agg(ops.count_if(c, "a*").alias("starts"), ops.count_if(c, "?r*").alias("second"), ops.count_if(c, "<>*a*").alias("without"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 20 AND l_discount <= 0.05 AND l_linestatus = 'O') AS hits FROM lineitem GROUP BY l_returnflag")
def xl_countifs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(ops.count_ifs((n("l_quantity"), ">20"), (n("l_discount"), "<=0.05"), (s("l_linestatus"), "O")).alias("hits"))


@query("SELECT l_linestatus, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity < 10), 0), 2) AS total FROM lineitem GROUP BY l_linestatus")
def xl_sumif(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(F.round(ops.sum_if(n("l_quantity"), "<10", n("l_extendedprice")), 2).alias("total"))


@query("SELECT l_linestatus, round(avg(l_extendedprice) FILTER (WHERE l_quantity = 7), 2) AS average, '#DIV/0!' AS nothing FROM lineitem GROUP BY l_linestatus")
def xl_averageif(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.average_if(n("l_quantity"), "=7", n("l_extendedprice"))
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(F.round(found["num"], 2).alias("average"), ops.average_if(n("l_quantity"), ">1000", n("l_extendedprice"))["error"].alias("nothing"))


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, '#N/A') AS name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 <> 0")
def xl_vlookup_exact(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_name")
    found = ops.vlookup(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", parts, "p_partkey", "p_name", "p_partkey", "name")
    return found.select("l_orderkey", "l_linenumber", F.coalesce("name", F.lit(cells.NA)).alias("name"))


@query("WITH b AS (SELECT n_nationkey * 15000.0 + 1000 AS floor, n_name FROM nation) SELECT o_orderkey, coalesce(n_name, '#N/A') AS band FROM orders ASOF LEFT JOIN b ON o_totalprice >= floor")
def xl_vlookup_approx(spark: SparkSession, folder: str) -> DataFrame:
    bands = table(spark, folder, "nation").select((F.col("n_nationkey") * 15000.0 + 1000).alias("floor"), "n_name", "n_nationkey")
    found = ops.vlookup_approximate(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "floor", "n_name", "n_nationkey", "band")
    return found.select("o_orderkey", F.coalesce("band", F.lit(cells.NA)).alias("band"))


@query("WITH k AS (SELECT s_suppkey, round(s_acctbal, -2) AS x FROM supplier), t AS (SELECT DISTINCT round(c_acctbal, -2) AS x FROM customer), f AS (SELECT t.x, coalesce(min(CASE WHEN k.x = t.x THEN s_suppkey END), max(CASE WHEN k.x < t.x THEN s_suppkey END)) AS found FROM t JOIN k ON k.x <= t.x GROUP BY t.x) SELECT c_custkey, coalesce(found, -1) AS found FROM customer LEFT JOIN f ON f.x = round(c_acctbal, -2)")
def xl_vlookup_unsorted(spark: SparkSession, folder: str) -> DataFrame:
    """Keys in no order, some of them repeated: the first equal row, else the last smaller one."""
    keys = table(spark, folder, "supplier").select("s_suppkey", F.round("s_acctbal", -2).alias("x"))
    rows = table(spark, folder, "customer").select("c_custkey", F.round("c_acctbal", -2).alias("x"))
    return ops.vlookup_approximate(rows, "x", keys, "x", "s_suppkey", "s_suppkey", "found").select("c_custkey", F.coalesce("found", F.lit(-1)).alias("found"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'FALSE' END AS kind FROM lineitem")
def xl_if(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", cells.compare(">", n("l_quantity"), cells.number(F.lit(25.0))).alias("c"))
    rows = rows.withColumn("kind", cells.if_(F.col("c"), cells.text(F.lit("bulk"))))
    return rows.select("l_orderkey", "l_linenumber", cells.text_of(F.col("kind")).alias("kind"))


_EPS = "(l_extendedprice + pow(2.0, -52) * sign(l_extendedprice))"


@query(f"SELECT l_orderkey, l_linenumber, floor({_EPS} * pow(10.0, 1) + 0.5) / pow(10.0, 1) AS one, floor((-l_quantity - 0.5 - pow(2.0, -52)) + 0.5) AS half, ceil(l_extendedprice * 10.0) / 10.0 AS up, floor(l_extendedprice * 10.0) / 10.0 AS down, floor(-l_discount) AS whole, abs(-l_discount) AS absolute FROM lineitem")
def xl_round(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("double")
    half = -F.col("l_quantity").cast("double") - 0.5
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", cells.round_(price, 1).alias("one"), cells.round_(half).alias("half"), cells.round_up(price, 1).alias("up"), cells.round_down(price, 1).alias("down"), F.floor(-F.col("l_discount")).cast("double").alias("whole"), F.abs(-F.col("l_discount")).alias("absolute"))


@query("SELECT o_orderkey, o_custkey - 7 * floor(o_custkey / 7) AS m, o_custkey - -7 * floor(o_custkey / -7.0) AS negative, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey - (o_custkey % 3) * floor(o_orderkey / (o_custkey % 3)) END AS other FROM orders")
def xl_int_mod(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_custkey")
    return table(spark, folder, "orders").select("o_orderkey", cells.mod(o, F.lit(7)).cast("double").alias("m"), cells.mod(o, F.lit(-7)).cast("double").alias("negative"), cells.mod(F.col("o_orderkey"), o % 3).cast("double").alias("other"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 10 THEN '#DIV/0!' ELSE 'n' END AS quotient, '#VALUE!' AS mixed, round(l_quantity / 100.0, 4) AS percent, l_quantity * l_quantity AS square, l_quantity || l_returnflag AS joined, CASE WHEN l_quantity < 5 THEN 'TRUE' ELSE 'FALSE' END AS few FROM (SELECT * REPLACE (CAST(l_quantity AS BIGINT) AS l_quantity) FROM lineitem)")
def xl_operators(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic, concatenation and comparison with error values."""
    one, two, five, ten = (cells.number(F.lit(x)) for x in (1.0, 2.0, 5.0, 10.0))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", n("l_quantity").alias("q"), s("l_returnflag").alias("f"))
    q, flag = F.col("q"), F.col("f")
    rows = rows.withColumns({"less": cells.arithmetic("-", q, ten), "product": cells.arithmetic("*", flag, q), "square": cells.arithmetic("^", q, two), "joined": cells.concat(q, flag), "few": cells.compare("<", q, five)})
    rows = rows.withColumn("quotient", cells.arithmetic("/", one, F.col("less")))
    rows = rows.withColumn("mixed", cells.arithmetic("+", F.col("product"), F.col("quotient")))
    return rows.select(
        "l_orderkey", "l_linenumber", F.coalesce("quotient.error", "quotient.t").alias("quotient"), F.col("mixed.error").alias("mixed"), F.round(cells.percent(q)["num"], 4).alias("percent"),
        F.col("square.num").alias("square"), F.col("joined.str").alias("joined"), cells.text_of(F.col("few")).alias("few"),
    )


@query("SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 2) AS r, substring(p_name, 2, 4) AS m, length(p_name) AS size, upper(p_name) AS up, lower(p_brand) AS low, p_name || p_brand AS both, '#VALUE!' AS bad, regexp_replace(trim('  ' || p_name || '   x '), '\\s+', ' ', 'g') AS trimmed FROM part")
def xl_text_funcs(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_name")
    return table(spark, folder, "part").select("p_partkey", cells.left(p, 3)["str"].alias("l"), cells.right(p, 2)["str"].alias("r"), cells.mid(p, 2, 4)["str"].alias("m"), F.length(p).cast("long").alias("size"), F.upper(p).alias("up"), F.lower("p_brand").alias("low"), cells.text_of(cells.concat(s("p_name"), s("p_brand"))).alias("both"), cells.mid(p, 0, 4)["error"].alias("bad"), cells.trim(F.concat(F.lit("  "), p, F.lit("   x "))).alias("trimmed"))


_CENTS = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, regexp_replace(printf('%d', {_CENTS} // 100), '^(\\d+?)((\\d{{3}})*)$', CASE WHEN {_CENTS} // 100 >= 100000 THEN left(CAST({_CENTS} // 100 AS VARCHAR), -3) || ',' || right(CAST({_CENTS} // 100 AS VARCHAR), 3) WHEN {_CENTS} // 100 >= 1000 THEN left(CAST({_CENTS} // 100 AS VARCHAR), -3) || ',' || right(CAST({_CENTS} // 100 AS VARCHAR), 3) ELSE CAST({_CENTS} // 100 AS VARCHAR) END) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') AS money, CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS share FROM lineitem")
def xl_text_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", cells.format_number(F.col("l_extendedprice").cast("double"), "#,##0.00").alias("money"), cells.format_number(F.col("l_discount").cast("double"), "0%").alias("share"))


@query("SELECT o_orderkey, -CAST(o_custkey AS DOUBLE) AS negative, o_custkey / 100.0 AS percent, o_custkey * 1000.0 + 500 AS thousands, '#VALUE!' AS bad FROM orders")
def xl_value(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select("o_orderkey", cells.value(F.concat(F.lit("("), c, F.lit(")")))["num"].alias("negative"), cells.value(F.concat(c, F.lit("%")))["num"].alias("percent"), cells.value(F.concat(F.lit(" "), c, F.lit(",500 ")))["num"].alias("thousands"), cells.value(F.concat(c, F.lit("x")))["error"].alias("bad"))


@query("WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '0' || c_custkey WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN c_name ELSE '-' || c_custkey || '.5e1' END AS v FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'n' ELSE 's' END AS t, CASE WHEN c_custkey % 4 IN (1, 3) THEN CAST(v AS DOUBLE) END AS num FROM v")
def cell_infer(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("0"), k)).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.col("c_name")).otherwise(F.concat(F.lit("-"), k, F.lit(".5e1")))
    c = cells.infer(v)
    return table(spark, folder, "customer").select("c_custkey", c["t"].alias("t"), c["num"].alias("num"))


@query("WITH r AS (SELECT n_nationkey, n_nationkey * 29 AS i FROM nation) SELECT n_nationkey, CASE WHEN i >= 26 THEN chr(CAST(64 + i // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + i % 26 AS INTEGER)) AS name, i AS back FROM r")
def xl_references(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("n_nationkey") * 29
    name = cells.column_name(i)
    return table(spark, folder, "nation").select("n_nationkey", name.alias("name"), cells.column_index(F.concat(name, F.lit("7"))).cast("long").alias("back"))


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 9999 AS INTEGER), '%Y-%m-%d') AS day, strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 9999 AS INTEGER), '%Y-%m-%d') || ' 06:00' AS stamp FROM orders")
def xl_date_serial(spark: SparkSession, folder: str) -> DataFrame:
    serial = (30000 + F.col("o_orderkey") % 9999).cast("double")
    return table(spark, folder, "orders").select("o_orderkey", cells.serial_to_date(serial).alias("day"), cells.serial_to_date(serial + 0.25).alias("stamp"))
