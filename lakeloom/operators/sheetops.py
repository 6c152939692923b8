"""Aggregates and lookups over columns of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import cells


def range_number(c: Column) -> Column:
    """What a cell of a range adds to numeric aggregates: texts, booleans and errors are skipped."""
    return F.when(c["t"] == "n", c["num"])


def sum_(c: Column) -> Column:
    return F.coalesce(F.sum(range_number(c)), F.lit(0.0))


def average(c: Column) -> Column:
    """A cell: #DIV/0! without numbers."""
    x = F.avg(range_number(c))
    return F.when(x.isNull(), cells.error(cells.DIV0)).otherwise(cells.number(x))


def min_(c: Column) -> Column:
    return F.coalesce(F.min(range_number(c)), F.lit(0.0))


def max_(c: Column) -> Column:
    return F.coalesce(F.max(range_number(c)), F.lit(0.0))


def count(c: Column) -> Column:
    return F.count(range_number(c))


def counta(c: Column) -> Column:
    return F.count_if((c["t"] == "e") | (cells.text_of(c) != ""))


def count_if(c: Column, spec: str) -> Column:
    return F.count_if(cells.criterion(c, spec))


def count_ifs(*pairs: tuple[Column, str]) -> Column:
    hit = F.lit(True)
    for c, spec in pairs:
        hit = hit & cells.criterion(c, spec)
    return F.count_if(hit)


def sum_if(c: Column, spec: str, summed: Column) -> Column:
    return F.coalesce(F.sum(F.when(cells.criterion(c, spec), range_number(summed))), F.lit(0.0))


def average_if(c: Column, spec: str, averaged: Column) -> Column:
    x = F.avg(F.when(cells.criterion(c, spec), range_number(averaged)))
    return F.when(x.isNull(), cells.error(cells.DIV0)).otherwise(cells.number(x))


def vlookup(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, row: str, into: str) -> DataFrame:
    """Exact lookup: the value in the first row with the key; null (#N/A) without one.

    The lookup side is reduced to one row a key before the join; Spark broadcasts it if its size, which
    it knows by then, is below its threshold, and shuffles both sides otherwise.
    """
    first = lookup.where(F.col(lookup_key).isNotNull()).groupBy(F.col(lookup_key).alias("__k")).agg(F.min_by(value, row).alias(into))
    return df.join(first, df[key] == first["__k"], "left").drop("__k")


def vlookup_approximate(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, row: str, into: str, buckets: int = 256) -> DataFrame:
    """Approximate lookup: the value in the first row whose key equals ``key``; else in the last row, by
    ``row``, whose key is smaller; null (#N/A) without one. Keys need not be sorted.

    It is an as-of join on distinct keys of both sides, so a hot key is one row. Keys are dealt to buckets
    by bounds that are counted once and written into the plan, and each bucket is scanned in key order;
    what the buckets before it hold comes from one row a bucket. The found values join the rows by key.
    """
    keys = lookup.select(F.col(lookup_key).cast("double").alias("__x"), F.struct(F.col(row).alias("r"), F.col(value).alias("v")).alias("__c")).where("__x IS NOT NULL AND NOT isnan(__x)")
    marks = keys.groupBy("__x").agg(F.min("__c").alias("__first"), F.max("__c").alias("__last"))
    wanted = df.select(F.col(key).cast("double").alias("__x")).where("__x IS NOT NULL AND NOT isnan(__x)").distinct()
    none = F.lit(None).cast(marks.schema["__first"].dataType)
    both = marks.withColumn("__side", F.lit(0)).unionByName(wanted.select("__x", none.alias("__first"), none.alias("__last"), F.lit(1).alias("__side")))
    bounds = sorted({x for x in both.approxQuantile("__x", [i / buckets for i in range(1, buckets)], 0.25 / buckets)})
    both = both.withColumn("__b", _bucket(F.col("__x"), bounds, 0))
    within = Window.partitionBy("__b").orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("__side") == 0, F.struct("__x", "__first")), True).over(within)
    seen = both.withColumn("__at", here).withColumn("__best", F.max("__last").over(within))
    ends = both.where("__side = 0").groupBy("__b").agg(F.max("__last").alias("__end"))
    parts = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__b")).join(ends, "__b", "left")
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    parts = parts.select("__b", F.max("__end").over(earlier).alias("__before"))
    found = seen.where("__side = 1").join(F.broadcast(parts), "__b")
    exact = F.when(F.col("__at.__x") == F.col("__x"), F.col("__at.__first.v"))
    found = found.select("__x", F.when(exact.isNotNull(), exact).otherwise(F.greatest("__best", "__before")["v"]).alias(into))
    return df.join(found, df[key].cast("double") == found["__x"], "left").drop("__x")


def _bucket(x: Column, bounds: list[float], first: int) -> Column:
    """The number of bounds that are at most x, plus ``first``, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(x < bounds[half], _bucket(x, bounds[:half], first)).otherwise(_bucket(x, bounds[half + 1 :], first + half + 1))
