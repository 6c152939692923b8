"""Ranges of pages, windows of texts and their boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, start, content and next_start (null at the end) of consecutive slices of each text."""
    size = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(limit))
    rows = df.select(key, text, F.explode(starts.cast("array<bigint>")).alias("start"))
    more = F.col("start") + limit
    return rows.select(key, "start", F.substring(F.col(text), (F.col("start") + 1).cast("int"), F.lit(limit)).alias("content"), F.when(more < size, more).alias("next_start"))


def cut(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, back to the last line feed if that is beyond 60 % of them."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    whole = F.instr(head, "\n") == 0
    return F.when(F.length(text) <= limit, text).when(~whole & (at > 0.6 * limit), F.substring(head, F.lit(1), at)).otherwise(head)


def preview(text: Column, tail: bool, size: int = 100) -> Column:
    """The end or start of a text in one line, with an ellipsis where more was left out."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    short = F.concat(F.lit("…"), F.right(line, F.lit(size))) if tail else F.concat(F.substring(line, 1, size), F.lit("…"))
    return F.when(F.length(line) > size, short).otherwise(line)


def compact(df: DataFrame, key: str, number: str) -> DataFrame:
    """key and ranges, such as ``1-3,7``, of the distinct numbers of each key."""
    order = Window.partitionBy(key).orderBy(number)
    rows = df.select(key, number).where(F.col(number).isNotNull()).distinct().withColumn("__island", F.col(number) - F.row_number().over(order))
    islands = rows.groupBy(key, "__island").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    label = F.when(F.col("hi") > F.col("lo"), F.concat_ws("-", "lo", "hi")).otherwise(F.col("lo").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("lo", label.alias("label"))))
    return islands.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["label"]), ",").alias("ranges"))


def expand(df: DataFrame, key: str, spec: str, total: int) -> DataFrame:
    """key and n: the distinct numbers from 1 to ``total`` that a specification such as ``1-3, 7`` names.

    Parts that are neither a number nor a range name nothing.
    """
    chunk = F.explode(F.split(F.regexp_replace(F.col(spec), r"(\d+)\s*[-~]\s*(\d+)", "$1-$2"), r"[,，、\s]+"))
    rows = df.select(key, chunk.alias("c")).where(F.col("c").rlike(r"^\d{1,9}(-\d{1,9})?$"))
    ends = F.split("c", "-")
    lo, hi = F.greatest(F.get(ends, 0).cast("int"), F.lit(1)), F.least(F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("int"), F.lit(total))
    return rows.select(key, lo.alias("lo"), hi.alias("hi")).where("lo <= hi").select(key, F.explode(F.sequence("lo", "hi")).alias("n")).distinct()


def batches(df: DataFrame, key: str, pages: str, size: int) -> DataFrame:
    """key, first_page and last_page of consecutive batches."""
    rows = df.select(key, pages, F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(size))).alias("first_page"))
    return rows.select(key, "first_page", F.least(F.col("first_page") + size - 1, F.col(pages)).alias("last_page"))


def between_pages(pages: DataFrame, page: str, first: int | None, last: int | None) -> DataFrame:
    """The pages from ``first`` to ``last``, both included; an error where there are none."""
    if first is not None and last is not None and first > last:
        raise ValueError(f"no pages from {first} to {last}")
    inside = F.col(page) >= (first or 1)
    chosen = pages.where(inside if last is None else inside & (F.col(page) <= last))
    if not chosen.limit(1).count():
        raise ValueError(f"no pages from {first or 1} to {last or 'the last'}")
    return chosen


def inline_cap(wanted: int | str | None, default: int = 120_000, least: int = 1000) -> int | None:
    """The characters that a read gives at once: None without a cap (0); what is too small to be meant,
    or no number, is ignored."""
    found = re.fullmatch(r"\s*(\d+)\s*", str(wanted or "" if wanted != 0 else 0))
    if not found:
        return default
    n = int(found[1])
    return None if n == 0 else n if n >= least else default


def capped(text: Column, cap: int | None) -> Column:
    """Struct of content, truncated and the number of characters of the whole text."""
    size = F.length(text)
    return F.struct((text if cap is None else cut(text, cap)).alias("content"), (F.lit(False) if cap is None else size > cap).alias("truncated"), size.alias("characters"))


def read_plan(df: DataFrame, key: str, pages: str, garbled: str, most: int = 12, size: int = 15, garbled_size: int = 20) -> DataFrame:
    """key, first_page and last_page of the reads that a document of many pages, or of garbled ones, is
    better read in; the others are in one."""
    step = F.when(F.col(garbled), garbled_size).when(F.col(pages) > most, size).otherwise(F.greatest(F.col(pages), F.lit(1)))
    rows = df.select(key, pages, step.cast("int").alias("__step")).where(F.col(pages) > 0)
    rows = rows.select(key, pages, "__step", F.explode(F.sequence(F.lit(1), F.col(pages), F.col("__step"))).alias("first_page"))
    return rows.select(key, "first_page", F.least(F.col("first_page") + F.col("__step") - 1, F.col(pages)).alias("last_page"))


# Fixed value: the line that follows a recognised page's text.
PAGE_MARK = r"(?m)^_（第 (\d+) 页：.*）_[ \t]*$"


def page_bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, page and body: what stands before each page's mark, back to the mark before; the last of a
    page that is marked twice counts."""
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))
    rows = df.select(key, F.split(text, PAGE_MARK).alias("__parts"), F.posexplode(numbers).alias("__k", "page"))
    body = F.regexp_replace(F.get("__parts", F.col("__k")), r"^\s+|\s+$", "")
    return rows.groupBy(key, F.col("page").cast("int").alias("page")).agg(F.max_by(body, "__k").alias("body"))


def blanks(text: Column, mark: str) -> Column:
    """Runs of three or more underscores become shorter runs of ``mark``, three at least."""
    cells = F.split(F.regexp_replace(text, "(_{3,})", "\x01$1\x01"), "\x01")
    size = lambda x: F.greatest(F.lit(3), F.floor(0.6 * F.length(x) + 0.5).cast("int"))
    return F.array_join(F.transform(cells, lambda x: F.when(x.rlike("^_{3,}$"), F.repeat(F.lit(mark), size(x))).otherwise(x)), "")
