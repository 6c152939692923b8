"""Identity of sources, validity and merging of cached results, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_key(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def path_key(path: Column) -> Column:
    """Eight hexadecimal digits of the lower-cased path."""
    return F.substring(F.sha2(F.lower(path), 256), 1, 8)


def validity(parser: Column, expected: str, has_identity: Column, source_readable: Column, path_same: Column, content_same: Column) -> Column:
    """The first reason why a cache entry does not hold, or ``ok``."""
    return (
        F.when(parser.isNull(), "parser-missing").when(parser != expected, "parser").when(~has_identity, "identity-missing")
        .when(~source_readable, "unverifiable").when(~path_same, "path-mismatch").when(~content_same, "content-mismatch").otherwise("ok")
    )


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have, keys, "left_anti")


def merge(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Cached and fresh rows; a fresh row replaces the cached one with its keys."""
    rows = fresh.withColumn("__age", F.lit(0)).unionByName(cached.withColumn("__age", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy("__age")
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__age")


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, and how many there are. It is found by aggregation, in one shuffle of
    the rows that each task keeps, so that no task holds a key's rows; pass the columns that matter."""
    row = F.min_by(F.struct(*df.columns), F.col(order)).alias("__row")
    return df.groupBy(key.alias("__key")).agg(row, F.count("*").alias("copies")).select("__row.*", "copies")


def manifest(header: Column) -> Column:
    """The fields of a header such as ``key: value | key: value`` as a map; the last of equal keys counts."""
    pairs = F.filter(F.transform(F.split(header, r"\|"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"), x.contains(":").alias("ok"))), lambda x: x["ok"])
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    return unique


def substitute(pages: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages (keys, text, garbled) with cached text (keys, cached) in place of garbled text, and the
    keys of garbled pages that have none: while there are any, a conversion must be refused."""
    bad = pages.where("garbled").select(*keys)
    whole = pages.join(cached, keys, "left")
    text = F.when(F.col("garbled"), F.coalesce("cached", "text")).otherwise(F.col("text"))
    return whole.select(*keys, text.alias("text")), bad.join(cached, keys, "left_anti")


def coverage(wanted: DataFrame, have: DataFrame, group: str, page: str) -> DataFrame:
    """group, covered, total and missing: the pages that the cache lacks, as ranges."""
    from lakeloom.operators.ranges import compact

    marked = wanted.select(group, page).distinct().join(have.select(group, page).distinct().withColumn("__hit", F.lit(True)), [group, page], "left")
    counts = marked.groupBy(group).agg(F.count("__hit").alias("covered"), F.count("*").alias("total"))
    gaps = compact(marked.where("__hit IS NULL"), group, page).withColumnRenamed("ranges", "missing")
    return counts.join(gaps, group, "left").withColumn("missing", F.coalesce("missing", F.lit("")))


# Names of results that a sweep never takes.
PROTECTED = r"\.(ocr\.md|ocr\.json|read\.md)"


def expired(files: DataFrame, now: Column, days: float, path: str = "path", modified: str = "modified") -> DataFrame:
    """Files older than so many days whose names are not protected."""
    old = F.col(modified).cast("timestamp") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    return files.where(old & ~F.lower(path).rlike(PROTECTED))


class Memo:
    """The last few parsed results by path, time and size, kept as persisted frames: what falls out is
    unpersisted. A file that has changed has another key."""

    def __init__(self, most: int = 3):
        self.most, self.kept = most, {}

    def get(self, key: tuple, make) -> DataFrame:
        found = self.kept.pop(key, None)
        if found is None:
            found = make().persist()
        self.kept[key] = found
        while len(self.kept) > self.most:
            self.kept.pop(next(iter(self.kept))).unpersist()
        return found
