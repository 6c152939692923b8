"""Decisions about recognised pages: gate, reading order, retries, budget, layout gaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Gate:
    least_score: float = 0.88
    many_boxes: int = 45
    many_boxes_score: float = 0.95
    short_share: float = 0.6
    short_boxes: int = 30
    short_score: float = 0.95


def page_stats(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """boxes, score (three decimals) and short_share (two) from rows of boxes with text and score."""
    half = lambda x, f: F.floor(x * f + 0.5) / f
    return boxes.groupBy(*keys).agg(F.count("*").alias("boxes"), half(F.avg("score"), 1000).alias("score"), half(F.avg((F.length("text") <= 6).cast("double")), 100).alias("short_share"))


RESULT = "struct<code:int,data:array<struct<box:array<array<double>>,text:string,score:double>>>"


def parsed(line: Column) -> Column:
    """Struct of a recognition result's JSON line: code, boxes, score (three decimals) and short_share (two;
    1 without boxes). A line that is no JSON has a null code."""
    half = lambda x, f: F.floor(x * f + 0.5) / f
    r = F.from_json(line, RESULT)
    n = F.coalesce(F.size(r["data"]), F.lit(0))
    total = F.aggregate(r["data"], F.lit(0.0), lambda a, b: a + F.coalesce(b["score"], F.lit(0.0)))
    short = F.size(F.filter(r["data"], lambda b: F.length(F.coalesce(b["text"], F.lit(""))) <= 6))
    return F.struct(r["code"].alias("code"), n.alias("boxes"), F.when(n > 0, half(total / n, 1000)).otherwise(0.0).alias("score"), F.when(n > 0, half(short / n, 100)).otherwise(1.0).alias("short_share"))


def chosen_pages(pages: DataFrame, key: str, page: str, mode: str, given: bool, preview: int = 3, most: int = 20) -> DataFrame:
    """Adds wanted and taken to pages (key, page, has_text, garbled): ``always`` wants all of them, ``auto``
    those without text or garbled, ``never`` none. Of those wanted the first are taken: a preview where
    the caller has not given pages, and never more than ``most``; the others are told as not taken."""
    wanted = {"always": F.lit(True), "auto": ~F.col("has_text") | F.col("garbled"), "never": F.lit(False)}[mode]
    nth = F.sum(F.col("wanted").cast("int")).over(Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("wanted", wanted).withColumn("taken", F.col("wanted") & (nth <= (most if given else min(preview, most))))


def chunks(pages: DataFrame, key: str, page: str, size: int = 20) -> DataFrame:
    """Adds chunk (from 0): consecutive pages of a key, at most ``size`` each."""
    return pages.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(page)) - 1) / size).cast("int"))


def escalated(pages: DataFrame, key: str, page: str, passed: str, calls: int) -> DataFrame:
    """Of each page that did not pass: whether the key's budget of calls, spent in page order, still has
    one for it. Those without are the pages to name as skipped."""
    failed = pages.where(~F.col(passed)).withColumn("__cost", F.lit(1))
    return within_budget(failed, key, [page], "__cost", calls).drop("__cost")


def gate(code: Column, boxes: Column, score: Column, short_share: Column, g: Gate = Gate()) -> Column:
    """blank, or the first reason to reject a page, or ok."""
    return (
        F.when(code.isNull(), "none").when(code == 101, "blank").when(code != 100, "code").when(boxes == 0, "empty").when(score < g.least_score, "score")
        .when((boxes >= g.many_boxes) & (score < g.many_boxes_score), "dense").when((short_share > g.short_share) & (boxes >= g.short_boxes) & (score < g.short_score), "short").otherwise("ok")
    )


def reading_order(boxes: DataFrame, keys: list[str], band: int = 24, found: tuple[str, ...] = ()) -> DataFrame:
    """keys and text: boxes in bands of ``band`` pixels, then from left to right, by line feeds. Boxes at the
    same place stay in the order of ``found``, in which they were recognised, then of their texts."""
    parts = F.array_sort(F.collect_list(F.struct(F.floor(F.col("y") / band).alias("band"), "x", "pos", *found, "text")))
    return boxes.where("text <> ''").groupBy(*keys).agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n").alias("text"))


def best_retry(tries: DataFrame, keys: list[str]) -> DataFrame:
    """The passing try with the best score, the first of equals."""
    best = F.max_by(F.struct("try", "score"), F.struct("score", -F.col("try")))
    return tries.where("ok").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.try", "b.score")


def within_budget(pages: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Adds granted: whether the running cost in order still fits the key's budget."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("granted", spent <= budget)


def layout_gap(boxes: DataFrame, keys: list[str], height: int) -> DataFrame:
    """keys, bands (of ten, with a box) and gap: a page whose boxes leave much of its lower part empty."""
    band = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("y") * 10 / height)))
    rows = boxes.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), band.cast("int"))).alias("mask"), F.max("y").alias("low"))
    bands = F.bit_count("mask")
    return rows.select(*keys, bands.cast("long").alias("bands"), ((F.col("n") >= 3) & (bands < 7) & (F.col("low") < 0.8 * height)).alias("gap"))


def provenance(ocr: Column, blank: Column, has_text: Column, layer: Column) -> Column:
    """What stands for a page: recognised text, a note that it is blank or without text, its own text."""
    return F.coalesce(ocr, F.when(blank, "(blank)"), F.when(~has_text, "(no text)"), layer)


# How a model announces a transcript, doubts it, or describes the picture instead.
MARKS = ("transcription", "transcript", "full text", "fulltext", "ocr output", "text below", "原文", "正文", "转录", "转录结果", "抄写", "抄写结果", "抄写内容")
OPENERS = ("here's", "here’s", "here is", "the following", "below is")
CHINESE_OPENERS = ("以下", "下列", "下面")
DOUBTS = ("uncertain", "uncertainty", "不确定", "不确定部分", "不确定区域", "无法确认")
PICTURES = ("图片", "图像", "扫描件", "照片", "截图", "页面", "页", "文档", "图")
SHOWS = ("为", "是", "显示", "展示", "呈现", "描绘", "中", "看起来", "表明")


@cache
def _transcript_patterns() -> tuple[re.Pattern, ...]:
    either = lambda words: "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")"
    head, colon = r"[\s>#*-]*", r"\s*[:：]"
    pictures = either(PICTURES)
    announces = "|".join([f"{head}{either(MARKS)}{colon}\\s*$", f"{head}{either(OPENERS)}[^\n]{{0,40}}[:：]\\s*$", f"{head}{either(CHINESE_OPENERS)}[是为]?(?:这张|这份|该|此)?{either(PICTURES[:-1] + ('图中',))}的?[^\n]{{0,24}}[:：]\\s*$"])
    describes = f"(?:[该此这本上])?\\s?{pictures}(?:的内容|内容|的局部|局部)?{either(SHOWS)}"
    return re.compile(announces, re.I), re.compile(head + either(DOUBTS) + colon, re.I), re.compile(describes), re.compile(f"{pictures}|表格")


def cleaned(text: str | None) -> str:
    """A transcript without what its maker says about it: code fences; the announcement near its start and
    what precedes it, if all of that is talk; announcements and doubts wherever parts were put together;
    descriptions that an announcement follows, or that open the text. Anything else stays."""
    announces, doubts, describes, pictures = _transcript_patterns()
    lines = [x for x in (text or "").replace("\r\n", "\n").split("\n") if not re.fullmatch(r"[ \t]*```[A-Za-z0-9]*[ \t]*", x)]
    captions = lambda x: bool(describes.match(x.strip())) or x.rstrip().endswith(("。", "：", ":")) and bool(pictures.search(x))
    mark = next((i for i, x in enumerate(lines[:6]) if announces.match(x)), None)
    if mark is not None and all(doubts.match(x) or captions(x) for x in lines[:mark] if x.strip()):
        lines = lines[mark + 1 :]
    kept, after = [], ""  # from the end: the next line with content is known
    for x in reversed(lines):
        talk = announces.match(x) or doubts.match(x) or x.strip() and announces.match(after) and captions(x)
        if not talk:
            kept.append(x)
        if x.strip():
            after = x
    kept.reverse()
    while len(kept) > 1 and describes.match(kept[0].strip()):
        del kept[0]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


@F.pandas_udf(StringType())
def clean_transcript(text: pd.Series) -> pd.Series:
    """``cleaned`` of each text, in Arrow batches: what a line means depends on those around it."""
    return text.map(cleaned)
