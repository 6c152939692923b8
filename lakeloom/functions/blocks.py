"""The document model: one row a document, its blocks an array of structs of one wide type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,code:boolean,link:string>"
ITEM = "struct<level:int,text:string>"
BLOCK = f"struct<type:string,level:int,text:string,ordered:boolean,header:boolean,items:array<{ITEM}>,rows:array<array<string>>,runs:array<{RUN}>,alt:string,name:string>"
SLIDE = f"struct<layout:string,title:string,subtitle:string,bullets:array<{ITEM}>,rows:array<array<string>>,notes:string,images:int>"
FIELDS = ("type", "level", "text", "ordered", "header", "items", "rows", "runs", "alt", "name")


def block(kind: str, **values) -> dict:
    """A block for Python readers; fields that are not given are null."""
    return {f: values.get(f) for f in FIELDS} | {"type": kind}


def run(text: str, **marks) -> dict:
    return {"text": text, "bold": None, "italic": None, "underline": None, "strike": None, "code": None, "link": None} | marks


def _when(flag: Column, text: Column, mark: str) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)


def run_markdown(r: Column) -> Column:
    t = r["text"]
    for field, mark in (("code", "`"), ("bold", "**"), ("italic", "*"), ("strike", "~~")):
        t = _when(r[field], t, mark)
    return F.when(r["link"].isNotNull(), F.concat(F.lit("["), t, F.lit("]("), r["link"], F.lit(")"))).otherwise(t)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def table_markdown(rows: Column) -> Column:
    """A Markdown table; short rows are filled up, the first row is the head."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\\\|"), r"\r?\n", "<br>")
    full = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: escape(F.get(r, i))))
    lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def to_markdown(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        mark = F.when(F.coalesce(b["ordered"], F.lit(False)), "1. ").otherwise("- ")
        item = lambda it: F.concat(F.repeat(F.lit("  "), F.coalesce(it["level"], F.lit(0))), mark, it["text"])
        return (
            F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), F.least(b["level"], F.lit(6))), F.lit(" "), b["text"]))
            .when(b["type"] == "paragraph", F.array_join(F.transform(b["runs"], run_markdown), ""))
            .when(b["type"] == "list", F.array_join(F.transform(b["items"], item), "\n"))
            .when(b["type"] == "table", table_markdown(b["rows"]))
            .when(b["type"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .when(b["type"] == "quote", F.array_join(F.transform(F.split(F.coalesce(b["text"], runs_text(b["runs"])), "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
            .when(b["type"] == "hr", "---").when(b["type"] == "pagebreak", "<!-- pagebreak -->")
            .when(b["type"] == "image", F.concat(F.lit("!["), F.coalesce(b["alt"], F.lit("图片")), F.lit("]("), F.coalesce(b["name"], F.lit("")), F.lit(")")))
            .otherwise(F.coalesce(b["text"], F.lit("")))
        )

    whole = F.array_join(F.transform(blocks, one), "\n\n")
    return F.concat(F.trim(F.regexp_replace(whole, "\n{3,}", "\n\n")), F.lit("\n"))


def to_text(blocks: Column) -> Column:
    """Plain text: tables by tabs, list items indented by level, images named."""

    def one(b: Column) -> Column:
        item = lambda it: F.concat(F.repeat(F.lit("    "), F.least(F.coalesce(it["level"], F.lit(0)), F.lit(6))), it["text"])
        return (
            F.when(b["type"] == "list", F.array_join(F.transform(b["items"], item), "\n"))
            .when(b["type"] == "table", F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t", "")), "\n"))
            .when(b["type"] == "image", F.concat(F.lit("[图片："), F.coalesce(b["alt"], F.lit("")), F.lit("]")))
            .otherwise(F.coalesce(b["text"], runs_text(b["runs"]), F.lit("")))
        )

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x != ""), "\n")


def degrade_images(blocks: Column) -> tuple[Column, Column]:
    """Images as literal text for targets that cannot hold them, and how many there were."""
    note = lambda b: b.withField("type", F.lit("paragraph")).withField("runs", F.from_json(F.to_json(F.array(F.struct(F.concat(F.lit("!["), b["alt"], F.lit("]("), b["name"], F.lit(")")).alias("text")))), f"array<{RUN}>"))
    image = lambda b: b["type"] == "image"
    return F.transform(blocks, lambda b: F.when(image(b), note(b)).otherwise(b)), F.size(F.filter(blocks, image))


def stats(blocks: Column) -> Column:
    """blocks, characters (each text once) and the first 20 headings."""
    length = lambda b: F.coalesce(F.length(b["text"]), F.length(runs_text(b["runs"])), F.lit(0)) + F.coalesce(F.aggregate(b["items"], F.lit(0), lambda a, i: a + F.length(i["text"])), F.lit(0)) + F.coalesce(F.aggregate(F.flatten(b["rows"]), F.lit(0), lambda a, c: a + F.length(c)), F.lit(0))
    titles = F.slice(F.transform(F.filter(blocks, lambda b: b["type"] == "heading"), lambda b: b["text"]), 1, 20)
    return F.struct(F.size(blocks).alias("blocks"), F.aggregate(blocks, F.lit(0), lambda a, b: a + length(b)).alias("characters"), titles.alias("titles"))


def paragraphs(text: Column) -> Column:
    """Blocks of the non-empty lines of a text."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.from_json(F.to_json(F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(x.alias("text"))).alias("runs")))), f"array<{BLOCK}>")


def to_slides(blocks: Column) -> Column:
    """Slides: a heading of level 1 or 2 opens one, a rule closes it, the first has layout title."""
    zero = F.struct(F.from_json(F.lit("[]"), f"array<{SLIDE}>").alias("done"), F.lit(False).alias("open"))

    def slide(title: Column, first: Column) -> Column:
        return F.struct(F.when(first, "title").otherwise("content").alias("layout"), title.alias("title"), F.lit(None).cast("string").alias("subtitle"), F.from_json(F.lit("[]"), f"array<{ITEM}>").alias("bullets"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("int").alias("images"))

    def lines(b: Column) -> Column:
        own = F.when(b["type"] == "list", b["items"]).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.coalesce(b["text"], runs_text(b["runs"]), F.lit("")).alias("text"))))
        return F.filter(own, lambda i: F.trim(i["text"]) != "")

    def step(a: Column, b: Column) -> Column:
        opens = (b["type"] == "heading") & (b["level"] <= 2)
        fresh = F.concat(a["done"], F.array(slide(b["text"], F.size(a["done"]) == 0)))
        ready = F.when(a["open"], a["done"]).otherwise(F.concat(a["done"], F.array(slide(F.lit(""), F.size(a["done"]) == 0))))
        last = F.element_at(ready, -1)
        fuller = last.withField("bullets", F.concat(last["bullets"], lines(b)))
        fuller = F.when(b["type"] == "table", last.withField("rows", b["rows"])).otherwise(fuller)
        added = F.concat(F.slice(ready, F.lit(1), F.size(ready) - 1), F.array(fuller))
        done = F.when(opens, fresh).when(b["type"].isin("hr", "pagebreak"), a["done"]).otherwise(added)
        return F.struct(done.alias("done"), (~b["type"].isin("hr", "pagebreak")).alias("open"))

    return F.aggregate(blocks, zero, step, lambda a: a["done"])


def normalised(blocks: Column) -> Column:
    """Blocks with their defaults in place: a type, levels, runs for paragraphs and quotes that have text
    alone, lists that are ordered or not, tables with or without a head."""

    def one(b: Column) -> Column:
        kind = F.coalesce(b["type"], F.lit("paragraph"))
        text = F.coalesce(b["text"], F.lit(""))
        single = F.from_json(F.to_json(F.array(F.struct(text.alias("text")))), f"array<{RUN}>")
        level = F.least(F.greatest(F.coalesce(b["level"], F.lit(1)), F.lit(1)), F.lit(6))
        items = F.transform(F.coalesce(b["items"], F.from_json(F.lit("[]"), f"array<{ITEM}>")), lambda i: F.struct(F.coalesce(i["level"], F.lit(0)).alias("level"), F.coalesce(i["text"], F.lit("")).alias("text")))
        full = b.withField("type", kind).withField("level", F.when(kind == "heading", level).otherwise(b["level"]))
        full = full.withField("text", F.when(kind.isin("heading", "code"), text).otherwise(b["text"]))
        full = full.withField("runs", F.when((kind == "paragraph") & b["runs"].isNull(), single).otherwise(b["runs"]))
        full = full.withField("items", F.when(kind == "list", items).otherwise(b["items"]))
        full = full.withField("ordered", F.when(kind == "list", F.coalesce(b["ordered"], F.lit(False))).otherwise(b["ordered"]))
        full = full.withField("rows", F.when(kind == "table", F.transform(F.coalesce(b["rows"], F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))).otherwise(b["rows"]))
        return full.withField("header", F.when(kind == "table", F.coalesce(b["header"], F.lit(False))).otherwise(b["header"]))

    return F.transform(F.filter(blocks, lambda b: b.isNotNull()), one)


def sheet_stats(sheets: Column) -> Column:
    """Of each sheet its name, rows and most columns."""
    return F.transform(sheets, lambda s: F.struct(s["name"].alias("name"), F.size(s["rows"]).alias("rows"), F.coalesce(F.array_max(F.transform(s["rows"], lambda r: F.size(r))), F.lit(0)).alias("columns")))


def slide_stats(slides: Column) -> Column:
    """Number of slides, of pictures, and the first 20 titles."""
    titles = F.slice(F.filter(F.transform(slides, lambda s: s["title"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1, 20)
    return F.struct(F.size(slides).alias("slides"), F.aggregate(slides, F.lit(0), lambda a, s: a + F.coalesce(s["images"], F.lit(0))).alias("images"), titles.alias("titles"))
