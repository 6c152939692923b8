"""Round trips of the office formats, and readers on odd input."""

import pytest

from lakeloom.functions.blocks import block, run
from lakeloom.sources import markdown, markup, package, plain, sheetlike, slidelike, wordlike

DOC = [
    block("heading", level=2, text="A & <b>"),
    block("paragraph", runs=[run("plain "), run("bold", bold=True), run("link", link="https://x.org/?a=1&b=2")]),
    block("list", ordered=False, items=[{"level": 0, "text": "one"}, {"level": 1, "text": "two"}]),
    block("list", ordered=True, items=[{"level": 0, "text": "first"}]),
    block("table", header=False, rows=[["a", "b"], ["c", "d"]]),
    block("quote", text="said"),
]
BOOK = [{"name": "S/1", "rows": [[sheetlike.cell("x"), sheetlike.cell("1.5", "n")], [], [sheetlike.cell("TRUE", "b"), sheetlike.cell("3", "n", "=A1+1")]]}, {"name": "S_1", "rows": []}]
DECK = [slidelike.slide("T", layout="title", subtitle="sub"), slidelike.slide("U", bullets=[{"level": 0, "text": "a&b"}], rows=[["1", "2"]], notes="n1\nn2")]


def test_docx():
    blocks, meta = wordlike.read_docx(wordlike.write_docx(DOC, {"title": "T & t", "author": "me"}))
    assert blocks == DOC and meta == {"title": "T & t", "author": "me"}


def test_odt():
    blocks, meta = wordlike.read_odt(wordlike.write_odt(DOC, {"title": "T"}))
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "list", "list", "table", "paragraph"]
    assert blocks[2] == DOC[2] and blocks[4]["rows"] == DOC[4]["rows"] and meta["title"] == "T"


def test_xlsx_and_ods():
    got = sheetlike.read_xlsx(sheetlike.write_xlsx(BOOK))
    assert [s["name"] for s in got] == ["S_1", "S_1_2"]
    assert got[0]["rows"][0] == BOOK[0]["rows"][0] and got[0]["rows"][2][1]["f"].lstrip("=") == "A1+1"
    assert sheetlike.read_ods(sheetlike.write_ods(BOOK))[0]["rows"][0] == BOOK[0]["rows"][0]


def test_serials():
    assert [sheetlike.serial(x) for x in (1, 61, 45292.25)] == ["1900-01-01", "1900-03-01", "2024-01-01 06:00"]


def test_pptx_and_odp():
    assert slidelike.read_pptx(slidelike.write_pptx(DECK)) == DECK
    got = slidelike.read_odp(slidelike.write_odp(DECK))
    assert [s["title"] for s in got] == ["T", "U"] and got[1]["notes"] == "n1\nn2" and got[1]["rows"] == [["1", "2"]]


def test_packages_are_guarded():
    big = package.build({"word/a": b"0" * 2000})
    assert package.sniff(big) == "docx"
    with pytest.raises(package.Refused):
        package.members(big, package.Limits(entry_bytes=1000))
    with pytest.raises(package.Refused):
        package.sniff(package.build({"other": b""}), "x.zip")


def test_lenient_packages():
    """Data after an archive's end, a cut comment, and parts that are not well formed."""
    whole = wordlike.write_docx(DOC)
    for odd in (whole + b"x" * 100_000, whole[:-2] + b"\x05\x00cut", whole + b"\0" * 70_000):
        assert wordlike.read_docx(odd)[0] == DOC
    for bad in (b"PK\x05\x06", b"PK nothing", whole[:200]):
        with pytest.raises(package.Refused):
            package.members(bad)
    e = package.parsed(b'<?xml version="1.0"?><a x="1"><p:b>R&D \x01&amp; \xff</p:b><c>cut')
    assert [package.local(x) for x in e] == ["b", "c"] and e[0].text == "R&D & \ufffd"
    with pytest.raises(package.Refused):
        package.parsed(b"nothing")


def test_failures_are_rows(spark):
    from lakeloom.operators import convert
    from lakeloom.sources import files

    data = spark.createDataFrame([("a.md", bytearray(b"fine")), ("b.md", bytearray("no glyph \U000e0001 end".encode())), ("c.md", None)], "path string, content binary")
    got = {r.path: r for r in convert.render(files.models(data), "pdf").collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].error is None and got["a.md"].content[:5] == b"%PDF-"
    assert {r.path: r.error for r in files.models(data).collect()}["c.md"] == "no content"


def test_markdown():
    text = "# T *x*\n\na **b** `c`\nd\n\n- one\n  more\n  - two\n1. n\n\n| a | b\\|c |\n|---|---|\n| 1 | 2 |\n> q\n> r\n\n---\n```\ncode\n```\n![alt](p.png)\n\\newpage\n"
    blocks = markdown.parse(text)
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "list", "list", "table", "quote", "hr", "code", "image", "pagebreak"]
    assert blocks[0]["text"] == "T x" and blocks[2]["items"] == [{"level": 0, "text": "one more"}, {"level": 1, "text": "two"}]
    assert blocks[4]["rows"] == [["a", "b|c"], ["1", "2"]] and blocks[5]["text"] == "q\nr"
    assert markdown.parse("") == [] and markdown.parse(None) == []
    assert len(markdown.parse("-" * 2_000_000)) == 1


def test_markdown_lines():
    kinds = lambda text: [b["type"] for b in markdown.parse(text)]
    assert kinds("<PageBreak />\n\\NEWPAGE \n---page---") == ["pagebreak"] * 3 and kinds(" \\newpage") == ["paragraph"]
    assert kinds("- - -\n***\n_ __\n--\n-*-") == ["hr"] * 3 + ["paragraph"]
    assert kinds("#a\n####### b\n# \n### c") == ["paragraph", "heading", "heading"]
    assert [(b["alt"], b["name"]) for b in markdown.parse('![a b]( p.png "t" )\n![](x)\n![a](b c)\n![a](b "c"d")')[:2]] == [("a b", "p.png"), ("图片", "x")]
    assert kinds('![a](b c)\n\n![a] (b)') == ["paragraph"] * 2
    blocks = markdown.parse("* a\n\t- b\n  go on\n1) x\n2. y\n10.z\n+ p\n-q")
    assert [(b["type"], b["ordered"], [(i["level"], i["text"]) for i in b["items"] or []]) for b in blocks] == [("list", False, [(0, "a"), (2, "b go on")]), ("list", True, [(0, "x"), (0, "y")]), ("paragraph", None, []), ("list", False, [(0, "p")]), ("paragraph", None, [])]
    assert kinds("| a |\n| b |") == ["paragraph"] and kinds("|a|\n|:-:|\n|b|\nc") == ["table", "paragraph"] and kinds("```\nopen") == ["code"]


def test_html():
    blocks, meta = markup.parse("<title>t</title><p>a<b>b<p>c<ul><li>x<ul><li>y</ul><li>z</ul><table><tr><th>h<td>1</table><p hidden>no</p><a href='javascript:x'>l</a>")
    assert meta["title"] == "t"
    assert [b["type"] for b in blocks] == ["paragraph", "paragraph", "list", "table", "paragraph"]
    assert blocks[2]["items"] == [{"level": 0, "text": "x"}, {"level": 1, "text": "y"}, {"level": 0, "text": "z"}]
    assert blocks[4]["runs"][0]["link"] is None
    assert markup.parse(None) == ([], {})


def test_html_marks_end_with_their_block():
    bold = lambda html: [(r["text"], bool(r["bold"])) for b in markup.parse(html)[0] for r in b["runs"] or []]
    assert bold("<article><p><b>a<br></article><footer>f</footer>") == [("a", True), ("f", False)]
    assert bold("<p><b>a<p>b") == [("a", True), ("b", False)] and bold("<b><p>a</p><p>b</p></b>c") == [("a", True), ("b", True), ("c", False)]
    assert bold("<div>x<b>y</div>z") == [("x", False), ("y", True), ("z", False)]


def test_plain():
    assert plain.decode("中文".encode("gb18030")) == "中文" and plain.decode("é".encode("utf-16")) == "é"
    assert plain.rows('a;"b;\n,,,c"\n\nd\r\ne;f;g') == [["a", "b;\n,,,c"], ["d"], ["e", "f", "g"]]
    assert plain.delimited([["a,b", ' "x"', None]]) == '﻿"a,b"," ""x""",\r\n'.encode()
    assert plain.delimited([["a\tb\nc\td"]], "\t", False) == b"a b c d\r\n"
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}caf\'e9\par \u20013?\b x\b0\tab {\*\gen y}z}"
    assert plain.rtf(rtf) == "café\n中x\tz"


def test_page():
    from lakeloom.sources import page

    again, meta = markup.parse(page.render(DOC, {"title": "T & t"}))
    assert again == DOC and meta["title"] == "T & t"


def test_pdf():
    from lakeloom.sources import pdf

    blocks = [block("heading", level=1, text="Title (x)"), block("paragraph", runs=[run("body text " * 40)]), block("pagebreak"), block("list", ordered=True, items=[{"level": 0, "text": "one"}])]
    pages = pdf.read(pdf.write(blocks))
    assert len(pages) == 2 and pages[0]["text"].startswith("# Title (x)") and pages[0]["text"].count("body") == 40 and pages[1]["text"] == "1. one"
    with pytest.raises(package.Refused):
        pdf.read(b"%PDF-1.4 trailer << /Encrypt 1 0 R >>")


def test_image_sizes():
    import struct

    from lakeloom.sources import image

    assert image.size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == ("png", 3, 4)
    assert image.size(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert image.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 8, 7) + b"\0") == ("jpeg", 7, 8)
    assert image.size(b"BM") is None and image.size(b"x") is None


def test_html_references_end_with_a_semicolon():
    """Cut references stay text, known whole ones are read, and links keep their parameters."""
    blocks, meta = markup.parse('<title>a &amp;&amp</title><p>x &lt y &notit; &copy &copy; &#39; &#60 &&amp;lt; <a href="http://x/?a=1&copy=2&amp;b">l</a>&am')
    assert meta["title"] == "a &&amp"
    assert "".join(r["text"] for r in blocks[0]["runs"]) == "x &lt y &notit; &copy © ' &#60 &&lt; l&am"
    assert [r["link"] for r in blocks[0]["runs"] if r["link"]] == ["http://x/?a=1&copy=2&b"]


def test_html_queries_on_cut_references(spark, tmp_path):
    """The page queries against their SQL where titles are cut within a reference."""
    import oracle
    from lakeloom import catalog

    page = "<html><head><title>{0}</title></head><body><nav><ul><li><a href=\"/a\">a</a></li></ul></nav><article><h1>{0}</h1><p><b>b &quot;x&quot;<br></article></body></html>"
    titles = ["t &amp;&amp", "t &am", "t &quot;x&quot;", "t &quo", "&lt;t&gt; &amp;lt;"]
    spark.createDataFrame([(i, page.format(t)) for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_title", "html_markdown", "html_plaintext", "file_inventory"):
        assert oracle.compare(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name], con) == "", name
