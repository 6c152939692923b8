"""Edits of packages: what they change, and that the rest stays."""

import struct
import zipfile
import io
import zlib

import pytest

from lakeloom.functions.blocks import block, run
from lakeloom.sources import package, repack, sheetlike, slidelike, wordlike

DOC = [block("heading", level=1, text="Plan"), block("paragraph", runs=[run("the old "), run("na", bold=True), run("me & co <x>")]), block("table", header=False, rows=[["old name", "b"]]), block("paragraph", runs=[run("end")])]


def png(width: int, height: int) -> bytes:
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + piece(b"IEND", b"")


def parts(data: bytes) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    return {n: z.read(n) for n in z.namelist()}


@pytest.mark.parametrize("kind", ["docx", "odt"])
def test_replace_across_runs(kind):
    write, read = (wordlike.write_docx, wordlike.read_docx) if kind == "docx" else (wordlike.write_odt, wordlike.read_odt)
    old = write(DOC, {"title": "T"})
    new, counts = repack.apply(old, f"a.{kind}", [{"op": "replace_text", "find": "old name", "replace": "new & <b>"}, {"op": "replace_text", "find": "[x-z]>", "replace": "$1\\", "regex": True}])
    blocks, meta = read(new)
    assert counts == [2, 1] and meta["title"] == "T"
    assert "".join(r["text"] for r in blocks[1]["runs"]) == "the new & <b> & co <$1\\" and blocks[2]["rows"][0][0] == "new & <b>"
    a, b = parts(old), parts(new)
    assert a.keys() == b.keys() and [n for n in a if a[n] != b[n]] == ["word/document.xml" if kind == "docx" else "content.xml"]
    assert repack.apply(old, f"a.{kind}", [{"op": "replace_text", "find": "absent", "replace": ""}])[1] == [0]


def test_replace_in_workbooks_and_decks():
    book = sheetlike.write_xlsx([{"name": "S", "rows": [[sheetlike.cell("old a"), sheetlike.cell("1", "n")]]}])
    new, counts = repack.apply(book, "a.xlsx", [{"op": "replace_text", "find": "old", "replace": "new"}])
    assert counts == [1] and sheetlike.read_xlsx(new)[0]["rows"][0][0]["v"] == "new a"
    deck = slidelike.write_pptx([slidelike.slide("old t", notes="old n", rows=[["old c"]])])
    new, counts = repack.apply(deck, "a.pptx", [{"op": "replace_text", "find": "old", "replace": "new"}])
    one = slidelike.read_pptx(new)[0]
    assert counts == [3] and (one["title"], one["notes"], one["rows"]) == ("new t", "new n", [["new c"]])


@pytest.mark.parametrize("kind", ["docx", "odt"])
def test_append_markdown(kind):
    write, read = (wordlike.write_docx, wordlike.read_docx) if kind == "docx" else (wordlike.write_odt, wordlike.read_odt)
    new, counts = repack.apply(write(DOC), f"a.{kind}", [{"op": "append_markdown", "text": "## More\n\n- a\n- b\n\n[l](https://x.org)"}])
    blocks, _ = read(new)
    assert counts == [3] and [b["type"] for b in blocks[-3:]] == ["heading", "list", "paragraph"] and blocks[3]["runs"][0]["text"] == "end"
    assert [i["text"] for i in blocks[-2]["items"]] == ["a", "b"]


def test_pictures():
    data = png(1200, 300)
    new, counts = repack.apply(wordlike.write_docx(DOC), "a.docx", [{"op": "insert_image", "data": data, "alt": "A & b", "after": "the old"}, {"op": "insert_image", "data": data, "after": "absent"}, {"op": "insert_image", "data": data}])
    blocks, _ = wordlike.read_docx(new)
    assert counts == [1, 0, 1]
    assert ["[图片]" in "".join(r["text"] for r in b["runs"] or []) for b in blocks] == [False, False, True, False, False, True, True]
    z = parts(new)
    assert [n for n in z if n.startswith("word/media/")] == ["word/media/added1.png"] and z["word/media/added1.png"] == data
    assert z["word/_rels/document.xml.rels"].count(b"/image") == 3 and len(set(z["word/document.xml"].split(b"wp:docPr id=")[1:])) == 3
    assert b'Extension="png"' in z["[Content_Types].xml"] and b'cx="5731510"' in z["word/document.xml"]
    with pytest.raises(package.Refused):
        repack.apply(new, "a.docx", [{"op": "insert_image", "data": b"no picture"}])


def test_written_pictures_and_grids():
    blocks = [block("paragraph", runs=[run("a")]), block("image", alt="A", name="p.png"), block("image", alt="B", name="absent.png"), block("image", alt="C", name="p.png"), block("paragraph", runs=[run("z")])]
    data = wordlike.write_docx(blocks, {"title": "T"}, {"p.png": png(10, 20)}, lines=40, characters=30)
    got, meta = wordlike.read_docx(data)
    assert ["".join(r["text"] for r in b["runs"]) for b in got] == ["a", "[图片]", "![B](absent.png)", "[图片]", "z"] and meta["title"] == "T"
    z = parts(data)
    assert sum(n.startswith("word/media/") for n in z) == 1 and b'<w:docGrid w:type="linesAndChars" w:linePitch="349" w:charSpace="' in z["word/document.xml"]
    assert b"docGrid" not in parts(wordlike.write_docx(blocks))["word/document.xml"] and b'w:type="lines" w:linePitch="698"/>' in parts(wordlike.write_docx([], lines=20))["word/document.xml"]


def test_slides():
    deck = slidelike.write_pptx([slidelike.slide("one", layout="title", subtitle="s"), slidelike.slide("two")])
    edits = [{"op": "add_slide", "slide": {"title": "first", "bullets": [{"level": 0, "text": "b"}]}, "index": 1}, {"op": "add_slide", "slide": {"title": "last"}}, {"op": "update_slide", "index": 2, "title": "ONE & only", "subtitle": "S"}, {"op": "delete_slide", "index": 3}, {"op": "set_meta", "title": "deck"}]
    new, counts = repack.apply(deck, "a.pptx", edits)
    got = slidelike.read_pptx(new)
    assert counts == [1, 1, 2, 1, 1] and [(s["title"], s["subtitle"]) for s in got] == [("first", None), ("ONE & only", "S"), ("last", None)] and got[0]["bullets"] == [{"level": 0, "text": "b"}]
    only, _ = repack.apply(deck, "a.pptx", [{"op": "delete_slide", "index": 1}])
    for bad in ({"op": "delete_slide", "index": 1}, {"op": "delete_slide", "index": 5}, {"op": "add_slide", "slide": {}, "index": 9}, {"op": "update_slide", "index": 0, "title": ""}):
        with pytest.raises(package.Refused):
            repack.apply(only, "a.pptx", [bad])


def test_decks_have_all_that_they_refer_to():
    z = package.members(slidelike.write_pptx([slidelike.slide("a", notes="n"), slidelike.slide("b", layout="title")]))
    names = set(z.namelist())
    for rels in [n for n in names if n.endswith(".rels")]:
        part = rels.replace("_rels/", "", 1).removesuffix(".rels") if rels != "_rels/.rels" else ""
        folder = part.rpartition("/")[0]
        for target in package.relations(z, part).values() if part else ["ppt/presentation.xml"]:
            assert target in names, (folder, target)
    listed = z.read("[Content_Types].xml").decode()
    assert all(f'PartName="/{n}"' in listed for n in names if n.startswith("ppt/") and not n.endswith(".rels"))
