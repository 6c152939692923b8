"""Readers of the binary office formats on files built to their specifications."""

import pytest

from lakeloom.sources import compound, files, legacy, package


def test_doc():
    pieces = [("Caf\xe9 \x13 HYPERLINK x\x14shown\x15 \x13 PAGE \x15end\r", True), ("中文\x0b二\ta\x07b\x07\r", False), ("x" * 9000 + "\r", True)]
    got = files.load(compound.word_file(pieces), "a.doc")
    assert got["error"] is None and got["format"] == "doc" and got["model"] == "document"
    assert [b["runs"][0]["text"] for b in got["blocks"]] == ["Café shown end", "中文", "二 a | b |", "x" * 9000]


@pytest.mark.parametrize("cut", [0, 3, 4])
def test_xls(cut):
    book = [("One", [["a", 1, -2.5, True], [], ["=text", ("date", 45292.25), -7]]), ("二", [["b" * 400, "中" * 300 if cut == 4 else "wide text"]])]
    got = files.load(compound.excel_file(book, cut), "a.xls")
    assert got["error"] is None and [s["name"] for s in got["sheets"]] == ["One", "二"]
    one, two = ([[(c["v"], c["t"]) for c in r] for r in s["rows"]] for s in got["sheets"])
    assert one == [[("a", "s"), ("1", "n"), ("-2.5", "n"), ("TRUE", "b")], [], [("text", "s"), ("2024-01-01 06:00", "d"), ("-7", "n")]]
    assert two == [[("b" * 400, "s"), (book[1][1][0][1], "s")]]


def test_numbers_of_30_bits():
    assert [legacy._small_number(x) for x in (5 << 2 | 2, 0xFFFFFFFC - 4 * 6 | 2, 1234 << 2 | 3, 0x3FF00000, 0x40590000 | 1)] == [5.0, -7.0, 12.34, 1.0, 1.0]


def test_ppt():
    got = files.load(compound.slides_file([["Title", "one\rtwo"], ["标题", "点"], ["", " "]]), "a.ppt")
    assert [(s["title"], [b["text"] for b in s["bullets"]]) for s in got["slides"]] == [("Title", ["one", "two"]), ("标题", ["点"])]


def test_broken_compound_files():
    whole = compound.excel_file([("S", [["a" * 200, 1.5] for _ in range(60)])])
    for at in (100, 512, 700, len(whole) // 2, len(whole) - 600):
        files.load(whole[:at], "a.xls")  # ends, with an error or with less
    assert files.load(compound.compound({"Other": b"x"}), "x.doc")["error"].startswith("a compound file")
    with pytest.raises(package.Refused):
        legacy.streams(b"\xd0\xcf\x11\xe0" + b"\0" * 600)
    word = bytearray(compound.word_file([("secret\r", True)]))
    at = word.index(b"\xec\xa5") + 10
    word[at + 1] |= 1
    assert "encrypted" in files.load(bytes(word), "a.doc")["error"]
