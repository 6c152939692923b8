"""Bytes to text, delimited text to rows, RTF to text."""

from __future__ import annotations

import codecs
import csv
import io
import re

# The order in which encodings are tried, and the bytes of byte order marks.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
ENCODINGS = ("utf-8", "gb18030", "big5", "shift_jis", "windows-1252")


def decode(data: bytes) -> str:
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def delimiter(text: str) -> str:
    """The commonest of comma, tab and semicolon outside quotes in the first 4096 characters."""
    outside = re.sub(r'"[^"]*"?', "", text[:4096])
    return max(",\t;", key=outside.count)


def rows(text: str, sep: str | None = None) -> list[list[str]]:
    """Rows of delimited text, ragged as they are; rows of one empty field are dropped."""
    found = csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n")), delimiter=sep or delimiter(text))
    return [r for r in found if r and r != [""]]


def delimited(table: list[list], sep: str = ",", mark: bool = True) -> bytes:
    """RFC 4180 with CRLF; a tab-separated file has its tabs and line ends replaced by spaces instead."""

    def cell(v) -> str:
        s = "" if v is None else str(v)
        if sep == "\t":
            return re.sub(r"[\t\r\n]+", " ", s)
        return '"' + s.replace('"', '""') + '"' if re.search(r'^\s|\s$|[,"\r\n]', s) else s

    text = "".join(sep.join(map(cell, r)) + "\r\n" for r in table)
    return (codecs.BOM_UTF8 if mark else b"") + text.encode()


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
# Groups that hold no text, and words that stand for white space.
RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "listtable", "listoverridetable"}
RTF_SPACE = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "row": "\n"}


def rtf(data: bytes) -> str:
    """The text of an RTF file."""
    out: list[str] = []
    page, stack, state, pending, skip_chars = "cp1252", [], {"skip": False, "uc": 1}, bytearray(), 0
    for word, number, code, symbol, brace, text in _RTF.findall(data.decode("latin-1")):
        if pending and not code:
            out.append(pending.decode(page, "replace"))
            pending.clear()
        if brace == "{":
            stack.append(dict(state))
        elif brace == "}":
            state = stack.pop() if stack else state
        elif word == "ansicpg":
            page = f"cp{number}" if _known(f"cp{number}") else page
        elif word == "uc":
            state["uc"] = int(number or 1)
        elif word in RTF_SKIP or symbol == "*":
            state["skip"] = True
        elif state["skip"]:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip_chars = state["uc"]
        elif word:
            out.append(RTF_SPACE.get(word, ""))
        elif code:
            if skip_chars:
                skip_chars -= 1
            else:
                pending.append(int(code, 16))
        elif symbol:
            out.append({"~": "\xa0", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif text:
            out.append(text[skip_chars:])
            skip_chars = max(0, skip_chars - len(text))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def _known(name: str) -> bool:
    try:
        return bool(codecs.lookup(name))
    except LookupError:
        return False
