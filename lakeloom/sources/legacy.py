"""Binary office files of the compound format: doc, xls and ppt, read only.

Layouts follow Microsoft's published specifications (MS-CFB, MS-DOC, MS-XLS, MS-PPT). Encrypted files are
refused. Every offset is checked against the data, so a damaged file ends in an error or in less text.
"""

from __future__ import annotations

import re
import struct

from lakeloom.sources.package import Refused
from lakeloom.sources.sheetlike import DATES, _trim, cell, serial
from lakeloom.sources.slidelike import slide

FREE = 0xFFFFFFFA  # sector numbers from here on are marks


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if len(data) < 512 or data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise Refused("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    first_dir, _, cutoff, first_small, _, first_more, _ = struct.unpack_from("<7I", data, 48)
    if not 7 <= shift <= 16 or not 2 <= small_shift <= shift:
        raise Refused("a compound file of odd sectors")
    size = 1 << shift
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    table = [k for k in struct.unpack_from("<109I", data, 76) if k < FREE]
    most = len(data) // size + 1
    for _ in range(most):  # where the allocation table's own sectors are named on
        if first_more >= FREE:
            break
        *own, first_more = numbers(sector(first_more)) or [FREE]
        table += [k for k in own if k < FREE]
    fat = [x for k in table for x in numbers(sector(k))]

    def chain(k: int, of: list[int], limit: int) -> list[int]:
        out = []
        while k < FREE and k < len(of) and len(out) <= limit:
            out.append(k)
            k = of[k]
        return out

    whole = lambda k: b"".join(map(sector, chain(k, fat, most)))
    entries = []
    listing = whole(first_dir)
    for at in range(0, len(listing) - 127, 128):
        (length,) = struct.unpack_from("<H", listing, at + 64)
        start, n = struct.unpack_from("<IQ", listing, at + 116)
        entries.append((listing[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), listing[at + 66], start, n & 0xFFFFFFFF if shift == 9 else n))
    root = next((e for e in entries if e[1] == 5), None)
    small, small_fat = (whole(root[2]) if root else b""), numbers(whole(first_small))
    out: dict[str, bytes] = {}
    for name, kind, start, n in entries:
        if kind == 2 and name not in out:
            if n < cutoff:
                step = 1 << small_shift
                out[name] = b"".join(small[k * step : (k + 1) * step] for k in chain(start, small_fat, len(small) >> small_shift))[:n]
            else:
                out[name] = whole(start)[:n]
    return out


def kind(found: dict[str, bytes]) -> str:
    for name, what in (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")):
        if name in found:
            return what
    raise Refused("a compound file that is no office document")


def doc_text(found: dict[str, bytes]) -> str:
    """The text of a Word file: its pieces in order, fields by their results."""
    main = found["WordDocument"]
    if len(main) < 0x1AA:
        raise Refused("a Word file without its header")
    (flags,) = struct.unpack_from("<H", main, 10)
    if flags & 0x100:
        raise Refused("an encrypted Word file")
    table = found.get("1Table" if flags & 0x200 else "0Table", b"")
    at, n = struct.unpack_from("<II", main, 0x1A2)
    parts, info = [], table[at : at + n]
    while info[:1] == b"\x01":  # properties come before the pieces
        info = info[3 + struct.unpack_from("<H", info, 1)[0] :]
    if info[:1] == b"\x02":
        count = (struct.unpack_from("<I", info, 1)[0] - 4) // 12
        ends = struct.unpack_from(f"<{count + 1}I", info, 5)
        for k in range(count):
            (place,) = struct.unpack_from("<I", info, 5 + 4 * (count + 1) + 8 * k + 2)
            size = ends[k + 1] - ends[k]
            if place & 0x40000000:
                start = (place & 0x3FFFFFFF) // 2
                parts.append(main[start : start + size].decode("cp1252", "replace"))
            else:
                parts.append(main[place : place + 2 * size].decode("utf-16-le", "replace"))
    text = "".join(parts)
    if not text.strip():
        raise Refused("a Word file without text")
    before = None
    while before != text:  # the innermost fields first
        before = text
        text = re.sub(r"\x13[^\x13-\x15]*\x14([^\x13-\x15]*)\x15", r"\1", text)
        text = re.sub(r"\x13[^\x13-\x15]*\x15", "", text)
    text = re.sub(r"[\r\x0b\x0c\x1e]", "\n", text).replace("\x07", " | ").replace("\x1f", "").replace("\x1e", "-")
    return re.sub(r" {2,}", " ", re.sub(r"[\x00-\x08\x0e-\x1d]", "", re.sub(r"\t+", " ", text)))


class _Strings:
    """Strings that run on from record to record."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def _left(self) -> int:
        return len(self.parts[self.part]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, size: str = "<H") -> str:
        (n,) = struct.unpack(size, self.take(struct.calcsize(size)))
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n > 0 and self.part < len(self.parts):
            if not self._left():  # the next record says anew how wide its characters are
                self.part, self.at = self.part + 1, 0
                if self.part == len(self.parts):
                    break
                wide = self.take(1)[0] & 1
            got = self.take(min(n << wide, self._left()))
            out.append(got.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= max(1, len(got) >> wide)
        self.take(4 * runs + more)
        return "".join(out)


# Codes of errors in cells.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def _small_number(rk: int) -> float:
    """A number of 30 bits: a whole one, or the upper part of a double; perhaps in hundredths."""
    x = float((rk >> 2) - (1 << 30 if rk & 0x80000000 else 0)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else x


def sheets(found: dict[str, bytes]) -> list[dict]:
    """The worksheets of an Excel file (BIFF8), each read from the place that its name's record tells."""
    data = found.get("Workbook") or found.get("Book") or b""
    records: dict[int, tuple[int, bytes, int]] = {}
    at = 0
    while at + 4 <= len(data):
        code, n = struct.unpack_from("<HH", data, at)
        if not code and not n:
            break
        records[at] = (code, data[at + 4 : at + 4 + n], at + 4 + n)
        at += 4 + n
    shared: list[str] = []
    names: list[tuple[str, int]] = []
    formats: dict[int, str] = {}
    styles: list[int] = []
    ordered = list(records.values())
    for i, (code, body, _) in enumerate(ordered):
        if code == 0x2F:
            raise Refused("an encrypted Excel file")
        if code == 0xFC:
            parts = [body[8:]]
            for more, rest, _ in ordered[i + 1 :]:
                if more != 0x3C:
                    break
                parts.append(rest)
            reader = _Strings(parts)
            for _ in range(struct.unpack_from("<I", body, 4)[0]):
                if reader.part >= len(parts):
                    break
                shared.append(reader.text())
        elif code == 0x85 and not body[5]:  # a worksheet, not a chart or macros
            names.append((_Strings([body[6:]]).text("<B"), struct.unpack_from("<I", body)[0]))
        elif code == 0x41E:
            formats[struct.unpack_from("<H", body)[0]] = _Strings([body[2:]]).text()
        elif code == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])

    def dated(style: int) -> bool:
        k = styles[style] if style < len(styles) else 0
        spec = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(k, ""))
        return k in DATES or spec.lower() != "general" and bool(re.search(r"[ymdhs]", spec, re.I))

    def number(x: float, style: int) -> dict:
        if dated(style) and 1 <= x < 2958466:
            return cell(serial(x), "d")
        return cell(str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x), "n")

    def truth_or_error(value: int, error: int) -> dict:
        return cell(ERRORS.get(value, "#ERR"), "e") if error else cell("TRUE" if value else "FALSE", "b")

    out = []
    for name, start in names:
        grid: dict[tuple[int, int], dict] = {}
        waiting, depth, at = None, 0, start
        while at in records:
            code, body, at = records[at]
            depth += (code == 0x809) - (code == 0x0A)
            if not depth:
                break
            if code == 0x207 and waiting:  # the text of the formula before
                grid[waiting] = cell(_Strings([body]).text(), "s")
            if depth != 1 or len(body) < 6 or code not in (0xFD, 0x203, 0x27E, 0x204, 0xD6, 0x205, 0x06, 0xBD):
                continue
            row, col, style = struct.unpack_from("<HHH", body)
            waiting = None
            if code == 0xFD:
                k = struct.unpack_from("<I", body, 6)[0]
                made = cell(shared[k] if k < len(shared) else "", "s")
            elif code == 0x203:
                made = number(struct.unpack_from("<d", body, 6)[0], style)
            elif code == 0x27E:
                made = number(_small_number(struct.unpack_from("<I", body, 6)[0]), style)
            elif code in (0x204, 0xD6):
                made = cell(_Strings([body[6:]]).text(), "s")
            elif code == 0x205:
                made = truth_or_error(body[6], body[7])
            elif code == 0xBD:
                for k in range((len(body) - 6) // 6):
                    style, rk = struct.unpack_from("<HI", body, 4 + 6 * k)
                    grid[row, col + k] = number(_small_number(rk), style)
                continue
            elif body[12:14] == b"\xff\xff":
                made = {1: truth_or_error(body[8], 0), 2: truth_or_error(body[8], 1)}.get(body[6], cell(""))
                waiting = (row, col) if body[6] == 0 else None
            else:
                made = number(struct.unpack_from("<d", body, 6)[0], style)
            grid[row, col] = made
        width = max((c for _, c in grid), default=-1) + 1
        rows = [[grid.get((r, c)) or cell("") for c in range(width)] for r in range(max((r for r, _ in grid), default=-1) + 1)]
        out.append({"name": name, "rows": _trim(rows)})
    return out


def slides(found: dict[str, bytes]) -> list[dict]:
    """The texts of a PowerPoint file by slide; the first of a slide is its title."""
    listed: list[list[str]] = []  # from the outline
    drawn: list[list[str]] = []  # from the slides themselves

    def walk(data: bytes, into: list[list[str]] | None, outline: bool) -> None:
        at = 0
        while at + 8 <= len(data):
            mark, code, n = struct.unpack_from("<HHI", data, at)
            if not mark and not code and not n:
                break
            body, at = data[at + 8 : at + 8 + n], at + 8 + n
            if code == 0x03EE:  # a slide
                drawn.append([])
                walk(body, drawn, False)
            elif code == 0x0FF0:  # a list of slides, masters or notes, by its number
                walk(body, listed if mark >> 4 == 0 else None, True)
            elif code == 0x03F3 and outline and into is not None:
                into.append([])
            elif code in (0x0FA0, 0x0FA8) and into:
                into[-1].append(body.decode("utf-16-le" if code == 0x0FA0 else "cp1252", "replace"))
            elif mark & 15 == 15 and code not in (0x03F0, 0x03F8):  # a container other than notes and masters
                walk(body, into, outline)

    walk(found["PowerPoint Document"], None, False)
    out = []
    for k in range(max(len(listed), len(drawn))):
        texts = [*(listed[k] if k < len(listed) else []), *(drawn[k] if k < len(drawn) else [])]
        lines = [x.strip() for t in texts for x in re.split(r"[\r\n\x0b]+", t) if x.strip()]
        if lines:
            out.append(slide(lines[0], bullets=[{"level": 0, "text": x} for x in lines[1:]]))
    if not out:
        raise Refused("a PowerPoint file without text")
    return out
