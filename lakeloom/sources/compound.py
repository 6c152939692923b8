"""Builds small compound files, for queries and tests over formats that are only read."""

from __future__ import annotations

import struct


def compound(parts: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; short streams share the small ones, as they must."""
    sectors: list[bytes] = []
    fat: list[int] = []
    end, unused = 0xFFFFFFFE, 0xFFFFFFFF

    def store(data: bytes) -> int:
        n = -(-len(data) // 512)
        first = len(sectors)
        sectors.extend(data[512 * k : 512 * (k + 1)].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), end] if n else [])
        return first if n else end

    small, small_fat, rows = b"", [], []
    for name, data in parts.items():
        if len(data) < 4096:
            k, n = len(small) // 64, -(-len(data) // 64)
            small += data.ljust(64 * n, b"\0")
            small_fat += [*range(k + 1, k + n), end] if n else []
            rows.append((name, 2, k if n else end, len(data)))
        else:
            rows.append((name, 2, store(data), len(data)))
    rows.insert(0, ("Root Entry", 5, store(small), len(small)))
    small_first = store(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(-(-len(small_fat) // 128) * 512, b"\xff")) if small_fat else end
    listing = b""
    for k, (name, what, first, size) in enumerate(rows):
        text = name.encode("utf-16-le") + b"\0\0"
        links = (unused, k + 1 if 0 < k < len(rows) - 1 else unused, 1 if not k and len(rows) > 1 else unused)
        listing += text.ljust(64, b"\0") + struct.pack("<HBB3I", len(text), what, 1, *links) + b"\0" * 36 + struct.pack("<IQ", first, size)
    listing_first = store(listing.ljust(-(-len(listing) // 512) * 512, b"\0"))
    n = 1
    while len(fat) + n > 128 * n:
        n += 1
    own = list(range(len(sectors), len(sectors) + n))
    table = struct.pack(f"<{len(fat) + n}I", *fat, *[0xFFFFFFFD] * n).ljust(512 * n, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<8I", n, listing_first, 0, 4096, small_first, -(-len(small_fat) // 128), end, 0)
    head += struct.pack("<109I", *own, *[unused] * (109 - n))
    return head + b"".join(sectors) + table


def word_file(pieces: list[tuple[str, bool]]) -> bytes:
    """A Word file of pieces (text, whether it is stored in one byte a character)."""
    main, table, ends, places = bytearray(0x400), b"", [0], b""
    for text, narrow in pieces:
        place = len(main) * 2 | 0x40000000 if narrow else len(main)
        main += text.encode("cp1252" if narrow else "utf-16-le")
        main += b"\0" * (len(main) % 2)
        ends.append(ends[-1] + len(text))
        places += struct.pack("<HIH", 0, place, 0)
    body = struct.pack(f"<{len(ends)}I", *ends) + places
    table = b"\x01\x02\x00ab" + b"\x02" + struct.pack("<I", len(body)) + body
    struct.pack_into("<HH", main, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    return compound({"WordDocument": bytes(main), "1Table": table})


def _record(code: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", code, len(body)) + body


def _text(s: str, size: str = "<H") -> bytes:
    return struct.pack(size, len(s)) + (b"\0" + s.encode("latin-1") if s.isascii() else b"\1" + s.encode("utf-16-le"))


def excel_file(sheets: list[tuple[str, list[list]]], cut: int = 0) -> bytes:
    """An Excel file of texts, numbers, truth values and dates as ("date", serial). ``cut``: the shared
    texts run on to another record after so many bytes of characters of the last."""
    strings: list[str] = []
    bodies = []
    for _, rows in sheets:
        out = _record(0x809, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                at = struct.pack("<HHH", r, c, 0)
                if isinstance(v, bool):
                    out += _record(0x205, at + bytes([v, 0]))
                elif isinstance(v, tuple):
                    out += _record(0x203, struct.pack("<HHHd", r, c, 1, v[1]))
                elif isinstance(v, int):
                    out += _record(0x27E, at + struct.pack("<i", v << 2 | 2))
                elif isinstance(v, float):
                    out += _record(0x203, at + struct.pack("<d", v))
                elif v and v[0] == "=":
                    out += _record(0x06, at + struct.pack("<BBHH", 0, 0, 0, 0) + b"\xff\xff" + b"\0" * 8) + _record(0x207, _text(v[1:]))
                elif v:
                    strings.append(v)
                    out += _record(0xFD, at + struct.pack("<I", len(strings) - 1))
        bodies.append(out + _record(0x0A))
    table = struct.pack("<II", len(strings), len(strings)) + b"".join(map(_text, strings))
    last = strings[-1] if strings else ""
    split = len(table) - len(last) * (1 if last.isascii() else 2) + cut
    shared = _record(0xFC, table[:split]) + _record(0x3C, bytes([not last.isascii()]) + table[split:]) if cut else _record(0xFC, table)
    head = _record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12) + _record(0x41E, struct.pack("<H", 170) + _text("yyyy-mm-dd")) + _record(0xE0, b"\0" * 20) + _record(0xE0, struct.pack("<HH", 0, 170) + b"\0" * 16)
    size = len(head) + sum(len(_record(0x85, b"\0" * 6 + _text(n, "<B"))) for n, _ in sheets) + len(shared) + 4
    places = [size + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    listed = b"".join(_record(0x85, struct.pack("<IBB", p, 0, 0) + _text(n, "<B")) for p, (n, _) in zip(places, sheets))
    return compound({"Workbook": head + listed + shared + _record(0x0A) + b"".join(bodies)})


def slides_file(decks: list[list[str]]) -> bytes:
    """A PowerPoint file: for each slide its texts, the first as the title."""
    piece = lambda code, body, mark=0: struct.pack("<HHI", mark, code, len(body)) + body
    atom = lambda t: piece(0x0FA8, t.encode("cp1252")) if t.isascii() else piece(0x0FA0, t.encode("utf-16-le"))
    outline = b"".join(piece(0x03F3, b"\0" * 20) + b"".join(map(atom, texts)) for texts in decks)
    masters = piece(0x0FF0, piece(0x03F3, b"\0" * 20) + atom("master text"), 0x1F)
    return compound({"PowerPoint Document": piece(0x03E8, masters + piece(0x0FF0, outline, 0x0F), 0x0F)})
