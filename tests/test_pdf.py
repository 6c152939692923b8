"""PDF filters, encodings, encryption and output."""

import hashlib
import re
import struct
import zlib

import pytest

from lakeloom.functions.blocks import block, run
from lakeloom.sources import cipher, files, package, pdf


def file_of(content: bytes, filters: bytes = b"", font: bytes = b"/Encoding /WinAnsiEncoding", inherited: bool = False) -> bytes:
    resources = b"/Resources << /Font << /F1 4 0 R >> >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] %s >>" % (resources if inherited else b""), b"<< /Type /Page /Parent 2 0 R %s /Contents 5 0 R >>" % (b"" if inherited else resources), b"<< /Type /Font /Subtype /Type1 /BaseFont /X %s >>" % font]
    objects.append(b"<< /Length %d %s >>\nstream\n" % (len(content), filters) + content + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in enumerate(objects, 1)) + b"trailer << /Size 6 /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def lzw(data: bytes) -> bytes:
    """The plain encoder: codes of as many bits as the reader expects by then."""
    bits, table, word = "", {bytes([k]): k for k in range(256)}, b""
    put = lambda code: format(code, f"0{min(12, max(9, (len(table) + 2).bit_length()))}b")
    bits += format(256, "09b")
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits += put(table[word])
        table[word + bytes([b])] = len(table) + 2
        word = bytes([b])
    bits += put(table[word])
    table[b"end" * 50] = 0
    bits += put(257)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


SHOW = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (the text of the page, the text of the page) Tj ET"
TEXT = "the text of the page, the text of the page"


def test_filters():
    rows = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(SHOW[i : i + 9].ljust(9), (SHOW[i - 9 : i] if i else bytes(9)))) for i in range(0, len(SHOW), 9))
    packed = {
        b"/Filter /LZWDecode": lzw(SHOW * 3), b"/Filter /RunLengthDecode": b"".join(bytes([len(SHOW[i : i + 100]) - 1]) + SHOW[i : i + 100] for i in range(0, len(SHOW), 100)) + b"\xfe  \x80",
        b"/Filter /ASCIIHexDecode": SHOW.hex().encode() + b">", b"/Filter [/ASCIIHexDecode /FlateDecode]": zlib.compress(SHOW).hex().encode() + b">",
        b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 9 >>": zlib.compress(rows),
    }
    for filters, data in packed.items():
        assert TEXT in pdf.read(file_of(data, filters))[0]["text"], filters
    assert pdf.read(file_of(SHOW, inherited=True))[0]["text"] == TEXT


def test_changed_encodings():
    font = b"/Encoding << /Type /Encoding /Differences [1 /A /eacute /uni4E2D 65 /fi /space /hyphen] >>"
    assert pdf.read(file_of(b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (\\001\\002\\003xABC) Tj ET", font=font))[0]["text"] == "Aé中xfi -"


def test_ciphers():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert cipher.aes_encrypt(key, plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert cipher.aes_encrypt(bytes(range(32)), plain, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    long = bytes(range(256)) * 3
    assert cipher.aes_decrypt(key, cipher.aes_encrypt(key, long, plain), plain) == long
    assert cipher.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def locked(data: bytes, revision: int, user: str, method: str = "RC4") -> bytes:
    """The file encrypted for a user's password."""
    ident, p = b"0123456789abcdef", -44
    word = user.encode()
    if revision >= 5:
        key = bytes(range(32))
        salts = [b"saltsalt", b"keysalt!", b"ownersal", b"ownerkey"]
        u = cipher.hardened(word, salts[0], b"", revision) + salts[0] + salts[1]
        ue = cipher.aes_encrypt(cipher.hardened(word, salts[1], b"", revision), key, bytes(16))
        o = cipher.hardened(b"owner", salts[2], u, revision) + salts[2] + salts[3]
        oe = cipher.aes_encrypt(cipher.hardened(b"owner", salts[3], u, revision), key, bytes(16))
        values = f"/V 5 /R {revision} /P {p} /O <{o.hex()}> /U <{u.hex()}> /OE <{oe.hex()}> /UE <{ue.hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF"
    else:
        n = 5 if revision == 2 else 16
        k = hashlib.md5((b"owner" + cipher.PADDING)[:32]).digest()
        for _ in range(50 if revision > 2 else 0):
            k = hashlib.md5(k[:n]).digest()
        o = (word + cipher.PADDING)[:32]
        for i in range(20 if revision > 2 else 1):
            o = cipher.rc4(bytes(b ^ i for b in k[:n]), o)
        key = hashlib.md5((word + cipher.PADDING)[:32] + o + struct.pack("<i", p) + ident).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        u = cipher.rc4(key, cipher.PADDING)
        if revision > 2:
            x = hashlib.md5(cipher.PADDING + ident).digest()
            for i in range(20):
                x = cipher.rc4(bytes(b ^ i for b in key), x)
            u = x + bytes(16)
        values = f"/V {dict(zip((2, 3, 4), (1, 2, 4)))[revision]} /R {revision} /Length {8 * n} /P {p} /O <{o.hex()}> /U <{u.hex()}>" + (f" /CF << /StdCF << /CFM /{method} >> >>" if revision == 4 else "")

    def hide(m: re.Match) -> bytes:
        body = re.search(rb"(.*?)stream\r?\n(.*?)\r?\nendstream", m[2], re.S)
        if not body:
            return m[0]
        data = body[2]
        if revision < 5:
            own = hashlib.md5(key + struct.pack("<I", int(m[1]))[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, len(key) + 5)]
        else:
            own = key
        fill = 16 - len(data) % 16
        data = cipher.rc4(own, data) if revision < 5 and method == "RC4" else b"i" * 16 + cipher.aes_encrypt(own, data + bytes([fill]) * fill, b"i" * 16)
        return b"%s 0 obj\n" % m[1] + re.sub(rb"/Length \d+", b"/Length %d" % len(data), body[1]) + b"stream\n" + data + b"\nendstream\nendobj"

    out = re.sub(rb"(\d+) 0 obj\n(.*?)endobj", hide, data, flags=re.S)
    return out.replace(b"trailer <<", f"99 0 obj\n<< /Filter /Standard {values} >>\nendobj\ntrailer << /Encrypt 99 0 R /ID [<{ident.hex()}><{ident.hex()}>]".encode())


@pytest.mark.parametrize("revision,method", [(2, "RC4"), (3, "RC4"), (4, "RC4"), (4, "AESV2"), (5, "AESV3"), (6, "AESV3")])
def test_encryption(revision, method):
    plain = pdf.write([block("paragraph", runs=[run("kept secret")])])
    open_, shut = locked(plain, revision, "", method), locked(plain, revision, "word", method)
    assert pdf.read(open_)[0]["text"] == "kept secret"
    assert pdf.read(shut, "word")[0]["text"] == "kept secret" == pdf.read(shut, "owner")[0]["text"]
    with pytest.raises(package.Refused):
        pdf.read(shut, "other")
    assert "another password" in files.load(shut, "a.pdf")["error"]


def test_output_keeps_every_character():
    text = "中文段落，很长的一行。" * 12 + " and Latin (x) 100% \\ é — Ω ж"
    data = pdf.write([block("heading", level=1, text="标题 T"), block("paragraph", runs=[run(text)])])
    found = pdf.read(data)[0]["text"]
    assert found.startswith("# 标题 T") and re.sub(r"\s", "", found.partition("\n")[2]) == re.sub(r"\s", "", text)
    assert pdf.gate(data, text) == [] and pdf.gate(data, "ٱ") == ["without 1 characters: ٱ"] and pdf.gate(pdf.write([]), "x") == ["blank"]
    assert pdf.gate(b"%PDF-1.4 nothing", "") == [] and pdf.gate(locked(data, 3, "w"), text)[0].startswith("unreadable")


def test_text_layers_are_judged():
    pages = [block("paragraph", runs=[run("a clean page of ordinary words " * 5)]), block("pagebreak"), block("paragraph", runs=[run("" * 80)]), block("pagebreak"), block("paragraph", runs=[run("" * 80)]), block("pagebreak")]
    meta = files.load(pdf.write(pages), "a.pdf")["meta"]
    assert meta == {"pages": "4", "scanned": "1", "garbled": "2", "garbled_pages": "2-3"}
