"""Zipped office packages: guarded reading, and building."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree as ET


class Refused(ValueError):
    """A file that a guard does not let through."""


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 200 << 20
    entry_bytes: int = 256 << 20
    total_bytes: int = 512 << 20


def members(data: bytes, limits: Limits = Limits()) -> zipfile.ZipFile:
    """The archive, if its declared sizes and names are acceptable. CRCs are checked as entries are read."""
    if len(data) > limits.file_bytes:
        raise Refused(f"file of {len(data)} bytes")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        z = _ended(data, e)
    sizes = [i.file_size for i in z.infolist()]
    if max(sizes, default=0) > limits.entry_bytes or sum(sizes) > limits.total_bytes:
        raise Refused("declared size is over the limit")
    if len(set(z.namelist())) != len(sizes):
        raise Refused("two entries have one name")
    return z


def _ended(data: bytes, why: Exception) -> zipfile.ZipFile:
    """An archive with other data after its end: what follows the last mark of an end, and the comment
    whose length that tells, is left out."""
    at = data.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(data):
        raise Refused(str(why)) from why
    size = int.from_bytes(data[at + 20 : at + 22], "little")
    whole = data[: at + 22 + size]
    if len(whole) < at + 22 + size:  # the comment is cut off
        whole = data[: at + 20] + b"\0\0"
    try:
        return zipfile.ZipFile(io.BytesIO(whole))
    except zipfile.BadZipFile as e:
        raise Refused(str(e)) from e


def xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return parsed(z.read(name)) if name in z.namelist() else None


def parsed(data: bytes) -> ET.Element:
    """The tree of an XML part. Of one that is not well formed: bare ampersands, characters that XML does not
    have and prefixes that nobody declares are mended, and a tree that breaks off ends there."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        text = data.decode("utf-8", "replace").removeprefix("\ufeff")
    text = re.sub(r"^<\?xml.*?\?>|[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;", text)
    used = set(re.findall(r"[<\s]/?([A-Za-z_][\w.-]*):[A-Za-z_]", "".join(re.findall(r"<[^>]*>", text)))) - {"xml", "xmlns"}
    named = "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(used - set(re.findall(r"xmlns:([\w.-]+)\s*=", text))))
    text = re.sub(r"<[A-Za-z_][^\s/>]*", lambda m: m[0] + named, text, count=1)
    pull = ET.XMLPullParser(("start",))
    pull.feed(text)
    try:
        return next(e for _, e in pull.read_events())
    except (StopIteration, ET.ParseError) as e:
        raise Refused("a part that is no XML") from e


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute, whatever its namespace."""
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def kids(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name] if e is not None else []


def find(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next(iter(kids(e, name)), None)
    return e


def every(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if local(c) == name] if e is not None else []


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id of a part's relationships; those inside the package as full names."""
    folder, _, name = part.rpartition("/")
    root = xml(z, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for r in kids(root, "Relationship"):
        target = r.get("Target", "")
        if r.get("TargetMode") != "External":
            pieces: list[str] = [] if target.startswith("/") else folder.split("/") if folder else []
            for p in target.strip("/").split("/"):
                pieces = pieces[:-1] if p == ".." else [*pieces, p]
            target = "/".join(pieces)
        out[r.get("Id")] = target
    return out


def core_meta(z: zipfile.ZipFile) -> dict[str, str]:
    # Names of core properties and what they are called here.
    names = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "description": "description", "created": "created", "modified": "modified"}
    root = xml(z, "docProps/core.xml")
    return {names[local(e)]: e.text for e in (root if root is not None else ()) if local(e) in names and e.text}


def build(parts: dict[str, str | bytes], stored: tuple[str, ...] = ()) -> bytes:
    """An archive of the parts in their order; equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def sniff(data: bytes, name: str = "") -> str:
    """The kind of a file by its first bytes, then by the archive's members, then by its name."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(bytes.fromhex("D0CF11E0")):
        return "ole2"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"PK"):
        names = members(data).namelist()
        for prefix, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(n.startswith(prefix) for n in names):
                return kind
        if ext in ("odt", "ods", "odp"):
            return ext
        raise Refused("an archive that is no office document")
    for kind, exts in {"csv": ("csv",), "tsv": ("tsv", "tab"), "md": ("md", "markdown"), "html": ("html", "htm", "xhtml"), "png": ("png",)}.items():
        if ext in exts:
            return kind
    for mark, kind in ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp")):
        if data.startswith(mark):
            return kind
    return "text"
