"""Edits of office packages in place: what an edit does not touch stays as it is, byte for byte.

An edit is a dict with ``op`` and its arguments; ``apply`` gives the new file and how often each edit took
effect. Text is replaced across the runs that a match spans: the replacement goes where the match begins.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr, unescape

from lakeloom.sources import image
from lakeloom.sources.package import Refused, members, relations, sniff

# Of each kind, the parts that hold text, the elements that a match cannot leave, and the
# element around text (in ODF, text stands in the paragraph itself).
TEXTS = {
    "docx": (r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", ("w:p",), "w:t"),
    "pptx": (r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", ("a:p",), "a:t"),
    "xlsx": (r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", ("si", "is"), "t"),
    "odt": (r"content\.xml", ("text:p", "text:h"), None),
    "ods": (r"content\.xml", ("text:p",), None),
    "odp": (r"content\.xml", ("text:p",), None),
}
_QUOTES = {"&quot;": '"', "&apos;": "'"}
_TOKEN = re.compile(r"<[^>]*>|[^<]+")
EMU = 12_700  # English metric units of a point
PAGE = 451.3  # points that a picture may be wide


class Package:
    """The parts of an archive in their order."""

    def __init__(self, data: bytes):
        z = members(data)
        self.infos = z.infolist()
        self.parts = {i.filename: z.read(i) for i in self.infos}

    def text(self, name: str) -> str:
        return self.parts[name].decode("utf-8")

    def put(self, name: str, text: str | bytes) -> None:
        self.parts[name] = text.encode() if isinstance(text, str) else text

    def bytes(self) -> bytes:
        out, kinds = io.BytesIO(), {i.filename: i.compress_type for i in self.infos}
        with zipfile.ZipFile(out, "w") as z:
            for name, data in self.parts.items():
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = kinds.get(name, zipfile.ZIP_DEFLATED)
                z.writestr(info, data)
        return out.getvalue()

    def relate(self, part: str, kind: str, target: str) -> str:
        """A new relationship of a part; its id."""
        folder, _, name = part.rpartition("/")
        path = f"{folder}/_rels/{name}.rels"
        old = self.text(path) if path in self.parts else '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>'
        taken = set(re.findall(r'Id="([^"]+)"', old))
        own = next(f"rNew{k}" for k in range(1, len(taken) + 2) if f"rNew{k}" not in taken)
        one = f'<Relationship Id="{own}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target={quoteattr(target)}/>'
        self.put(path, re.sub(r"(<Relationships\b[^>]*)/>\s*$", r"\1></Relationships>", old).replace("</Relationships>", one + "</Relationships>"))
        return own

    def declare(self, entry: str, key: str) -> None:
        """A content type, unless ``key`` has one."""
        types = self.text("[Content_Types].xml")
        if key not in types:
            self.put("[Content_Types].xml", types.replace("</Types>", entry + "</Types>"))


def _replace(xml: str, around: tuple[str, ...], holder: str | None, pattern: re.Pattern, new: str) -> tuple[str, int]:
    hits = 0

    def paragraph(m: re.Match) -> str:
        nonlocal hits
        tokens, inside = _TOKEN.findall(m[0]), holder is None
        spots = []  # tokens that are text
        for k, t in enumerate(tokens):
            if holder and re.match(rf"<{holder}[ >]", t) and not t.endswith("/>"):
                inside = True
            elif holder and t == f"</{holder}>":
                inside = False
            elif inside and t[0] != "<":
                spots.append(k)
        texts = [unescape(tokens[k], _QUOTES) for k in spots]
        found = [x for x in pattern.finditer("".join(texts)) if x.end() > x.start()]
        if not found:
            return m[0]
        hits += len(found)
        at = 0
        for i, (k, t) in enumerate(zip(spots, texts)):
            out, here = [], at
            for x in found:
                if x.end() <= at or x.start() >= at + len(t):
                    continue
                out.append(t[max(0, here - at) : max(0, x.start() - at)])
                if at <= x.start():
                    out.append(new)
                here = min(x.end(), at + len(t))
            out.append(t[here - at :])
            at += len(t)
            tokens[k] = escape("".join(out))
            if holder in ("w:t", "t") and "xml:space" not in tokens[k - 1]:
                tokens[k - 1] = f'<{holder} xml:space="preserve">'
        return "".join(tokens)

    names = "|".join(around)
    done = re.sub(rf"<({names})(?:\s[^>]*)?(?<!/)>.*?</\1>", paragraph, xml, flags=re.S)
    return done, hits


def replace_text(p: Package, kind: str, find: str, replace: str, regex: bool = False) -> int:
    parts, around, holder = TEXTS[kind]
    pattern = re.compile(find if regex else re.escape(find))
    total = 0
    for name in [n for n in p.parts if re.fullmatch(parts, n)]:
        new, hits = _replace(p.text(name), around, holder, pattern, replace)
        if hits:
            p.put(name, new)
            total += hits
    return total


def _add_paragraphs(p: Package, kind: str, xml: str, after: str | None = None) -> int:
    """Puts paragraphs at the end, or after the first paragraph with the text ``after``. 1 where done as
    asked, 0 where there is no such paragraph and they went to the end."""
    part, tag, end = ("word/document.xml", "w:p", r"<w:sectPr\b[^>]*?(?:/>|>.*?</w:sectPr>)\s*</w:body>|</w:body>") if kind == "docx" else ("content.xml", "text:p", r"</office:text>")
    old = p.text(part)
    spots = [m for m in re.finditer(rf"<{tag}(?:\s[^>]*)?(?<!/)>.*?</{tag}>", old, re.S) if after and after in unescape(re.sub(r"<[^>]*>", "", m[0]), _QUOTES)]
    at = spots[0].end() if spots else re.search(end, old, re.S).start()
    p.put(part, old[:at] + xml + old[at:])
    return int(bool(spots) or after is None)


def append_markdown(p: Package, kind: str, text: str) -> int:
    """Blocks of Markdown at the end of a text document. Links become text, which needs no relationships."""
    from lakeloom.sources import markdown, wordlike

    blocks = markdown.parse(text)
    for b in blocks:
        b["runs"] = [r | {"link": None} for r in b["runs"]] if b["runs"] else b["runs"]
    whole = Package((wordlike.write_docx if kind == "docx" else wordlike.write_odt)(blocks))
    if kind == "odt":
        _add_paragraphs(p, kind, re.search(r"<office:text>(.*)</office:text>", whole.text("content.xml"), re.S)[1] if blocks else "")
        return len(blocks)
    if "word/numbering.xml" not in p.parts and any(b["type"] == "list" for b in blocks):
        p.put("word/numbering.xml", whole.text("word/numbering.xml"))
        p.relate("word/document.xml", "numbering", "numbering.xml")
        p.declare('<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/>', "/word/numbering.xml")
    _add_paragraphs(p, kind, re.search(r"<w:body>(.*)<w:sectPr/>", whole.text("word/document.xml"), re.S)[1])
    return len(blocks)


def insert_image(p: Package, kind: str, data: bytes, alt: str = "", after: str | None = None) -> int:
    """A picture in its own paragraph, no wider than the page; at the end where no anchor is found."""
    size = image.size(data)
    if kind != "docx" or size is None:
        raise Refused("pictures go into docx, as png, jpeg, gif or bmp")
    ext, width, height = size
    scale = min(1.0, PAGE / max(1e-9, width * 0.75))
    w, h = (round(x * 0.75 * scale * EMU) for x in (width, height))
    number = 1 + len(re.findall(r"<wp:docPr ", p.text("word/document.xml")))
    media = [n for n in p.parts if n.startswith("word/media/")]
    part = next((n for n in media if p.parts[n] == data), None)  # the same picture is there once
    if part is None:
        part = f"word/media/added{len(media) + 1}.{ext}"
        p.put(part, data)
    own = p.relate("word/document.xml", "image", part.removeprefix("word/"))
    p.declare(f'<Default Extension="{ext}" ContentType="image/{ext}"/>', f'Extension="{ext}"')
    a, pic = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
    name = quoteattr(alt or f"picture {number}")
    drawing = (
        f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="{w}" cy="{h}"/><wp:docPr id="{9000 + number}" name={name} descr={name}/>'
        f'<a:graphic xmlns:a="{a}"><a:graphicData uri="{pic}"><pic:pic xmlns:pic="{pic}"><pic:nvPicPr><pic:cNvPr id="0" name={name}/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="{own}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )
    return _add_paragraphs(p, kind, drawing, after)


def _slides(p: Package) -> list[tuple[str, str]]:
    """(entry in the list of slides, part) of each slide in order."""
    targets = relations(members(p.bytes()), "ppt/presentation.xml")
    return [(m[0], targets[re.search(r'r:id="([^"]+)"', m[0])[1]]) for m in re.finditer(r"<p:sldId\b[^>]*/>", p.text("ppt/presentation.xml"))]


def add_slide(p: Package, kind: str, slide: dict, index: int | None = None) -> int:
    """A slide at an index from 1, else at the end, on the layout that the slide before it has."""
    from lakeloom.sources import slidelike

    have = _slides(p)
    if kind != "pptx" or index is not None and not 1 <= index <= len(have) + 1:
        raise Refused(f"no place for a slide at {index}")
    number = 1 + max((int(re.search(r"(\d+)\.xml$", part)[1]) for _, part in have), default=0)
    part = f"ppt/slides/slide{number}.xml"
    p.put(part, slidelike.slide_xml(slidelike.slide(**slide)))
    layout = next((t for _, q in reversed(have) for t in relations(members(p.bytes()), q).values() if "slideLayout" in t), None)
    if layout:
        p.relate(part, "slideLayout", "../" + layout.removeprefix("ppt/"))
    p.declare(f'<Override PartName="/{part}" ContentType="application/vnd.openxmlformats-officedocument.presentationml.slide+xml"/>', f"/{part}")
    own = p.relate("ppt/presentation.xml", "slide", f"slides/slide{number}.xml")
    show = p.text("ppt/presentation.xml")
    key = 1 + max([255, *(int(x) for x in re.findall(r'<p:sldId\b[^>]*?\bid="(\d+)"', show))])
    entry = f'<p:sldId id="{key}" r:id="{own}"/>'
    at = len(have) + 1 if index is None else index
    if at <= len(have):
        show = show.replace(have[at - 1][0], entry + have[at - 1][0])
    else:
        show = re.sub(r"<p:sldIdLst\s*/>", "<p:sldIdLst></p:sldIdLst>", show).replace("</p:sldIdLst>", entry + "</p:sldIdLst>")
    p.put("ppt/presentation.xml", show)
    return 1


def update_slide(p: Package, kind: str, index: int, title: str | None = None, subtitle: str | None = None) -> int:
    """New texts for a slide's title and subtitle; counts those that the slide has."""
    have = _slides(p)
    if kind != "pptx" or not 1 <= index <= len(have):
        raise Refused(f"no slide {index}")
    part, done = have[index - 1][1], 0
    xml = p.text(part)
    for kinds, text in ((("title", "ctrTitle"), title), (("subTitle",), subtitle)):
        if text is None:
            continue
        body = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split("\n"))

        def shape(m: re.Match) -> str:
            nonlocal done
            if not re.search(rf'<p:ph\b[^>]*type="({"|".join(kinds)})"', m[0]):  # noqa: B023
                return m[0]
            done += 1
            return re.sub(r"<a:p\b.*</a:p>|<a:p/>", lambda _: body, m[0], count=1, flags=re.S)  # noqa: B023

        xml = re.sub(r"<p:sp>.*?</p:sp>", shape, xml, flags=re.S)
    p.put(part, xml)
    return done


def delete_slide(p: Package, kind: str, index: int) -> int:
    have = _slides(p)
    if kind != "pptx" or not 1 <= index <= len(have):
        raise Refused(f"no slide {index}")
    if len(have) == 1:
        raise Refused("a deck keeps one slide at least")
    entry, part = have[index - 1]
    show = p.text("ppt/presentation.xml")
    own = re.search(r'r:id="([^"]+)"', entry)[1]
    p.put("ppt/presentation.xml", show.replace(entry, ""))
    rels = "ppt/_rels/presentation.xml.rels"
    p.put(rels, re.sub(rf'<Relationship\b[^>]*Id="{re.escape(own)}"[^>]*/>', "", p.text(rels)))
    p.put("[Content_Types].xml", re.sub(rf'<Override\b[^>]*PartName="/{re.escape(part)}"[^>]*/>', "", p.text("[Content_Types].xml")))
    del p.parts[part]
    p.parts.pop(part.replace("slides/", "slides/_rels/", 1) + ".rels", None)
    return 1


def set_meta(p: Package, kind: str, **values: str) -> int:
    """Title, author, subject, keywords and description in the package's properties."""
    odf = kind in ("odt", "ods", "odp")
    part = "meta.xml" if odf else "docProps/core.xml"
    names = {"title": "dc:title", "author": "dc:creator", "subject": "dc:subject", "keywords": "meta:keyword" if odf else "cp:keywords", "description": "dc:description"}
    if part not in p.parts:
        raise Refused(f"no properties in this {kind}")
    xml = p.text(part)
    for key, value in values.items():
        tag = names[key]
        xml = re.sub(rf"<{tag}\b[^>]*?(?:/>|>.*?</{tag}>)", "", xml, flags=re.S)
        end = "</office:meta>" if odf else "</cp:coreProperties>"
        xml = xml.replace(end, f"<{tag}>{escape(value)}</{tag}>{end}")
    p.put(part, xml)
    return len(values)


OPS: dict[str, Callable[..., int]] = {f.__name__: f for f in (replace_text, append_markdown, insert_image, add_slide, update_slide, delete_slide, set_meta)}


def apply(data: bytes, name: str, edits: list[dict]) -> tuple[bytes, list[int]]:
    """The file after all edits, in order, and the count of each. One that fails fails them all."""
    kind, p = sniff(data, name), Package(data)
    if kind not in TEXTS:
        raise Refused(f"no edits of {kind}")
    counts = [OPS[e["op"]](p, kind, **{k: v for k, v in e.items() if k != "op"}) for e in edits]
    return p.bytes(), counts
