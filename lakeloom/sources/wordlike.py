"""Text documents: docx and odt, both ways."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, quoteattr

from lakeloom.functions.blocks import block, run
from lakeloom.sources.package import attr, build, core_meta, every, find, kids, local, members, relations, xml

# Namespaces.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006"
O = "urn:oasis:names:tc:opendocument:xmlns"
FLAGS = {"b": "bold", "i": "italic", "u": "underline", "strike": "strike"}


def _merge(blocks: list[dict]) -> list[dict]:
    """Consecutive list items become one list."""
    out: list[dict] = []
    for b in blocks:
        if b["type"] == "list" and out and out[-1]["type"] == "list" and out[-1]["ordered"] == b["ordered"]:
            out[-1]["items"] += b["items"]
        else:
            out.append(b)
    return out


def _docx_text(node) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((t.text or "") if local(t) == "t" else marks.get(local(t), "") for t in node)


def _docx_paragraph(p, styles: dict[str, str], links: dict[str, str]) -> list[dict]:
    runs, out = [], []
    style = attr(find(p, "pPr", "pStyle"), "val", "") or ""
    name = styles.get(style, style)
    for child in p:
        inner = [child] if local(child) == "r" else kids(child, "r") if local(child) in ("hyperlink", "ins", "smartTag") else []
        link = links.get(attr(child, "id", "") or "") if local(child) == "hyperlink" else None
        for r in inner:
            if any(attr(b, "type") == "page" for b in kids(r, "br")):
                out.append(block("pagebreak"))
            on = {v: True for k, v in FLAGS.items() if (f := find(r, "rPr", k)) is not None and attr(f, "val") not in ("0", "false", "none")}
            text = _docx_text(r) + ("[图片]" if kids(r, "drawing") or kids(r, "pict") else "")
            if text.strip("\n") or text and not kids(r, "br"):
                runs.append(run(text, **on, **({"link": link} if link else {})))
    text = "".join(r["text"] for r in runs)
    if not text.strip():
        return out
    heading = re.fullmatch(r"(?i)(?:heading|标题|h) ?([1-6])", name)
    numbered = find(p, "pPr", "numPr")
    if heading:
        return [*out, block("heading", level=int(heading[1]), text=text)]
    if numbered is not None:
        ordered = attr(find(numbered, "numId"), "val") == "2"
        return [*out, block("list", ordered=ordered, items=[{"level": int(attr(find(numbered, "ilvl"), "val", "0")), "text": text}])]
    if "quote" in name.lower():
        return [*out, block("quote", text=text)]
    return [*out, block("paragraph", runs=runs)]


def read_docx(data: bytes) -> tuple[list[dict], dict[str, str]]:
    z = members(data)
    links = relations(z, "word/document.xml")
    styles = {attr(s, "styleId"): attr(find(s, "name"), "val", "") for s in kids(xml(z, "word/styles.xml"), "style")}
    blocks: list[dict] = []

    def walk(node) -> None:
        for e in node:
            if local(e) == "p":
                blocks.extend(_docx_paragraph(e, styles, links))
            elif local(e) == "tbl":
                rows = [["\n".join("".join(_docx_text(r) for r in every(p, "r")) for p in every(c, "p")) for c in kids(t, "tc")] for t in kids(e, "tr")]
                blocks.append(block("table", header=False, rows=rows))
            elif local(e) in ("sdt", "sdtContent"):
                walk(e)

    walk(find(xml(z, "word/document.xml"), "body"))
    return _merge(blocks), core_meta(z)


def _runs(b: dict) -> list[dict]:
    return b["runs"] or [run(b["text"] or "")]


def _types(parts: dict[str, str]) -> str:
    overrides = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in parts.items())
    return f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{P}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>'


def _rels(rows: list[tuple[str, str, str, bool]]) -> str:
    items = "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target={quoteattr(x)}{" TargetMode=" + chr(34) + "External" + chr(34) if out else ""}/>' for i, t, x, out in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{P}/relationships">{items}</Relationships>'


def core_xml(meta: dict[str, str]) -> str:
    names = {"title": "dc:title", "author": "dc:creator", "subject": "dc:subject", "keywords": "cp:keywords", "description": "dc:description"}
    cells = "".join(f"<{t}>{escape(meta[k])}</{t}>" for k, t in names.items() if meta.get(k))
    return f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="{P}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{cells}</cp:coreProperties>'


def _grid(lines: int | None, characters: int | None) -> str:
    """The grid of a page with so many lines and characters a line, in twips of A4 with its usual margins."""
    if not lines:
        return ""
    pitch = round((16838 - 2 * 1440) / max(1, min(100, lines)))
    spread = round(((11906 - 2 * 1800) / 20 / max(1, min(100, characters)) - 10.5) * 4096) if characters else None
    return f'<w:docGrid w:type="{"linesAndChars" if characters else "lines"}" w:linePitch="{pitch}"' + (f' w:charSpace="{spread}"/>' if characters else "/>")


def write_docx(blocks: list[dict], meta: dict[str, str] | None = None, images: dict[str, bytes] | None = None, lines: int | None = None, characters: int | None = None) -> bytes:
    """A document; pictures whose data ``images`` has by name are in it, others are named. ``lines`` and
    ``characters`` set a grid for a page."""
    if images and any(b["type"] == "image" and b["name"] in images for b in blocks):
        return _with_pictures(blocks, meta, images, lines, characters)
    links: list[str] = []
    body: list[str] = []

    def runs(b: dict) -> str:
        out = []
        for r in _runs(b):
            flags = "".join(f'<w:{k}{" w:val=" + chr(34) + "single" + chr(34) if k == "u" else ""}/>' for k, v in FLAGS.items() if r.get(v))
            text = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in r["text"].split("\n"))
            one = f"<w:r>{'<w:rPr>' + flags + '</w:rPr>' if flags else ''}{text}</w:r>"
            if r.get("link"):
                links.append(r["link"])
                one = f'<w:hyperlink r:id="rLink{len(links)}">{one}</w:hyperlink>'
            out.append(one)
        return "".join(out)

    def paragraph(content: str, style: str = "", extra: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{'<w:pPr>' + props + '</w:pPr>' if props else ''}{content}</w:p>"

    for b in blocks:
        kind = b["type"]
        if kind == "heading":
            body.append(paragraph(runs(b), f"Heading{b['level']}"))
        elif kind == "list":
            for i in b["items"]:
                body.append(paragraph(runs(block("", text=i["text"])), "", f'<w:numPr><w:ilvl w:val="{i["level"]}"/><w:numId w:val="{2 if b["ordered"] else 1}"/></w:numPr>'))
        elif kind == "table":
            width = max(map(len, b["rows"]), default=1)
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(runs(block('', text=c or '')))}</w:tc>" for c in [*r, *[""] * (width - len(r))]) + "</w:tr>" for r in b["rows"])
            body.append(f"<w:tbl><w:tblGrid>{'<w:gridCol/>' * width}</w:tblGrid>{rows}</w:tbl>")
        elif kind == "pagebreak":
            body.append(paragraph('<w:r><w:br w:type="page"/></w:r>'))
        elif kind == "quote":
            body.append(paragraph(runs(b), "Quote"))
        elif kind == "image":
            body.append(paragraph(runs(block("", text=f"![{b['alt']}]({b['name']})"))))
        elif kind != "hr":
            body.append(paragraph(runs(b)))
    names = {**{f"Heading{k}": f"heading {k}" for k in range(1, 7)}, "Quote": "Quote"}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in names.items())
    levels = lambda fmt: "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{fmt}"/></w:lvl>' for k in range(9))
    numbering = f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return build({
        "[Content_Types].xml": _types({"word/document.xml": f"{kind}.document.main+xml", "word/styles.xml": f"{kind}.styles+xml", "word/numbering.xml": f"{kind}.numbering+xml"}),
        "_rels/.rels": _rels([("r1", "officeDocument", "word/document.xml", False)]),
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{"".join(body)}{"<w:sectPr>" + _grid(lines, characters) + "</w:sectPr>" if lines else "<w:sectPr/>"}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>', "word/numbering.xml": numbering, "docProps/core.xml": core_xml(meta or {}),
        "word/_rels/document.xml.rels": _rels([("r1", "styles", "styles.xml", False), ("r2", "numbering", "numbering.xml", False), *((f"rLink{i}", "hyperlink", x, True) for i, x in enumerate(links, 1))]),
    })


def _with_pictures(blocks: list[dict], meta: dict[str, str] | None, images: dict[str, bytes], lines: int | None, characters: int | None) -> bytes:
    """Puts pictures in the places of marked paragraphs."""
    from lakeloom.sources import repack

    marked, wanted = [], {}
    for k, b in enumerate(blocks):
        if b["type"] == "image" and b["name"] in images:
            wanted[f"\ue000{k}\ue001"] = (images[b["name"]], b["alt"] or "")
            b = block("paragraph", runs=[run(f"\ue000{k}\ue001")])
        marked.append(b)
    p = repack.Package(write_docx(marked, meta, None, lines, characters))
    for mark, (data, alt) in wanted.items():
        repack.insert_image(p, "docx", data, alt, mark)
        p.put("word/document.xml", re.sub(rf"<w:p><w:r><w:t[^>]*>{mark}</w:t></w:r></w:p>", "", p.text("word/document.xml")))
    return p.bytes()


def odf_text(e) -> str:
    """Text of an ODF paragraph, with its spaces, tabs and breaks."""
    out = [e.text or ""]
    for c in e:
        kind = local(c)
        out.append(" " * int(attr(c, "c", "1")) if kind == "s" else {"tab": "\t", "line-break": "\n"}.get(kind, ""))
        if kind not in ("s", "tab", "line-break", "note", "annotation"):
            out.append(odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def read_odt(data: bytes) -> tuple[list[dict], dict[str, str]]:
    z = members(data)
    blocks: list[dict] = []

    def items(e, level: int, into: list) -> list:
        for li in kids(e, "list-item"):
            for c in li:
                if local(c) == "p":
                    into.append({"level": min(8, level), "text": odf_text(c)})
                elif local(c) == "list":
                    items(c, level + 1, into)
        return into

    def walk(node) -> None:
        for e in node if node is not None else ():
            kind = local(e)
            if kind == "h":
                blocks.append(block("heading", level=int(attr(e, "outline-level", "1")), text=odf_text(e)))
            elif kind == "p" and odf_text(e).strip():
                blocks.append(block("paragraph", runs=[run(odf_text(e))]))
            elif kind == "list":
                blocks.append(block("list", ordered=attr(e, "style-name") == "ordered", items=items(e, 0, [])))
            elif kind == "table":
                blocks.append(block("table", header=False, rows=[["\n".join(map(odf_text, kids(c, "p"))) for c in kids(r, "table-cell")] for r in every(e, "table-row")]))
            elif kind in ("section", "text"):
                walk(e)

    walk(find(xml(z, "content.xml"), "body", "text"))
    return blocks, odf_meta(z)


def odf_meta(z) -> dict[str, str]:
    names = {"title": "title", "initial-creator": "author", "creator": "author", "subject": "subject", "keyword": "keywords", "description": "description"}
    root = xml(z, "meta.xml")
    return {names[local(e)]: e.text for e in (root.iter() if root is not None else ()) if local(e) in names and e.text}


def odf_package(kind: str, body: str, meta: dict[str, str] | None = None) -> bytes:
    spaces = " ".join(f'xmlns:{k}="{O}:{v}:1.0"' for k, v in {"office": "office", "text": "text", "table": "table", "draw": "drawing", "presentation": "presentation"}.items())
    mime = f"application/vnd.oasis.opendocument.{kind}"
    cells = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in {"title": (meta or {}).get("title"), "creator": (meta or {}).get("author"), "subject": (meta or {}).get("subject"), "description": (meta or {}).get("description")}.items() if v)
    manifest = "".join(f'<manifest:file-entry manifest:full-path="{p}" manifest:media-type="{t}"/>' for p, t in (("/", mime), ("content.xml", "text/xml"), ("meta.xml", "text/xml")))
    return build({
        "mimetype": mime,
        "content.xml": f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {spaces} office:version="1.2"><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>',
        "meta.xml": f'<?xml version="1.0" encoding="UTF-8"?><office:document-meta {spaces} xmlns:dc="http://purl.org/dc/elements/1.1/"><office:meta>{cells}</office:meta></office:document-meta>',
        "META-INF/manifest.xml": f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="{O}:manifest:1.0">{manifest}</manifest:manifest>',
    }, stored=("mimetype",))


def odf_paragraph(text: str, tag: str = "text:p", more: str = "") -> str:
    inner = escape(text).replace("\n", "<text:line-break/>").replace("\t", "<text:tab/>")
    return f"<{tag}{more}>" + re.sub(r" {2,}", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', inner) + f"</{tag}>"


def write_odt(blocks: list[dict], meta: dict[str, str] | None = None) -> bytes:
    out = []
    for b in blocks:
        if b["type"] == "heading":
            out.append(odf_paragraph(b["text"], "text:h", f' text:outline-level="{b["level"]}"'))
        elif b["type"] == "list":
            nested = ""
            for i in b["items"]:
                nested += "<text:list-item>" + "<text:list><text:list-item>" * i["level"] + odf_paragraph(i["text"]) + "</text:list-item></text:list>" * i["level"] + "</text:list-item>"
            out.append(f'<text:list text:style-name="{"ordered" if b["ordered"] else "bullet"}">{nested}</text:list>')
        elif b["type"] == "table":
            rows = "".join("<table:table-row>" + "".join(f'<table:table-cell office:value-type="string">{odf_paragraph(c or "")}</table:table-cell>' for c in r) + "</table:table-row>" for r in b["rows"])
            out.append(f"<table:table>{rows}</table:table>")
        elif b["type"] not in ("hr", "pagebreak"):
            text = f"![{b['alt']}]({b['name']})" if b["type"] == "image" else "".join(r["text"] for r in _runs(b))
            out.append(odf_paragraph(text))
    return odf_package("text", "".join(out), meta)
