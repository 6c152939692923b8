"""Decks: pptx and odp, both ways. A slide is {layout, title, subtitle, bullets, rows, notes, images}."""

from __future__ import annotations

from xml.sax.saxutils import escape

from lakeloom.sources.package import attr, build, every, find, kids, members, relations, xml
from lakeloom.sources.wordlike import R, _rels, _types, core_xml, odf_package, odf_paragraph, odf_text

A = "http://schemas.openxmlformats.org/drawingml/2006/main"
PML = "http://schemas.openxmlformats.org/presentationml/2006/main"


def slide(title: str = "", **values) -> dict:
    return {"layout": "content", "title": title, "subtitle": None, "bullets": [], "rows": None, "notes": None, "images": 0} | values


def _lines(shape) -> list[tuple[int, str]]:
    return [(int(attr(find(p, "pPr"), "lvl", "0")), "".join(t.text or "" for t in every(p, "t"))) for p in every(shape, "p")]


def read_pptx(data: bytes) -> list[dict]:
    z = members(data)
    targets, out = relations(z, "ppt/presentation.xml"), []
    for s in every(xml(z, "ppt/presentation.xml"), "sldId"):
        part = targets[next(v for k, v in s.attrib.items() if k.startswith("{"))]
        root, one = xml(z, part), slide()
        for shape in every(root, "sp"):
            kind, lines = attr(next(iter(every(shape, "ph")), None), "type", ""), [x for x in _lines(shape) if x[1].strip()]
            text = "\n".join(t for _, t in lines)
            if kind in ("title", "ctrTitle"):
                one["title"], one["layout"] = text, "title" if kind == "ctrTitle" else one["layout"]
            elif kind == "subTitle":
                one["subtitle"] = text
            elif kind not in ("dt", "ftr", "sldNum"):
                one["bullets"] += [{"level": k, "text": t} for k, t in lines]
        for table in every(root, "tbl"):
            one["rows"] = [["\n".join(t for _, t in _lines(c)) for c in kids(r, "tc")] for r in kids(table, "tr")]
        one["images"] = len(every(root, "pic"))
        for target in relations(z, part).values():
            if "notesSlide" in target:
                bodies = ["\n".join(t for _, t in _lines(x)).strip() for x in every(xml(z, target), "sp") if attr(next(iter(every(x, "ph")), None), "type") == "body"]
                one["notes"] = next((b for b in reversed(bodies) if b), None)
        out.append(one)
    return out


def _shape(k: int, kind: str, lines: list[tuple[int, str]]) -> str:
    ph = f'<p:ph type="{kind}"/>' if kind != "body" else '<p:ph idx="1"/>'
    text = "".join(f'<a:p><a:pPr lvl="{n}"/><a:r><a:t>{escape(t)}</a:t></a:r></a:p>' for n, t in lines) or "<a:p/>"
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="{kind}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>'


_HEAD = f'xmlns:a="{A}" xmlns:r="{R}" xmlns:p="{PML}"'
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
# Places on a slide of 10 by 7.5 inches, in English metric units: left, top, width, height.
PLACES = {"ctrTitle": (685800, 2130425, 7772400, 1470025), "title": (457200, 274638, 8229600, 1143000), "subTitle": (1371600, 3886200, 6400800, 1752600), "body": (457200, 1600200, 8229600, 4525963)}
# The colours of a theme by their names.
COLOURS = {"dk1": "000000", "lt1": "FFFFFF", "dk2": "1F497D", "lt2": "EEECE1", "accent1": "4F81BD", "accent2": "C0504D", "accent3": "9BBB59", "accent4": "8064A2", "accent5": "4BACC6", "accent6": "F79646", "hlink": "0000FF", "folHlink": "800080"}


def slide_xml(s: dict) -> str:
    """One slide's part."""
    shapes = [_shape(2, "ctrTitle" if s["layout"] == "title" else "title", [(0, s["title"] or "")])]
    if s["subtitle"]:
        shapes.append(_shape(3, "subTitle", [(0, s["subtitle"])]))
    if s["bullets"]:
        shapes.append(_shape(4, "body", [(b["level"], b["text"]) for b in s["bullets"]]))
    if s["rows"]:
        width = max(map(len, s["rows"]))
        cell = lambda c: f"<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:t>{escape(c or '')}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>"
        rows = "".join(f'<a:tr h="370840">{"".join(map(cell, [*r, *[""] * (width - len(r))]))}</a:tr>' for r in s["rows"])
        x, y, w, h = PLACES["body"]
        grid = f'<a:tblPr firstRow="1"/><a:tblGrid>{f"""<a:gridCol w="{w // max(1, width)}"/>""" * width}</a:tblGrid>'
        shapes.append(f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5" name="table"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></p:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl>{grid}{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>')
    return f"{_XML}<p:sld {_HEAD}><p:cSld><p:spTree>{_GROUP}{''.join(shapes)}</p:spTree></p:cSld></p:sld>"


def _placed(kinds: tuple[str, ...]) -> str:
    """Empty placeholders where a layout or master has them."""
    out = ""
    for k, kind in enumerate(kinds, 2):
        x, y, w, h = PLACES[kind]
        out += _shape(k, kind, []).replace("<p:spPr/>", f'<p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr>')
    return f"<p:cSld><p:spTree>{_GROUP}{out}</p:spTree></p:cSld>"


def _theme() -> str:
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in COLOURS.items())
    font = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    line = f'<a:ln w="9525">{fill}</a:ln>'
    styles = f"<a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{'<a:effectStyle><a:effectLst/></a:effectStyle>' * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst>"
    return f'{_XML}<a:theme xmlns:a="{A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="plain">{styles}</a:fmtScheme></a:themeElements></a:theme>'


def _masters(notes: bool) -> tuple[dict[str, str], dict[str, str]]:
    """Parts that every deck has: a master with two layouts and a theme; with notes, their master too.
    And the kinds of the parts."""
    colours = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'
    layouts = {1: ("title", ("ctrTitle", "subTitle")), 2: ("obj", ("title", "body"))}
    listed = "".join(f'<p:sldLayoutId id="{2147483648 + k}" r:id="r{k}"/>' for k in layouts)
    parts = {
        "ppt/slideMasters/slideMaster1.xml": f"{_XML}<p:sldMaster {_HEAD}>{_placed(('title', 'body'))}{colours}<p:sldLayoutIdLst>{listed}</p:sldLayoutIdLst></p:sldMaster>",
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([*((f"r{k}", "slideLayout", f"../slideLayouts/slideLayout{k}.xml", False) for k in layouts), ("r9", "theme", "../theme/theme1.xml", False)]),
        "ppt/theme/theme1.xml": _theme(),
    }
    kinds = {"ppt/slideMasters/slideMaster1.xml": "slideMaster", "ppt/theme/theme1.xml": "theme"}
    for k, (kind, own) in layouts.items():
        part = f"ppt/slideLayouts/slideLayout{k}.xml"
        parts[part] = f'{_XML}<p:sldLayout {_HEAD} type="{kind}">{_placed(own)}<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sldLayout>'
        parts[f"ppt/slideLayouts/_rels/slideLayout{k}.xml.rels"] = _rels([("r1", "slideMaster", "../slideMasters/slideMaster1.xml", False)])
        kinds[part] = "slideLayout"
    if notes:
        parts["ppt/notesMasters/notesMaster1.xml"] = f"{_XML}<p:notesMaster {_HEAD}>{_placed(('body',))}{colours}</p:notesMaster>"
        parts["ppt/notesMasters/_rels/notesMaster1.xml.rels"] = _rels([("r1", "theme", "../theme/theme2.xml", False)])
        parts["ppt/theme/theme2.xml"] = _theme()
        kinds |= {"ppt/notesMasters/notesMaster1.xml": "notesMaster", "ppt/theme/theme2.xml": "theme"}
    return parts, kinds


def _notes_xml(text: str) -> str:
    body = _shape(2, "body", [(0, x) for x in text.split("\n")]).replace('<p:ph idx="1"/>', '<p:ph type="body" idx="1"/>')
    return f"{_XML}<p:notes {_HEAD}><p:cSld><p:spTree>{_GROUP}{body}</p:spTree></p:cSld></p:notes>"


def write_pptx(slides: list[dict], meta: dict[str, str] | None = None) -> bytes:
    noted = any(s["notes"] for s in slides)
    parts, kinds = _masters(noted)
    rels = [("rM", "slideMaster", "slideMasters/slideMaster1.xml", False), *([("rN", "notesMaster", "notesMasters/notesMaster1.xml", False)] if noted else [])]
    for k, s in enumerate(slides, 1):
        part = f"ppt/slides/slide{k}.xml"
        parts[part], kinds[part] = slide_xml(s), "slide"
        rels.append((f"r{k}", "slide", f"slides/slide{k}.xml", False))
        own = [("r1", "slideLayout", f"../slideLayouts/slideLayout{1 if s['layout'] == 'title' else 2}.xml", False)]
        if s["notes"]:
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            parts[notes], kinds[notes] = _notes_xml(s["notes"]), "notesSlide"
            parts[f"ppt/notesSlides/_rels/notesSlide{k}.xml.rels"] = _rels([("r1", "slide", f"../slides/slide{k}.xml", False), ("r2", "notesMaster", "../notesMasters/notesMaster1.xml", False)])
            own.append(("r2", "notesSlide", f"../notesSlides/notesSlide{k}.xml", False))
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels(own)
    kind = "application/vnd.openxmlformats-officedocument"
    types = {"ppt/presentation.xml": f"{kind}.presentationml.presentation.main+xml"} | {n: f"{kind}.theme+xml" if t == "theme" else f"{kind}.presentationml.{t}+xml" for n, t in kinds.items()}
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="r{k}"/>' for k in range(1, len(slides) + 1))
    masters = '<p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rM"/></p:sldMasterIdLst>' + ('<p:notesMasterIdLst><p:notesMasterId r:id="rN"/></p:notesMasterIdLst>' if noted else "")
    return build({
        "[Content_Types].xml": _types(types), "_rels/.rels": _rels([("r1", "officeDocument", "ppt/presentation.xml", False)]),
        "ppt/presentation.xml": f'{_XML}<p:presentation {_HEAD}>{masters}<p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels(rels), "docProps/core.xml": core_xml(meta or {}), **parts,
    })


def read_odp(data: bytes) -> list[dict]:
    out = []
    for page in every(xml(members(data), "content.xml"), "page"):
        one = slide()
        for frame in kids(page, "frame"):
            kind, lines = attr(frame, "class", ""), [odf_text(p) for p in every(frame, "p") if odf_text(p).strip()]
            if every(frame, "table-row"):
                one["rows"] = [["\n".join(map(odf_text, kids(c, "p"))) for c in kids(r, "table-cell")] for r in every(frame, "table-row")]
            elif kind in ("title", "subtitle"):
                one[kind] = "\n".join(lines)
            else:
                one["bullets"] += [{"level": 0, "text": t} for t in lines]
        notes = [odf_text(p) for n in kids(page, "notes") for p in every(n, "p")]
        one["notes"] = "\n".join(notes).strip() or None
        out.append(one)
    return out


def write_odp(slides: list[dict], meta: dict[str, str] | None = None) -> bytes:
    def frame(kind: str, lines: list[str]) -> str:
        return f'<draw:frame presentation:class="{kind}"><draw:text-box>{"".join(map(odf_paragraph, lines))}</draw:text-box></draw:frame>'

    pages = []
    for k, s in enumerate(slides, 1):
        body = frame("title", [s["title"] or ""])
        body += frame("subtitle", [s["subtitle"]]) if s["subtitle"] else ""
        body += frame("outline", [b["text"] for b in s["bullets"]]) if s["bullets"] else ""
        if s["rows"]:
            body += "<draw:frame><table:table>" + "".join("<table:table-row>" + "".join(f"<table:table-cell>{odf_paragraph(c or '')}</table:table-cell>" for c in r) + "</table:table-row>" for r in s["rows"]) + "</table:table></draw:frame>"
        body += f"<presentation:notes><draw:frame><draw:text-box>{''.join(map(odf_paragraph, s['notes'].split(chr(10))))}</draw:text-box></draw:frame></presentation:notes>" if s["notes"] else ""
        pages.append(f'<draw:page draw:name="page{k}">{body}</draw:page>')
    return odf_package("presentation", "".join(pages), meta)


