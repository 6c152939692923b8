"""Workbooks: xlsx and ods, both ways. A sheet is {name, rows}, a cell {v, t, f}: text, kind, formula."""

from __future__ import annotations

import datetime as dt
import re
from xml.sax.saxutils import escape, quoteattr

from lakeloom.functions.formula import column
from lakeloom.sources.package import attr, build, every, find, kids, local, members, relations, xml
from lakeloom.sources.wordlike import R, _rels, _types, core_xml, odf_package, odf_paragraph, odf_text

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DATES = {*range(14, 23), *range(45, 48)}  # Fixed values: built-in number formats of dates and times


def cell(v: str, t: str = "s", f: str | None = None) -> dict:
    return {"v": v, "t": t, "f": f}


def letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def serial(x: float) -> str:
    """A date serial of the 1900 system as ISO text; the day alone at midnight."""
    stamp = dt.datetime(1899, 12, 30 if x >= 60 else 31) + dt.timedelta(seconds=round(x * 86400))
    return stamp.strftime("%Y-%m-%d" if x == int(x) else "%Y-%m-%d %H:%M")


def _trim(rows: list[list[dict]]) -> list[list[dict]]:
    for r in rows:
        while r and not r[-1]["v"] and not r[-1]["f"]:
            r.pop()
    while rows and not rows[-1]:
        rows.pop()
    return rows


def _dated(z) -> list[bool]:
    styles = xml(z, "xl/styles.xml")
    custom = {int(attr(n, "numFmtId", "0")): attr(n, "formatCode", "") for n in every(styles, "numFmt")}

    def is_date(k: int) -> bool:
        return k in DATES or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(k, "")), re.I)) and custom.get(k, "").lower() != "general"

    return [is_date(int(attr(x, "numFmtId", "0"))) for x in kids(find(styles, "cellXfs"), "xf")]


def read_xlsx(data: bytes) -> list[dict]:
    z = members(data)
    shared = ["".join(t.text or "" for t in every(si, "t")) for si in kids(xml(z, "xl/sharedStrings.xml"), "si")]
    dated, targets, sheets = _dated(z), relations(z, "xl/workbook.xml"), []
    for s in every(xml(z, "xl/workbook.xml"), "sheet"):
        grid: list[list[dict]] = []
        for r in every(xml(z, targets[attr(s, "id")]), "row"):
            at = int(attr(r, "r", str(len(grid) + 1))) - 1
            grid += [[] for _ in range(at + 1 - len(grid))]
            for c in kids(r, "c"):
                ref = attr(c, "r")
                col = column(re.match("[A-Z]+", ref)[0]) if ref else len(grid[at])
                grid[at] += [cell("") for _ in range(col + 1 - len(grid[at]))]
                raw, kind, f = getattr(find(c, "v"), "text", None) or "", attr(c, "t", "n"), getattr(find(c, "f"), "text", None)
                if kind == "s":
                    made = cell(shared[int(raw)] if raw else "", "s", f)
                elif kind == "inlineStr":
                    made = cell("".join(t.text or "" for t in every(c, "t")), "s", f)
                elif kind == "b":
                    made = cell("TRUE" if raw == "1" else "FALSE", "b", f)
                elif kind in ("e", "str"):
                    made = cell(raw, "e" if kind == "e" else "s", f)
                elif raw and (k := int(attr(c, "s", "0"))) < len(dated) and dated[k]:
                    made = cell(serial(float(raw)), "d", f)
                else:
                    made = cell(raw, "n" if raw else "s", f)
                grid[at][col] = made
        sheets.append({"name": attr(s, "name"), "rows": _trim(grid)})
    return sheets


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: without reserved characters, 31 long at most, each once."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", n or "").strip("'")[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base[: 31 - len(str(k)) - 1]}_{k}", k + 1
        out.append(name)
    return out


def write_xlsx(sheets: list[dict], meta: dict[str, str] | None = None) -> bytes:
    names = sheet_names([s["name"] for s in sheets])
    parts: dict[str, str] = {}
    for k, s in enumerate(sheets, 1):
        rows = []
        for i, r in enumerate(s["rows"]):
            cells = []
            for j, c in enumerate(r):
                ref, f = f"{letters(j)}{i + 1}", f"<f>{escape(c['f'].lstrip('='))}</f>" if c.get("f") else ""
                if c["t"] == "n" and c["v"]:
                    cells.append(f'<c r="{ref}">{f}<v>{escape(c["v"])}</v></c>')
                elif c["t"] == "b":
                    cells.append(f'<c r="{ref}" t="b">{f}<v>{int(c["v"] == "TRUE")}</v></c>')
                elif c["t"] == "e":
                    cells.append(f'<c r="{ref}" t="e">{f}<v>{escape(c["v"])}</v></c>')
                elif f:
                    cells.append(f'<c r="{ref}" t="str">{f}<v>{escape(c["v"])}</v></c>')
                elif c["v"]:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(c["v"])}</t></is></c>')
            rows.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{S}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
    return build({
        "[Content_Types].xml": _types({"xl/workbook.xml": f"{kind}.sheet.main+xml", **{p: f"{kind}.worksheet+xml" for p in parts}}),
        "_rels/.rels": _rels([("r1", "officeDocument", "xl/workbook.xml", False)]),
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{S}" xmlns:r="{R}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels([(f"r{k}", "worksheet", f"worksheets/sheet{k}.xml", False) for k in range(1, len(sheets) + 1)]),
        "docProps/core.xml": core_xml(meta or {}), **parts,
    })


def read_ods(data: bytes, repeat: int = 400, columns: int = 128, rows: int = 4000) -> list[dict]:
    """Repeated cells and rows are expanded up to the limits."""
    sheets = []
    for t in every(xml(members(data), "content.xml"), "table"):
        grid: list[list[dict]] = []
        for r in every(t, "table-row"):
            line: list[dict] = []
            for c in r:
                if local(c) not in ("table-cell", "covered-table-cell"):
                    continue
                kind, text = attr(c, "value-type", "string"), "\n".join(map(odf_text, kids(c, "p")))
                made = {"float": cell(attr(c, "value", text), "n"), "percentage": cell(attr(c, "value", text), "n"), "currency": cell(attr(c, "value", text), "n"), "boolean": cell((attr(c, "boolean-value", "") or "").upper(), "b")}.get(kind, cell(attr(c, "date-value") or text, "s"))
                formula = attr(c, "formula")
                made["f"] = "=" + formula.partition("=")[2].replace("[.", "").replace("]", "") if formula else None
                line += [dict(made) for _ in range(min(repeat, int(attr(c, "number-columns-repeated", "1"))))]
            times = min(repeat, int(attr(r, "number-rows-repeated", "1")))
            grid += [[dict(c) for c in line[:columns]] for _ in range(times if any(c["v"] for c in line) else 1)]
        sheets.append({"name": attr(t, "name", ""), "rows": _trim(grid[:rows])})
    return sheets


def write_ods(sheets: list[dict], meta: dict[str, str] | None = None) -> bytes:
    def one(c: dict) -> str:
        if c["t"] == "n" and c["v"]:
            kind = f'office:value-type="float" office:value="{c["v"]}"'
        elif c["t"] == "b":
            kind = f'office:value-type="boolean" office:boolean-value="{c["v"].lower()}"'
        else:
            kind = 'office:value-type="string"'
        return f"<table:table-cell {kind}>{odf_paragraph(c['v'])}</table:table-cell>"

    tables = "".join(f"<table:table table:name={quoteattr(n)}>" + "".join("<table:table-row>" + "".join(map(one, r)) + "</table:table-row>" for r in s["rows"]) + "</table:table>" for n, s in zip(sheet_names([s["name"] for s in sheets]), sheets))
    return odf_package("spreadsheet", tables, meta)
