"""Blocks to an HTML page."""

from __future__ import annotations

from html import escape

# Elements of run marks, outermost first.
MARKS = {"bold": "strong", "italic": "em", "underline": "u", "strike": "s", "code": "code"}


def _run(r: dict) -> str:
    text = escape(r["text"]).replace("\n", "<br>")
    for field, tag in reversed(MARKS.items()):
        if r.get(field):
            text = f"<{tag}>{text}</{tag}>"
    return f'<a href="{escape(r["link"])}">{text}</a>' if r.get("link") else text


def _list(items: list[dict], tag: str) -> str:
    """Nested lists from items with levels: an item deeper than its predecessor opens lists inside it."""
    out, depth = [f"<{tag}>"], 0
    for k, i in enumerate(items):
        level = min(i["level"], depth + 1) if k else 0
        if k:
            out.append(f"<{tag}>" if level > depth else "</li>" + f"</{tag}></li>" * (depth - level))
        out.append(f"<li>{escape(i['text'])}")
        depth = level
    return "".join(out) + (f"</li></{tag}>" * (depth + 1) if items else f"</{tag}>")


def _table(b: dict) -> str:
    row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{escape(c or '')}</{tag}>" for c in r) + "</tr>"
    rows = b["rows"]
    return "<table>" + "".join(row(r, "th" if b["header"] and k == 0 else "td") for k, r in enumerate(rows)) + "</table>"


def render(blocks: list[dict], meta: dict | None = None) -> str:
    body = []
    for b in blocks:
        inline = "".join(map(_run, b["runs"])) if b["runs"] else escape(b["text"] or "").replace("\n", "<br>")
        body.append({
            "heading": lambda: f"<h{b['level']}>{inline}</h{b['level']}>", "list": lambda: _list(b["items"], "ol" if b["ordered"] else "ul"), "table": lambda: _table(b),
            "code": lambda: f"<pre><code>{escape(b['text'] or '')}</code></pre>", "quote": lambda: f"<blockquote>{inline}</blockquote>", "hr": lambda: "<hr>", "pagebreak": lambda: '<div style="page-break-after:always"></div>',
            "image": lambda: f'<img alt="{escape(b["alt"] or "")}" src="{escape(b["name"] or "")}">',
        }.get(b["type"], lambda: f"<p>{inline}</p>")())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape((meta or {}).get("title", ""))}</title></head><body>{"".join(body)}</body></html>'
