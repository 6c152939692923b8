"""Markdown to blocks: line rules in a row, each of which looks at the next lines and takes those that are
its own. What no rule takes is paragraph text."""

from __future__ import annotations

import re
from collections.abc import Callable

from lakeloom.functions.blocks import block, run

# The marks of the dialect.
BREAKS = ("<pagebreak>", "<pagebreak/>", "\\newpage", "---page---")
BULLETS, AFTER_NUMBER, RULES_OF = "-*+", ".)", "-*_"
INLINE = re.compile(r"\*\*\*(?P<both>[^*]+)\*\*\*|\*\*(?P<bold>[^*]+)\*\*|\*(?P<italic>[^*\n]+)\*|__(?P<underline>[^_]+)__|~~(?P<strike>[^~]+)~~|`(?P<code>[^`]+)`|\[(?P<label>[^\]]+)\]\((?P<link>[^)\s]+)\)")


def inline(text: str) -> list[dict]:
    """Runs of a line; marks do not nest."""
    runs, at = [], 0
    for m in INLINE.finditer(text):
        if m.start() > at:
            runs.append(run(text[at : m.start()]))
        at = m.end()
        if m["both"]:
            runs.append(run(m["both"], bold=True, italic=True))
        elif m["label"]:
            runs.append(run(m["label"], link=m["link"]))
        else:
            runs.append(run(m[m.lastgroup], **{m.lastgroup: True}))
    if at < len(text) or not runs:
        runs.append(run(text[at:]))
    return runs


def plain(text: str) -> str:
    return "".join(r["text"] for r in inline(text))


class Lines:
    """The lines from the one that is read next."""

    def __init__(self, text: str):
        self.all = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.at = 0

    def __bool__(self) -> bool:
        return self.at < len(self.all)

    def see(self, further: int = 0) -> str:
        return self.all[self.at + further] if self.at + further < len(self.all) else ""

    def take(self, wanted: Callable[[str], bool], first: int = 0) -> list[str]:
        """The next ``first`` lines and those after them that are wanted."""
        end = min(self.at + first, len(self.all))
        while end < len(self.all) and wanted(self.all[end]):
            end += 1
        out, self.at = self.all[self.at : end], end
        return out


def cells(line: str) -> list[str]:
    """Cells of a table row; ``\\|`` is a bar."""
    inner = line.strip().removeprefix("|").removesuffix("|")
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", inner)]


def _is_row(line: str) -> bool:
    s = line.strip()
    return len(s) > 1 and s[0] == s[-1] == "|"


def _is_quote(line: str) -> bool:
    return line.lstrip()[:1] == ">"


def _marker(line: str) -> tuple[int, bool, str] | None:
    """Of a list item: its indent in columns, whether it is numbered, and its text."""
    body = line.lstrip()
    mark = re.split(r"\s", body, maxsplit=1)
    numbered = len(mark[0]) > 1 and mark[0][-1] in AFTER_NUMBER and mark[0][:-1].isdecimal()
    if len(mark) < 2 or not numbered and mark[0] not in tuple(BULLETS):
        return None
    return len(line[: len(line) - len(body)].replace("\t", " " * 4)), numbered, mark[1].lstrip()


def page_break(lines: Lines) -> dict | None:
    if lines.see()[:1].isspace() or lines.see().rstrip().lower().replace(" />", "/>") not in BREAKS:
        return None
    lines.at += 1
    return block("pagebreak")


def heading(lines: Lines) -> dict | None:
    level = len(lines.see()) - len(lines.see().lstrip("#"))
    title = lines.see()[level:]
    if not 1 <= level <= 6 or not title[:1].isspace():
        return None
    lines.at += 1
    return block("heading", level=level, text=plain(title.lstrip()))


def ruler(lines: Lines) -> dict | None:
    marks = lines.see().strip().replace(" ", "")
    if len(marks) < 3 or marks[0] not in RULES_OF or marks.strip(marks[0]):
        return None
    lines.at += 1
    return block("hr")


def fence(lines: Lines) -> dict | None:
    if not lines.see().startswith("```"):
        return None
    inside = lines.take(lambda x: not x.startswith("```"), 1)[1:]
    lines.at += 1
    return block("code", text="\n".join(inside))


def table(lines: Lines) -> dict | None:
    below = lines.see(1)
    if not _is_row(lines.see()) or "-" not in below or below.strip(" \t|:-"):
        return None
    head, _, *rest = lines.take(_is_row, 2)
    return block("table", header=True, rows=[cells(x) for x in (head, *rest)])


def quote(lines: Lines) -> dict | None:
    said = lines.take(_is_quote)
    inner = (x.lstrip()[1:] for x in said)
    return block("quote", text="\n".join(x[1:] if x[:1].isspace() else x for x in inner)) if said else None


def picture(lines: Lines) -> dict | None:
    """A line that is an image alone: an address, then perhaps a title in quotes."""
    s = lines.see().strip()
    alt, found, rest = s[2:-1].partition("](")
    if not s.startswith("![") or not s.endswith(")") or not found or "]" in alt:
        return None
    address, _, title = rest.strip().partition(" ")
    title = title.strip()
    if title and (len(title) < 2 or title[0] not in "\"'" or title.find(title[0], 1) != len(title) - 1):
        return None
    lines.at += 1
    return block("image", alt=alt or "图片", name=address)


def listing(lines: Lines) -> dict | None:
    """Items of one kind; deeper lines that are no items go on with the one before."""
    first, items = _marker(lines.see()), []
    goes_on = lambda x: x[:2].isspace() and len(x) > 2 and bool(x.strip()) and _marker(x) is None
    while lines and first and (item := _marker(lines.see())) and item[1] == first[1]:
        more = [x.strip() for x in lines.take(goes_on, 1)[1:]]
        items.append({"level": min(8, item[0] // 2), "text": plain(" ".join([item[2], *more]))})
    return block("list", ordered=first[1], items=items) if items else None


RULES = (page_break, heading, ruler, fence, table, quote, picture, listing)


def parse(text: str | None) -> list[dict]:
    lines, out, words = Lines(text or ""), [], []

    def close() -> None:
        if words:
            out.append(block("paragraph", runs=inline(" ".join(words).strip())))
            words.clear()

    while lines:
        if not lines.see().strip():
            close()
            lines.at += 1
        elif found := next((b for rule in RULES if (b := rule(lines))), None):
            close()
            out.append(found)
        else:
            words.append(lines.see().strip())
            lines.at += 1
    close()
    return out
