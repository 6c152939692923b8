"""Spreadsheet semantics as columns: coercion, operators with error values, scalar functions, criteria.

A cell is a struct with the fields t (n, s, b, e), num, str, bool and error. Errors pass through
operators, the left one first; aggregates skip them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error names.
REF, DIV0, VALUE, NAME, NUM, NA, CIRC = "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NUM!", "#N/A", "#CIRC!"
NUMERIC = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?%?$"
CELL = "struct<t:string,num:double,str:string,bool:boolean,error:string>"


def cell(t: str, value: Column) -> Column:
    null = F.lit(None)
    fields = {"n": "num", "s": "str", "b": "bool", "e": "error"}
    kinds = {"num": "double", "str": "string", "bool": "boolean", "error": "string"}
    return F.struct(F.lit(t).alias("t"), *((value if fields[t] == f else null).cast(k).alias(f) for f, k in kinds.items()))


def number(value: Column) -> Column:
    return cell("n", value)


def text(value: Column) -> Column:
    return cell("s", value)


def boolean(value: Column) -> Column:
    return cell("b", value)


def error(name: str) -> Column:
    return cell("e", F.lit(name))


def parse_number(value: Column) -> Column:
    """The number that a trimmed text stands for (a percent sign divides by 100), else null."""
    t = F.trim(value)
    plain = F.regexp_replace(t, "%$", "").try_cast("double")
    return F.when(t.rlike(NUMERIC), F.when(t.endswith("%"), plain / 100).otherwise(plain))


def num_of(c: Column) -> Column:
    return F.when(c["t"] == "n", c["num"]).when(c["t"] == "b", c["bool"].cast("double")).when(c["t"] == "s", parse_number(c["str"]))


def number_text(x: Column) -> Column:
    """A number as text: whole numbers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text_of(c: Column) -> Column:
    word = F.when(c["bool"], "TRUE").otherwise("FALSE")
    return F.when(c["t"] == "n", number_text(c["num"])).when(c["t"] == "b", word).otherwise(F.coalesce(c["str"], F.lit("")))


def infer(value: Column) -> Column:
    """A number where the text is one and has no leading zero before a digit, else the text."""
    is_number = value.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$") & ~value.rlike(r"^0\d")
    return F.when(is_number, number(value.try_cast("double"))).otherwise(text(F.coalesce(value, F.lit(""))))


def guard(result: Column, *args: Column) -> Column:
    """The first error among args, else the result."""
    out = None
    for a in args:
        out = F.when(a["t"] == "e", a) if out is None else out.when(a["t"] == "e", a)
    return result if out is None else out.otherwise(result)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """+ - * / ^ over cells: what is no number gives #VALUE!, division by zero #DIV/0!."""
    x, y = num_of(a), num_of(b)
    bad = x.isNull() | y.isNull()
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / F.nullif(y, F.lit(0.0)), "^": lambda: F.pow(x, y)}[op]()
    case = F.when(bad, error(VALUE))
    if op == "/":
        case = case.when(y == 0, error(DIV0))
    return guard(case.otherwise(number(out)), a, b)


def concat(a: Column, b: Column) -> Column:
    return guard(text(F.concat(text_of(a), text_of(b))), a, b)


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: as numbers if both are, else as texts (case-sensitive)."""
    x, y, s, t = num_of(a), num_of(b), text_of(a), text_of(b)
    sign = lambda p, q: F.when(p == q, 0).when(p < q, -1).otherwise(1)
    return F.when(x.isNotNull() & y.isNotNull(), sign(x, y)).otherwise(sign(s, t))


def compare(op: str, a: Column, b: Column) -> Column:
    c = order(a, b)
    out = {"=": c == 0, "<>": c != 0, "<": c < 0, ">": c > 0, "<=": c <= 0, ">=": c >= 0}[op]
    return guard(boolean(out), a, b)


def percent(a: Column) -> Column:
    x = num_of(a)
    return F.when(x.isNull(), error(VALUE)).otherwise(number(x / 100))


def negate(a: Column) -> Column:
    x = num_of(a)
    return F.when(x.isNull(), error(VALUE)).otherwise(number(-x))


def truthy(c: Column) -> Column:
    return F.when(c["t"] == "b", c["bool"]).when(num_of(c).isNotNull(), num_of(c) != 0).otherwise(F.length(text_of(c)) > 0)


def if_(c: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(c["t"] == "e", c).when(truthy(c), yes).otherwise(boolean(F.lit(False)) if no is None else no)


def round_(x: Column, digits: int | Column = 0, excel: bool = False) -> Column:
    """Halves go up after a nudge away from zero; with ``excel``, always away from zero."""
    f = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    if excel:
        return F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f
    return F.floor((x + F.pow(F.lit(2.0), F.lit(-52.0)) * F.signum(x)) * f + 0.5) / f


def round_up(x: Column, digits: int = 0) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) * 10.0**digits) / 10.0**digits


def round_down(x: Column, digits: int = 0) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits) / 10.0**digits


def mod(a: Column, b: Column) -> Column:
    """The sign follows the divisor; null where it is zero."""
    return a - b * F.floor(a / F.nullif(b, F.lit(0)))


def left(s: Column, k: int | Column = 1) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k < 0, error(VALUE)).otherwise(text(F.substring(s, F.lit(1), k)))


def right(s: Column, k: int | Column = 1) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k < 0, error(VALUE)).otherwise(text(F.right(s, k)))


def mid(s: Column, start: int | Column, k: int | Column) -> Column:
    start, k = (F.lit(x) if isinstance(x, int) else x for x in (start, k))
    return F.when((start < 1) | (k < 0), error(VALUE)).otherwise(text(F.substring(s, start, k)))


def trim(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"\s+", " ")


def value(s: Column) -> Column:
    """VALUE: without commas, (x) negative, percent divided by 100, else #VALUE!."""
    t = F.regexp_replace(F.trim(s), ",", "")
    t = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    x = parse_number(t)
    return F.when(x.isNull(), error(VALUE)).otherwise(number(x))


def format_number(x: Column, pattern: str) -> Column | None:
    """TEXT for patterns of ``# 0 , .`` and a percent sign; None for others."""
    if not re.fullmatch(r"[#0,.]+%?", pattern):
        return None
    body = pattern.removesuffix("%")
    digits = len(re.findall("[0#]", body.partition(".")[2]))
    shown = F.abs(x * 100 if pattern.endswith("%") else x)
    units = F.floor(shown * 10**digits + 0.5).cast("bigint")
    whole = (units / 10**digits).cast("bigint").cast("string") if not digits else F.expr("1").cast("string")
    if digits:
        padded = F.lpad(units.cast("string"), 40, "0")
        whole = F.regexp_replace(F.substring(padded, 1, 40 - digits), "^0+(?=.)", "")
    if "," in body:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    out = F.concat(whole, F.lit("."), F.right(padded, F.lit(digits))) if digits else whole
    sign = F.when((x < 0) & (units > 0), "-").otherwise("")
    return F.concat(sign, out, F.lit("%" if pattern.endswith("%") else ""))


def criterion(c: Column, spec: str) -> Column:
    """The predicate that a criterion such as ``>=5``, ``<>x`` or ``a*?`` is over cells."""
    op, target = re.fullmatch(r"(<=|>=|<>|<|>|=)?([\s\S]*)", spec.strip()).groups()
    op = op or "="
    if op in ("=", "<>"):
        if re.search(r"[*?]", target):
            pattern = "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in target)
            hit = text_of(c).rlike(f"(?i)^{pattern}$")
        else:
            hit = order(c, text(F.lit(target))) == 0
        return hit if op == "=" else ~hit
    y = parse_number(F.lit(target))
    x = F.when(c["t"] == "n", c["num"])
    out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.coalesce(out, F.lit(False))


def column_name(index: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column's index from 0 (three letters at most)."""
    n = index + 1
    letter = lambda k: F.chr((k + 65).cast("int"))
    last, rest = (n - 1) % 26, F.floor((n - 1) / 26)
    middle, first = (rest - 1) % 26, F.floor((rest - 1) / 26)
    return F.concat(F.when(first > 0, letter(first - 1)).otherwise(""), F.when(rest > 0, letter(middle)).otherwise(""), letter(last))


def column_index(ref: Column) -> Column:
    """The index from 0 of the column of a reference such as ``$AB$12``."""
    letters = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?\d{1,7}$", 1))
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64)) - 1


def serial_to_date(serial: Column) -> Column:
    """ISO text of a date serial of the 1900 system: date alone at midnight."""
    days = F.floor(serial)
    stamp = F.timestamp_millis((F.round((serial - F.when(days >= 60, 1).otherwise(0) - 25568) * 86400) * 1000).cast("bigint"))
    return F.when(days == serial, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm"))
