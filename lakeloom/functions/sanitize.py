"""What leaves the engine: texts without characters that break readers, values that JSON can hold."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BROKEN = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFE}\x{FFFF}]"


def repaired(text: Column) -> Column:
    return F.regexp_replace(text, BROKEN, "�")


def broken_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BROKEN))


def composed(text: Column) -> Column:
    """Unicode normal form C. Spark has no function for it; plain ASCII does not leave the JVM plan's values."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return nfc(text)


def json_value(x, depth: int = 64, above: tuple = ()):
    """A value that JSON holds as it is: numbers that JSON has not, cycles and what lies deeper than
    ``depth`` become null; times ISO text; bytes base64; sets and other sequences lists; keys text."""
    if isinstance(x, (str, bool)) or x is None or isinstance(x, int):
        return x
    if isinstance(x, float):
        return None if x != x or x in (math.inf, -math.inf) or x == 0 and math.copysign(1, x) < 0 else x
    if isinstance(x, (dt.datetime, dt.date, dt.time)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return json_value(float(x))
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(bytes(x)).decode()
    if depth <= 0 or id(x) in above:
        return None
    inside = lambda v: json_value(v, depth - 1, (*above, id(x)))
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {str(k): inside(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        x = sorted(x, key=repr)
    if hasattr(x, "tolist"):
        x = x.tolist()
    return [inside(v) for v in x] if isinstance(x, (list, tuple)) else str(x)


def accounted(text: Column) -> Column:
    """Struct of a text that may leave, how many of its characters were replaced, and a note of that."""
    n = broken_count(text)
    note = F.when(n > 0, F.concat(n.cast("string"), F.lit(" characters that break readers were replaced")))
    return F.struct(composed(repaired(text)).alias("text"), n.alias("sanitized"), note.alias("note"))


def lossless(number: Column) -> Column:
    """Null for numbers that JSON has not: NaN, infinities, negative zero."""
    lost = F.isnan(number) | (F.abs(number) == float("inf")) | ((number == 0) & (number.cast("string") == "-0.0"))
    return F.when(~lost, number)
