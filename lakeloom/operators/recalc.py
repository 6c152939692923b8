"""Recalculation of workbooks: one workbook is one group, as its formulas may refer to any cell."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def recalculate(cells: DataFrame, book: str = "book", most: int | None = 5_000_000) -> DataFrame:
    """(book, sheet, row, col, v, state) of every formula among cells (book, sheet, row, col, v, t, f).

    A workbook is what a task holds. One of more than ``most`` cells (None: of any size) is let go as soon as
    it has shown more: it stays as it is, and its formulas have the state ``skipped``. The cells are shuffled
    once, and nothing is counted or joined before.
    """
    kind = cells.schema[book].dataType.simpleString()
    result = f"`{book}` {kind}, sheet string, row int, col int, v string, state string"
    target = to_arrow_schema(StructType.fromDDL(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Workbooks lie side by side within the partition; one may span batches."""
        out: list[tuple] = []
        held, over = [], False

        def ended() -> None:
            if held:
                name = held[0][0]
                out.extend((name, *place, v, state) for place, v, state in _solve(held))

        def skipped(rows: list[tuple]) -> None:
            out.extend((*r[:5], "skipped") for r in rows if r[6])

        name: object = None
        for b in batches:
            for own, part in groupby(zip(*map(_values, b.columns)), key=itemgetter(0)):
                if own != name:
                    ended()
                    name, held, over = own, [], False
                rows = list(part)
                if over:
                    skipped(rows)
                else:
                    held += rows
                    if most is not None and len(held) > most:
                        skipped(held)
                        held, over = [], True
                if len(out) > 10_000:
                    yield _batch(out, target)
                    out = []
        ended()
        yield _batch(out, target)

    # By a hash of its own: a repartition by the key itself is left out where the planner holds the rows to be
    # dealt by it already, which of a union of joined parts does not stay true when joins are planned anew.
    rows = cells.select(book, "sheet", F.col("row").cast("int"), F.col("col").cast("int"), "v", "t", "f")
    return rows.repartition(F.xxhash64(book)).sortWithinPartitions(book).mapInArrow(run, result)


def _values(column: pa.Array) -> list:
    """A column as a list; without nulls, numbers come faster by way of numpy, and texts in any case."""
    if pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@lru_cache(50_000)
def _number(text: str) -> float | None:
    from lakeloom.functions.formula import num

    return num(text)


def _solve(rows: list[tuple]) -> list[tuple]:
    """(place, value as text, state) of the formulas of one workbook."""
    from lakeloom.functions.formula import recalculate as solve, show

    values = {r[1:4]: "" if r[4] is None else _number(r[4]) if r[5] == "n" else r[4] == "TRUE" if r[5] == "b" else r[4] for r in rows}
    formulas = {r[1:4]: r[6] for r in rows if r[6]}
    return [(p, show(v), s) for p, (v, s) in solve(values, formulas, sorted({r[1] for r in rows if r[1] is not None})).items()]


def census(results: DataFrame, book: str = "book") -> DataFrame:
    """Per workbook: formulas, evaluated, errors, unsupported, and the distinct tokens that were not."""
    token = F.when(F.col("state").startswith("unsupported:"), F.substring_index("state", ":", -1))
    return results.groupBy(book).agg(F.count("*").alias("formulas"), F.count_if(F.col("state").isin("ok", "error")).alias("evaluated"), F.count_if(F.col("state") == "error").alias("errors"), F.count_if(token.isNotNull()).alias("unsupported"), F.array_sort(F.collect_set(token)).alias("tokens"))
