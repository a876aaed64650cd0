"""Table-generating Python functions, run over Arrow batches where expressions cannot tokenise."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Generated rows are passed on at this number, so that one long text's rows are never all in memory with others'.
ROWS = 4096
#: Of a batch, so many rows are Python objects at once.
TAKEN = 32


def generate(df: DataFrame, keep: list[str], args: list[str], fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The kept columns of each row with every tuple that fn(*args) gives; rows without tuples vanish.

    No shuffle: rows are generated where they are. Filter with a cheap native guard before, since every row that
    reaches this point travels to Python.
    """
    import pyarrow as pa

    out = T.StructType([*[df.schema[c] for c in keep], *T._parse_datatype_string(schema).fields])
    if len(set(map(str.lower, out.names))) < len(out):
        raise ValueError(f"columns of equal names: {out.names}")
    arrow = to_arrow_schema(out)
    n = len(keep)

    def run(batches: Iterable) -> Iterator:
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for taken in (batch.slice(i, TAKEN) for i in range(0, batch.num_rows, TAKEN)):
                for values in zip(*(taken.column(i).to_pylist() for i in range(taken.num_columns)), strict=True):
                    for made in fn(*values[n:]):
                        rows.append((*values[:n], *made))
                        if len(rows) >= ROWS:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()

    picked = df.select(*keep, *[F.col(a).alias(f"_arg{i}") for i, a in enumerate(args)])
    return picked.mapInArrow(run, out)
