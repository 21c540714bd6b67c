"""Row-wise work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have: the wish, with underscores after it as needed."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def with_verdict(
    df: DataFrame,
    compute: Callable[..., pa.Array],
    inputs: Sequence[str],
    kind: T.DataType,
    name: str,
    keep: Sequence[str] | None = None,
    rows: int = 2000,
) -> DataFrame:
    """Rows of df with one more column, made batch by batch by compute(*input columns). No shuffle.

    keep: the columns that stay, all by default; name must be free in them (see free_name).
    rows: at most so many rows are handed to compute at once, so that its arrays stay small.
    """
    keep = list(df.columns if keep is None else keep)
    need = list(dict.fromkeys([*keep, *inputs]))
    out = T.StructType([df.schema[c] for c in keep]).add(T.StructField(name, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = compute(*(batch.column(need.index(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(batch.column(need.index(c)) for c in keep), made], names=[*keep, name])

    return df.select(*(df[f"`{c}`"] for c in need)).mapInArrow(run, out)
