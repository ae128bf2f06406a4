"""Folds over a key's rows in order, as a sorted stream.

Rows are dealt by key and sorted inside each partition; a task reads them one Arrow batch
at a time and keeps only the state of the key at hand, so a key of any number of rows
needs no more memory than another. Results leave as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Result rows that leave a task at once.
AT_ONCE = 8192


def fold_sorted(
    rows: DataFrame,
    keys: list[str],
    order: list,
    columns: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, tuple], tuple | None],
    schema: str,
    finish: Callable[[Any], tuple | None] | None = None,
) -> DataFrame:
    """Keys and the columns of ``schema``.

    ``step(state, values of columns)`` changes the state and returns a result row or None;
    ``finish(state)`` gives the key's last row. Equal order values must not matter.
    """
    given = [*keys, *columns]
    extra = StructType.fromDDL(schema)
    out_type = StructType([*[rows.schema[k] for k in keys], *extra.fields])
    arrow, n = to_arrow_schema(out_type), len(keys)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, state = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        def close() -> None:
            if at is not None and finish and (row := finish(state)) is not None:
                out.append((*at, *row))

        for part in parts:
            for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in given)):
                if row[:n] != at:
                    close()
                    at, state = row[:n], start()
                if (found := step(state, row[n:])) is not None:
                    out.append((*at, *found))
            if len(out) >= AT_ONCE:
                yield told()
                out.clear()
        close()
        if out:
            yield told()

    dealt = rows.select(*given, *[c for c in order if isinstance(c, str) and c not in given])
    return dealt.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, out_type)
