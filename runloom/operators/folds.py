"""Folds over ordered rows whose state a prefix sum can't express.

Rows are dealt by group, sorted, and streamed through the fold; state is all that
is kept, so that a group of any length needs no more memory than a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, group: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict], Any], name: str, kind: T.DataType) -> DataFrame:
    """``df`` with column ``name``: step(state, row) -> (state, value) along each group's rows in order."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state: Any = None
        for b in batches:
            values = []
            for row in b.to_pylist():
                of = tuple(row[g] for g in group)
                if now is None or of != now:
                    now, state = of, start()
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, name])

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
