"""Folds over ordered rows whose next step depends on the last decision, read as a stream.

A key's rows go to one task in their order, but only the state of the fold is kept, not the rows: a key of any length
needs the memory of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def folded(rows: DataFrame, keys: list[str], order: list, inputs: list[str], name: str, kind: str, begin: Callable[[], Callable]) -> DataFrame:
    """rows with the column `name` of the type `kind`: what a step makes of the inputs of each row. begin() gives a new step for each key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, step = None, None
        for batch in batches:
            out = []
            for key, values in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if step is None or key != of:
                    of, step = key, begin()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, {"int": pa.int32(), "boolean": pa.bool_()}[kind])], [*batch.schema.names, name])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
