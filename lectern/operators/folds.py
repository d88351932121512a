"""Sequential folds over ordered rows of a key, for what no window can express.

Rows are dealt by key and sorted inside partitions; a task walks through them with the state of one key at a time, so
its memory does not grow with a key. What a fold carries must therefore be small."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, key: str, order: list[str], schema: StructType, start: Callable[[], object], step: Callable) -> DataFrame:
    """step(state, row) returns the next state and a list of rows, dicts of `schema`. start() is the state of a new key."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, state = object(), None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                if row[key] != now:
                    now, state = row[key], start()
                state, made = step(state, row)
                out += made
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
