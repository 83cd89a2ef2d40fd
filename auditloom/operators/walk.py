"""Rows of a key walked in order, with a small state in hand: for running values that no window frame can express."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def walk(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], start: Callable, step: Callable, adds: str) -> DataFrame:
    """``rows`` with the columns ``adds`` (as DDL): ``step(state, *values of reads)`` gives the next state and their values.

    Rows are dealt by ``keys``, sorted by ``order`` within them, and pass through in batches; ``start()`` makes a key's first
    state. Only the state is held, so a key may have any number of rows; sorting can spill.
    """
    names, new = rows.columns, StructType.fromDDL(adds)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        key, state = None, None
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in reads), strict=True)
            out = []
            for k, given in zip(own, values, strict=True):
                if k != key:
                    key, state = k, start()
                state, told = step(state, *given)
                out.append(told)
            made = pa.Table.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(new)}, schema=pa.schema([(f.name, _arrow(f)) for f in new])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(made.column(f.name).combine_chunks() if made.num_rows else pa.array([], _arrow(f)) for f in new)], [*names, *(f.name for f in new)])

    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *new.fields]))


def _arrow(field) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[field.dataType.simpleString()]
