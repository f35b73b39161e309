"""Helpers for Arrow-batched operators: bounded slices of a batch, whatever the lengths of its texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..plans.materialize import spread


def slices(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column``, texts or lists of words, holds about ``max_chars`` bytes (8 a word); a longer
    text is a slice of its own."""
    values = batch.column(column)
    sizes = (pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_arrow(df: DataFrame, schema: str, column: str, work: Callable[[pa.RecordBatch], dict], max_chars: int = 4 << 20, deal: bool = True) -> DataFrame:
    """``df`` through ``work`` by slices of bounded size; ``work`` returns a dict of columns.  Only a plain scan is dealt out to more
    partitions; with ``deal=False`` the rows stay where they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, max_chars):
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return (spread(df) if deal else df).mapInArrow(run, kind)
