"""A value per text, added to rows in place: all columns travel through, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clientele.llm.words import slices


def with_text_value(docs: DataFrame, text: str, name: str, kind: str, value: Callable[[list], list]) -> DataFrame:
    """``docs`` with a further column ``name`` of Spark type ``kind``: ``value`` of lists of texts (or nulls)."""
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])
    arrow = {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}[kind]
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, text):
            found = pa.array(value(batch.column(batch.schema.get_field_index(text)).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    return docs.mapInArrow(rows, schema)
