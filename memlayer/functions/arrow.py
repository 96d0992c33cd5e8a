"""Rows of Python values as Arrow batches of a Spark schema."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def record_batch(rows: Iterable[tuple], schema: StructType) -> pa.RecordBatch:
    """A batch of at least one row, each column of the type that Spark expects."""
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
