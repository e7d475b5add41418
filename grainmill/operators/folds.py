"""Ordered folds over groups of rows, for semantics that depend on an order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OUT_ROWS = 10_000


def fold_groups(df: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Gives the rows of each key, as tuples in order, to ``fold``, and returns the rows that it gives back.

    One shuffle to ``spark.sql.shuffle.partitions`` tasks, a number that small
    tables keep too, because the work is in the fold.  A task streams its sorted
    rows and holds one group at a time; ``key`` must be the first column.
    """
    if df.columns[0] != key:
        raise ValueError(f"{key} must be the first column")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for _, group in groupby(rows, key=itemgetter(0)):
            out += fold([*group])
            if len(out) >= _OUT_ROWS:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array([*c], f.type) for c, f in zip(columns, schema)], schema=schema)
