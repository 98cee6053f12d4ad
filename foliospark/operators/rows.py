"""Kernels over Arrow batches: a Python function per row, rows out, bounded batches."""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Tasks for each core that small rows are dealt to before a costly kernel.
TASKS_A_CORE = 4
#: Workers look for cycles after so many new objects: kernels make few cycles and many objects, and keep what documents share.
NEW_OBJECTS = 100_000


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan, dealt evenly if it has fewer partitions than there are tasks to keep all cores busy.

    A row group is never split, so a small file of small rows is one task, however costly what follows. Only a scan
    that is small beside the cluster is dealt; a large one has partitions enough and moves nothing.
    """
    wanted = TASKS_A_CORE * scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def _output(schema: str):
    out_type = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_type)
    wide = [k for k, f in enumerate(out_type) if isinstance(f.dataType, T.StringType | T.BinaryType)]

    def batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

        for row in rows:
            held.append(row)
            for k in wide:
                if (v := row[k]) is not None:
                    size += len(v)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return out_type, batches


def _input(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a few MB at a time."""
    gc.set_threshold(NEW_OBJECTS, 50, 50)
    for batch in batches:
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def kernel(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """fn(*values of a row) yields output tuples. Narrow: no shuffle, and a batch of a few MB at a time."""
    out_type, output = _output(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return output(row for values in _input(batches) for row in fn(*values))

    return df.select(*(list(df.columns) if columns is None else columns)).mapInArrow(run, out_type)


def group_kernel(df: DataFrame, fn: Callable[[Any, Iterator[tuple]], Iterable[tuple]], key: str, order: list[str], columns: list[str], schema: str) -> DataFrame:
    """fn(key, tuples of columns in order) yields output tuples, once for each key.

    One shuffle by key; a group is streamed to fn from the sorted partition and never held as one row. Partitions
    are as many as shuffles have, or more to keep all cores busy: what a group's rows weigh says little of its cost.
    """
    out_type, output = _output(schema)
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for k, group in itertools.groupby(_input(batches), key=lambda r: r[0]):
                yield from fn(k, (r[1:] for r in group))

        return output(rows())

    dealt = df.select(key, *columns, *(c for c in order if c not in columns)).repartition(tasks, key).sortWithinPartitions(key, *order)
    return dealt.select(key, *columns).mapInArrow(run, out_type)
