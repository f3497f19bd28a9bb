"""Walking groups in order, for steps that depend on all before them."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

ROWS = 8192
SLICE = 1 << 20


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out by key into as many parts as the session shuffles into, four a core at least. The number is stated, so
    adaptive execution keeps it: narrow rows with much work each would else go to a task or two."""
    return df.repartition(part_count(df), *key)


def dealt_by_rows(df: DataFrame, *key: str, rows: int = 1 << 19) -> DataFrame:
    """Rows dealt out by key into parts of about so many rows, and no fewer than dealt() makes; so a task's sorts hold no more
    of a larger table. The rows are counted first, which for a table as it is read takes its files' footers alone."""
    return df.repartition(parts_by_rows(df, rows=rows), *key)


def parts_by_rows(*dfs: DataFrame, rows: int = 1 << 19) -> int:
    """Into how many parts of about so many rows all of these go together, no fewer than dealt() makes."""
    return max(part_count(dfs[0]), -(-sum(df.count() for df in dfs) // rows))


def spread(df: DataFrame, parts: int, *key: str) -> DataFrame:
    """A table in fewer files than the session has cores, dealt out by key into parts; one in more stays as it is read. A
    file may be one piece, which a single task reads."""
    return df if len(df.inputFiles()) >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(parts, *key)


def part_count(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts have about `most` bytes, one row at least. What is made of a text in Python is
    many times its size, and a batch may hold thousands of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = (np.cumsum(sizes) - sizes) // most
        starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):  # noqa: B905
            yield batch.slice(a, b - a)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 0, size: Callable[[pa.RecordBatch], int] = len) -> Iterator[pa.RecordBatch]:
    """Rows that come a key after the other, in batches of whole keys, of about the least size (rows, where none is given); a
    key is what is kept at most beyond that."""
    held: list[pa.RecordBatch] = []
    most = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column(key)[-1] != batch.column(key)[0] and most >= least:
            yield whole()
            held, most = [], 0
        values = batch.column(key).to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(values[1:] != values[:-1])
        most += size(batch)
        cut = int(turns[-1]) + 1 if len(turns) and most >= least else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield whole()
            held, most = [], size(batch.slice(cut))
        held.append(batch.slice(cut))
    if held:
        yield whole()


def sort_keys(column: pa.Array) -> list[np.ndarray]:
    """Arrays that sort, the last one first, as Spark sorts the column: nulls come first."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return [pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)]
    return [pc.rank(column, null_placement="at_start", tiebreaker="dense").to_numpy()]


def _values(column: pa.Array) -> list:
    """A column as Python values; numbers and lists of them go through numpy, which is several times quicker."""
    kind = column.type
    if pa.types.is_list(kind) and not column.null_count:
        own = _values(column.flatten())
        ends = np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
        return [own[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
    if pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def walk_groups(df: DataFrame, key: str, order: list[str], walk: Callable[[Iterator], Iterable[tuple]], schema: str, dealt_out: bool = False) -> DataFrame:
    """What walk yields for the rows of each key, which it gets one by one in order.

    Keys are dealt out and sorted by Spark; a task streams through its groups, so it holds no more of a group than walk
    itself keeps, and small groups cost no more than their rows. Rows that were dealt out by key already stay where they are.
    """
    made = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("row", names)
        rows = (row(*r) for b in batches for r in zip(*map(_values, b.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, key=attrgetter(key)):
            for r in walk(group):
                out.append(r)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    return (df if dealt_out else df.repartition(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
