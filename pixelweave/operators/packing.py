"""Rows sent as arrays: neighbours of one key become one row before a shuffle.

Most tables of an operator chain come out of tasks that held a whole tile or
scene, so a batch has long runs of one key. A run is sent as one row of arrays,
which a shuffle moves and sorts as such; scattered rows are sent as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_SCATTERED = 8      # rows in a run, below which a batch is sorted first


def run_starts(b: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First row of each run of equal keys, and the end."""
    new = np.zeros(max(0, b.num_rows - 1), bool)
    for k in keys:
        one, two = b.column(k).slice(0, b.num_rows - 1), b.column(k).slice(1)
        new |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        if b.column(k).null_count:
            new |= pc.xor(one.is_null(), two.is_null()).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [b.num_rows]])


def pack_runs(b: pa.RecordBatch, keys: Sequence[str], cols: Sequence[str]) -> pa.RecordBatch:
    """Runs of equal keys of a batch as rows of (keys, cols as arrays)."""
    cuts = run_starts(b, keys)
    if keys and len(cuts) * _SCATTERED > b.num_rows:
        b = b.sort_by([(k, "ascending") for k in keys])
        cuts = run_starts(b, keys)
    first, ends = pa.array(cuts[:-1]), pa.array(cuts, pa.int32())
    return pa.RecordBatch.from_arrays([*(b.column(k).take(first) for k in keys),
                                       *(pa.ListArray.from_arrays(ends, b.column(c)) for c in cols)], names=[*keys, *cols])


def packed(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, cols as arrays): each run of rows with equal keys as one row. Rows
    of a key keep no order and may be spread over several rows."""
    kinds = dict(df.dtypes)
    keys, cols = list(keys), list(cols)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pack_runs(b, keys, cols)

    return df.select(*keys, *cols).mapInArrow(pack, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{c}` array<{kinds[c]}>" for c in cols)]))


def flat(table: pa.Table, name: str) -> np.ndarray:
    """The values of an array column end to end."""
    return pc.list_flatten(table.column(name)).to_numpy()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows laid out by ``keys`` over all cores: for few rows that take long, as
    adaptive coalescing counts bytes."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
