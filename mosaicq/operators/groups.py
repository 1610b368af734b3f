"""Python over whole groups, many in one call, so that kernels run over arrays of all of them instead of a call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a call is planned to hold; a group that has more is still whole.
ROWS = 1 << 17


def _new(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; the first one's do."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table[key].combine_chunks()
        for a in (column.is_null(), column.fill_null(0)):
            a = a.to_numpy(zero_copy_only=False)
            new[1:] |= a[1:] != a[:-1]
    return new


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls; one with nulls is an error."""
    if table[name].null_count:
        raise ValueError(f"{name} has nulls")
    return table[name].to_numpy()


def by_groups(df: DataFrame, keys: list[str], order: str, run: Callable[[pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """run(rows, starts) over df's rows, in order of keys (integers) and order, about ROWS at once; groups begin at starts and are whole.

    What run gives back has the columns of schema by name. Rows of equal keys must lie in one partition already."""
    names = [part.split()[0] for part in schema.split(", ")]

    def batch(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        found = run(rows, np.flatnonzero(new))
        arrays = [found[n].combine_chunks() if isinstance(found[n], pa.ChunkedArray) else pa.array(found[n]) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for b in batches:
            kept.append(b)
            held += b.num_rows
            if held < ROWS:
                continue
            rows = pa.Table.from_batches(kept)
            new = _new(rows, keys)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield batch(rows.slice(0, last), new[:last])
            kept = rows.slice(last).to_batches()
            held = rows.num_rows - last if last else 0  # one group alone is looked at again after as many rows more
        if kept:
            rows = pa.Table.from_batches(kept)
            if rows.num_rows:
                yield batch(rows, _new(rows, keys))

    return df.sortWithinPartitions(*keys, order).mapInArrow(each, schema)


def lengths(table: pa.Table, starts: np.ndarray) -> np.ndarray:
    return np.diff(starts, append=table.num_rows)
