"""Buckets of rows that share a key, worked on in a stream.

Rows are hashed by key and sorted within each partition, so that a bucket is a run of rows.
Runs up to a limit go to a vectorised function, many runs of one length at a time. A longer
run is never held: its rows are passed on, marked, for the caller to split by a longer key; if
asked, they are also worked on in windows of the limit, in the order of further columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells (runs x pairs) worked on at once.
CELLS = 2_000_000

Pairs = Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    out = []
    for c in batch.columns:
        if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            width = len(c[0].as_py()) if len(c) else 0
            flat = np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8)
            out.append(flat.reshape(len(c), width))
        else:
            out.append(c.to_numpy(zero_copy_only=False))
    return out


def bucket_runs(df: DataFrame, limit: int, work: Pairs, work_schema: pa.Schema, big_fields: list[int], schema: str, windows_by: str | None = None) -> DataFrame:
    """df: first column the bucket key (long), then columns of numbers or binaries of one width.

    work(columns, idx) gets the columns of a stretch and the row numbers of equally long runs,
    one run a row of idx, and returns the columns of work_schema. The result has a boolean
    column "big", work_schema's columns, then the columns big_fields of rows in long runs
    (null in other rows).
    """
    n_work = len(work_schema)

    def emit(found: list[np.ndarray] | None, cols: list[np.ndarray] | None, big_types: list) -> pa.RecordBatch:
        n = len(found[0]) if found is not None else len(cols[0])
        arrays = [pa.array(np.full(n, found is None))]
        for k in range(n_work):
            arrays.append(pa.array(found[k], work_schema.field(k).type) if found is not None else pa.nulls(n, work_schema.field(k).type))
        for k, kind in zip(big_fields, big_types):
            if cols is None:
                arrays.append(pa.nulls(n, kind))
            elif cols[k].ndim == 2:
                arrays.append(pa.array([x.tobytes() for x in cols[k]], kind))
            else:
                arrays.append(pa.array(cols[k], kind))
        return pa.RecordBatch.from_arrays(arrays, ["big", *work_schema.names, *(f"c{k}" for k in big_fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        long_key = None
        big_types: list = []

        def long_rows(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield emit(None, cols, big_types)
            if windows_by is not None:
                for k in range(0, len(cols[0]) - 1, limit):
                    found = work(cols, np.arange(k, min(k + limit, len(cols[0])))[None, :])
                    if len(found[0]):
                        yield emit(found, None, big_types)

        def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """All runs of cols are whole, but for the rest of the long run under way."""
            nonlocal long_key
            key = cols[0]
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lens = np.diff(np.r_[starts, len(key)])
            for s, m in zip(starts[lens > limit], lens[lens > limit]):
                yield from long_rows([c[s : s + m] for c in cols])
            for m in np.unique(lens[(lens > 1) & (lens <= limit)]):
                at = starts[lens == m]
                step = max(1, CELLS // int(m * m))
                for k in range(0, len(at), step):
                    found = work(cols, at[k : k + step, None] + np.arange(m))
                    if len(found[0]):
                        yield emit(found, None, big_types)

        for batch in batches:
            if not batch.num_rows:
                continue
            big_types = [batch.schema.field(k).type for k in big_fields]
            cols = _columns(batch)
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            key = cols[0]
            if long_key is not None:  # goes on, or ends here
                m = int(np.argmax(np.r_[key != long_key, True]))
                if m:
                    yield from long_rows([c[:m] for c in cols])
                    cols = [c[m:] for c in cols]
                    key = cols[0]
                if not len(key):
                    carry = None
                    continue
                long_key = None
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            yield from done([c[:last] for c in cols])
            carry = [c[last:] for c in cols]
            if len(carry[0]) > limit:
                long_key = carry[0][0]
                yield from long_rows(carry)
                carry = None
        if carry is not None:
            yield from done(carry)

    key = df.columns[0]
    return df.repartition(key).sortWithinPartitions(key, *[windows_by] * (windows_by is not None)).mapInArrow(run, schema)
