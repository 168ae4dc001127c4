"""Groups of rows from a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def key_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, which stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(len(names) + 1):
            if i == len(names) or names[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if i < len(names):
                    if held:
                        yield pa.Table.from_batches(held).combine_chunks()
                    held, last, start = [], names[i], i
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
