"""Streaming over the groups of sorted partitions, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def shared_keys(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by a long column, those whose value occurs twice or more; holds one row at a time back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        last_twin = False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(column).to_numpy()
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None:
                twin = last.column(column)[0].as_py() == t[0]
                keep[0] |= twin
                if twin or last_twin:
                    yield last
            last, last_twin = batch.slice(len(t) - 1, 1), bool(keep[-1])
            if keep[:-1].any():
                yield batch.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
        if last is not None and last_twin:
            yield last

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int, weigh: Callable[[pa.RecordBatch], int] | None = None, whole: bool = False) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, part) from batches sorted by a long column: whole groups together, up to about `most` rows or their
    weight; a group beyond that comes in several tables, each with part = True, or in one if `whole`."""
    held: list[pa.RecordBatch] = []
    size, over = 0, None
    weigh = weigh or (lambda x: x.num_rows)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = batch.slice(at, 2000)
            key = rows.column(column).to_numpy()
            if over is not None:
                upto = len(key) if key[-1] == over else int(np.argmax(key != over))
                if upto:
                    yield pa.Table.from_batches([rows.slice(0, upto)]).combine_chunks(), True
                if upto == len(key):
                    continue
                over, rows, key = None, rows.slice(upto), key[upto:]
            held.append(rows)
            size += weigh(rows)
            if size < most:
                continue
            if held[0].column(column)[0].as_py() == key[-1]:  # one group so far
                if not whole:
                    yield pa.Table.from_batches(held).combine_chunks(), True
                    held, size, over = [], 0, key[-1]
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(column).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield table.slice(0, cut).combine_chunks(), False
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(weigh(x) for x in held)
            if size >= most and not whole:
                yield pa.Table.from_batches(held).combine_chunks(), True
                held, size, over = [], 0, keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False
