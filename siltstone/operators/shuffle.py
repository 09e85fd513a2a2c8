"""A shuffle buffer: rows of each partition mixed in passing, in fixed memory and without a shuffle of Spark's.

The buffer is filled first. From then on each row that comes takes the place of a row drawn at random, which goes out;
at the end what is left goes out in random order. So a row comes out at most ``buffer`` places early, whatever the size of
the partition. Draws follow from the seed and the partition's number alone, so a task that runs again gives the same rows
in the same order. Whole rows move; only places are drawn in Python, and Arrow takes the rows.

Partitions are not mixed with each other: a full shuffle is an order by ``corpus.shuffle_key``.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame


def drawn(held: int, fresh: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of ``held`` rows in the buffer and ``fresh`` ones after them: the places that go out, in order, and those that stay."""
    slots, out = list(range(held)), []
    for place, slot in enumerate(rng.integers(0, held, fresh).tolist(), held):
        out.append(slots[slot])
        slots[slot] = place
    return np.array(out, np.int64), np.array(slots, np.int64)


def _mixed(buffer: int, seed: int):
    def mix(batches):
        import pyarrow as pa

        context = TaskContext.get()
        rng = np.random.default_rng([seed, context.partitionId() if context else 0])
        held, waiting, n = None, [], 0

        def turn():
            """Takes the waiting rows in; gives out as many."""
            nonlocal held, waiting, n
            table = pa.Table.from_batches([*held.to_batches(), *waiting] if held is not None else waiting)
            waiting, n = [], 0
            if table.num_rows <= buffer:
                held = table
                return None
            size = held.num_rows if held is not None else 0
            first = max(size, buffer)  # rows that fill the buffer up move nothing
            out, stay = drawn(first, table.num_rows - first, rng)
            held = table.take(pa.array(stay)).combine_chunks()
            return table.take(pa.array(out))

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= max(1, buffer // 2):  # so that the buffer is copied about twice for each row
                out = turn()
                if out is not None:
                    yield from out.to_batches()
        if waiting:
            out = turn()
            if out is not None:
                yield from out.to_batches()
        if held is not None:
            yield from held.take(pa.array(rng.permutation(held.num_rows))).to_batches()

    return mix


def buffered(rows: DataFrame, buffer: int = 10_000, seed: int = 0) -> DataFrame:
    """``rows`` with those of each partition in a new order; a buffer of one row leaves them as they are."""
    if buffer < 1:
        raise ValueError("the buffer must hold a row")
    return rows.mapInArrow(_mixed(buffer, seed), rows.schema)
