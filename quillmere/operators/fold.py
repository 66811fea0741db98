"""A running value over sorted rows of each group, where the next value hangs on the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def running(rows: DataFrame, keys: list[str], order: list[str], values: list[str], step: Callable, start: tuple, name: str | list[str], carry: list[str] = ()) -> DataFrame:
    """(keys, order, ``carry``, ``name``): ``step(state, *values)`` gives the next state, whose first items are the row's values of the names; columns in ``carry`` pass as they are.

    Rows are dealt by the keys, sorted and streamed: a task holds one state and one batch, never a group, and its time is linear in its rows.
    """
    import pyarrow as pa

    names = [name] if isinstance(name, str) else name
    kept = [*keys, *order, *carry]
    numbered = rows.select(*[rows[c].alias(f"c{i}") for i, c in enumerate([*kept, *values])])
    n, m = len(keys), len(kept)
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches):
        last, state = None, start
        for b in batches:
            out = []
            for key, *given in zip(zip(*(b.column(k).to_pylist() for k in range(n))), *(b.column(k).to_pylist() for k in range(m, m + len(values)))):
                if key != last:
                    last, state = key, start
                state = step(state, *given)
                out.append(state[: len(names)])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(m)], *[pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))]], names=[*kept, *names])

    sort = [f"c{i}" for i in range(n + len(order))]
    return numbered.repartition(*sort[:n]).sortWithinPartitions(*sort).mapInArrow(run, schema)
