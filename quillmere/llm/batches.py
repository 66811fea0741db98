"""Row-wise Arrow plumbing shared by the text operators.

``append_columns`` runs a function over Arrow batches of one text column and
returns the kept input columns followed by the computed ones. Batches are cut
by bytes, so one run of very long texts cannot fill a worker's memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handed to one call of a batch function.
BATCH_BYTES = 4 << 20

TEXT = "__text"


def column(name: str):
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def cut_by_bytes(batch: pa.RecordBatch, text_index: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch holding about ``limit`` text bytes, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """Columns ``keep`` (all, if None) of ``df`` with ``fields`` computed from ``text_col``.

    ``make()`` runs once a task and returns a function from a string array to one
    array per field; if it has a ``close``, that runs at the task's end. Workers outlive
    tasks, so memory that a task freed is handed back then. A kept column that has the name of a
    computed one gives way to it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # numbered, as a batch function's input can't have names with dots or one name twice
    src = df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], column(text_col).cast("string").alias(TEXT))
    out = T.StructType([*[df.schema[c] for c in kept], *fields])
    at = len(kept)
    names = [*kept, *[f.name for f in fields]]

    def run(batches):
        fn = make()
        try:
            for batch in batches:
                for part in cut_by_bytes(batch, at, limit):
                    made = fn(part.column(at))
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(at)], *made], names=names)
        finally:
            getattr(fn, "close", lambda: None)()
            release_memory()

    return src.mapInArrow(run, out)


def release_memory() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and len+1 offsets into them; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return whole[first:last], offsets - first
