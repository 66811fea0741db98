"""Searches as matrix products: blocks of queries against slices of rows, the k best of each query kept by every task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.tables import staged


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query") -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Query vectors of one block of a search.
BLOCK = 2048


def _blocks(rows: DataFrame, size: int, weigh=None):
    """Lists of rows of at most ``size``, as their number or as ``weigh`` has it, streamed from a table; one empty list if it has none."""
    held, total, some = [], 0, False
    for r in rows.toLocalIterator():
        n = weigh(r) if weigh else 1
        if held and total + n > size:
            yield held
            held, total, some = [], 0, True
        held.append(r)
        total += n
    if held or not some:
        yield held


#: Rows, and products of queries and rows, that a task looks at together.
ROWS, PRODUCT = 1024, 1 << 20
#: Numbers that the rows which a task looks at together have as one dense block.
CELLS = 1 << 21


class _Best:
    """The k best rows of each query (line) so far; ties go to the smaller id."""

    def __init__(self, lines: int, k: int):
        import numpy as np

        self.k, self.line, self.doc, self.score = k, np.zeros(0, np.int64), None, np.zeros(0)
        self.bar = np.full(lines, -np.inf)  # a line's k-th best score

    def add(self, s, docs) -> None:
        """Scores of all lines and these rows; no more than what may be among the k best is sorted."""
        import numpy as np

        least = np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else np.full(len(s), -np.inf)
        line, row = np.nonzero((s >= np.maximum(least, self.bar)[:, None]) & (s > -np.inf))
        if not len(line):
            return
        line, score = np.concatenate((self.line, line)), np.concatenate((self.score, s[line, row]))
        doc = docs[row] if self.doc is None else np.concatenate((self.doc, docs[row]))
        order = np.lexsort((doc, -score, line))
        line = line[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        kept = order[place < self.k]
        self.bar[line[place == self.k - 1]] = score[order[place == self.k - 1]]
        self.line, self.doc, self.score = line[place < self.k], doc[kept], score[kept]


def all_rounded(s):
    """Products as scores."""
    import numpy as np

    return np.round(s, 6)


def shared_rounded(s):
    """Only products over 0."""
    import numpy as np

    return np.where(s > 0, np.round(s, 6), -np.inf)


def positive_rounded(s):
    """Only scores over 0."""
    import numpy as np

    s = np.round(s, 6)
    return np.where(s > 0, s, -np.inf)


def searched(rows: DataFrame, queries: DataFrame, k: int, size: int, matrix, parse, shown=all_rounded, weigh=None) -> DataFrame:
    """(query, doc, score, rank) of the k best rows for each query. ``shown`` makes scores of products, -inf for what is no hit.

    Queries are taken in blocks of ``size`` vectors (or, where ``weigh`` gives a query's weight, of that weight together, but one at least), each broadcast as one matrix (a stated bound) and scored by a matrix
    product per Arrow batch; a task hands on the k best it has seen for each query, and these partial lists are merged. No pair of
    a query and a row is laid out. Where there are several blocks, each one's result is written and its matrix dropped before the next.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    types = [queries.schema["doc"].dataType, rows.schema["doc"].dataType]
    kinds = [to_arrow_type(t) for t in types]
    schema = T.StructType([T.StructField("query", types[0]), T.StructField("doc", types[1]), T.StructField("score", T.DoubleType())])
    sc, done = rows.sparkSession.sparkContext, []
    blocks = _blocks(queries, size, weigh)
    block, following = next(blocks), next(blocks, None)
    while block is not None:
        shared = sc.broadcast(matrix(block))

        def run(batches, shared=shared):
            q_ids, q, *more = shared.value
            best = _Best(len(q_ids), k)
            step = max(1, min(ROWS, PRODUCT // max(1, len(q_ids)), CELLS // max(1, q.shape[-1])))
            for b in (b.slice(i, step) for b in batches if len(q_ids) for i in range(0, b.num_rows, step)):
                docs, m = parse(b, *more)
                if not len(docs):
                    continue
                best.add(shown(q @ m.T), docs)
            if len(best.line):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.line].tolist(), kinds[0]), pa.array(best.doc.tolist(), kinds[1]), pa.array(best.score)], names=["query", "doc", "score"])

        found = top_k(rows.mapInArrow(run, schema), k, F.desc("score"), F.asc("doc"))
        if following is None and not done:
            return found
        done.append(staged(found))
        shared.destroy()
        block, following = following, next(blocks, None)
    return functools.reduce(DataFrame.unionByName, done)
