"""Rows whose key may be in a list: a bitmap of the list's hashes is brought to the rows, so that the others need not move.

The bitmap has 64 bits or more for each key of the list, ``MOST`` at most in all (4 MB); it errs on one side only: a row that it leaves out is not in the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.batches import column, free_name
from quillmere.llm.tables import staged

LEAST, MOST = 1 << 20, 1 << 25
#: Bytes of the pieces that rows are joined with.
PIECE = 64


def parted(rows: DataFrame, ids: DataFrame, key: str, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose ``key`` may be in ``ids`` (one column of that name, without nulls), and those whose key is not.

    A list too long for the bitmap (over a quarter as many keys as bits) gives all rows and None.
    """
    n = ids.count()
    if 4 * n > most:
        return rows, None
    size = min(most, max(LEAST, 1 << (64 * n).bit_length()))
    spot = F.pmod(F.xxhash64(column(key)), F.lit(size))
    piece, bits, hit = (free_name(x, rows.columns) for x in ("__piece", "__bits", "__hit"))
    blocks = ids.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    # a block has 4,096 bytes, too many to read for each row
    cut = blocks.select("block", "bits", F.explode(F.sequence(F.lit(0), F.lit(4096 // PIECE - 1))).alias("k"))
    part = F.substring("bits", F.col("k") * PIECE + 1, F.lit(PIECE))
    table = staged(cut.select(((F.col("block") - 1) * (4096 // PIECE) + F.col("k")).alias(piece), part.alias(bits)).where(F.bitmap_count(column(bits)) > 0))
    at = (spot % (8 * PIECE)).cast("int")
    byte = F.conv(F.hex(F.substring(column(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_in = F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    every = [column(c) for c in rows.columns]
    marked = rows.join(F.broadcast(table), F.floor(spot / (8 * PIECE)) == column(piece), "left").select(*every, is_in.alias(hit))
    return tuple(marked.where(column(hit) if keep else ~column(hit)).select(*every) for keep in (True, False))


def among(rows: DataFrame, ids: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """Rows whose key is in ``ids``, and few others; rows stay where they are unless the list is too long for the bitmap."""
    may_be, rest = parted(rows, ids, key, most)
    return rows.join(ids, key, "left_semi") if rest is None else may_be
