"""Semi-joins by a bitmap of bounded size, applied while scanning.

The bitmap has about SLOTS_EACH slots for every key, MOST_SLOTS at most, and is broadcast
as words of 64 slots: 2**20 rows of 16 bytes at most. Rows whose slot is empty go before
they are shuffled; that some rows pass by chance costs work only, as an exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_EACH = 16
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 26


def maybe_among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column may be among the keys: all that are, and few others. Nulls go."""
    return marked_among(df.where(F.col(column).isNotNull()), column, keys, key, "__maybe").where("__maybe").drop("__maybe")


def marked_among(df: DataFrame, column: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df with a column that says whether a row's column may be among the keys; false for nulls."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_EACH * keys.count()).bit_length()))

    def placed(of: str) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(F.col(of)), F.lit(slots))
        return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))

    word, bit = placed(key)
    words = keys.where(F.col(key).isNotNull()).groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    word, bit = placed(column)
    tried = df.join(F.broadcast(words), (word == F.col("__word")) & F.col(column).isNotNull(), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return tried.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name))
