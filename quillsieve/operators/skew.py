"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.session import pin

# A key is hot if it owns at least one in HOT_SHARE of all rows: there can be no more than HOT_SHARE such keys.
HOT_SHARE = 10_000
# Words that at least one in this many occurrences has are broadcast, at most so many.
WORD_SHARE = 200_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 32


def stored_bytes(pinned: DataFrame) -> int:
    """Bytes of the columns of a pinned table, as Spark knows them from its files."""
    return int(pinned._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    pinned: bool = False,
) -> DataFrame:
    """Join with a side that is expected to be small: broadcast if its measured rows and bytes allow it.

    A larger side is repeated once per salt and joined on key and salt, which splits a hot key of ``big``
    over many tasks. A small side that is a written table already (``pinned``) is not written again.
    """
    on = list(on)
    small = small if pinned else pin(small)
    if stored_bytes(small) <= BROADCAST_BYTES and small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = small.withColumn("_salt", salts)
    # any salt will do, as the small side has every one; equal rows get different ones
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def join_counts(
    rows: DataFrame, counts: DataFrame, on: Sequence[str], n: str = "n", share: int = HOT_SHARE
) -> DataFrame:
    """Inner join of ``rows`` with a table that counts them by key.

    The few hot keys are broadcast (their number is bounded by ``share``), so their rows are not
    shuffled; every other key is too small to weigh down a task. ``counts`` should be pinned, since it is
    read more than once, and each key must have at most ``n`` rows in ``rows``.
    """
    on = list(on)
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.where(F.col(n) * share >= total)
    cold = counts.where(F.col(n) * share < total)
    from_hot = rows.join(F.broadcast(hot), on)
    from_cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return from_hot.unionByName(from_cold)
