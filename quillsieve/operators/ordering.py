"""Ranks, global row numbers and running totals that never need one task to hold a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

# Spark limits a ranked group before the shuffle only below the rank that this setting names.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64
_IN_PARTITION = (1 << 33) - 1


def top_n(
    df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows, or the first ``n`` of each group, with their rank.

    Each task keeps at most ``n`` rows of a group before anything is shuffled, so a group that holds
    a large share of the table does not meet in one task.
    """
    if n <= 0:
        return df.withColumn(rank, F.lit(0)).where(F.lit(False))
    if not keys:
        head = df.orderBy(*order).limit(n)
        return head.withColumn(rank, F.row_number().over(W.orderBy(*order)))
    ranked = df
    if n >= int(df.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        inner = W.partitionBy(*keys, "_salt").orderBy(*order)
        ranked = (
            salted.withColumn("_inner", F.row_number().over(inner))
            .where(F.col("_inner") <= n)
            .drop("_inner", "_salt")
        )
    outer = W.partitionBy(*keys).orderBy(*order)
    return ranked.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted and pinned rows that know their partition and place in it."""
    spread = [F.col(key) for key in keys] + list(order)
    placed = (
        df.repartitionByRange(*spread)
        .sortWithinPartitions(*spread)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    return pin(placed).withColumn("__part", F.shiftright("__place", 33))


def global_index(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "idx", start: int = 0
) -> DataFrame:
    """Consecutive row numbers over the whole table, or within each group, from a range sort.

    Only one row per partition and group is summed up to place the partitions after each other. The
    order must be total (end it with the row id).
    """
    ranged = _ranged(df, keys, order)
    parts = ranged.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("__place").alias("__first")
    )
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("__before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = join_checked(ranged, offsets, [*keys, "__part"])
    return joined.withColumn(
        name, (F.col("__before") + F.col("__place") - F.col("__first") + start).cast("bigint")
    ).drop("__before", "__first", "__place", "__part")


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    values: Sequence[str],
    keys: Sequence[str] = (),
    prefix: str = "cum_",
    ahead: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` in order, over the whole table or within each group.

    With ``ahead``, the column ``next_<ahead>`` holds that column's value in the following row.
    """
    ranged = _ranged(df, keys, order)
    local = W.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.sum(v).alias(f"_sum_{v}") for v in values]
    heads = [F.min_by(ahead, "__place").alias("_head")] if ahead else []
    parts = ranged.groupBy(*keys, "__part").agg(*sums, *heads)
    in_order = W.partitionBy(*keys).orderBy("__part")
    offsets = parts.select(
        *keys,
        "__part",
        *[F.lead("_head").over(in_order).alias("_next_head") for _ in heads],
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
    )
    followed = W.partitionBy(*keys, "__part").orderBy("__place")
    summed = ranged.select(
        "*",
        *[F.sum(v).over(local).alias(f"_local_{v}") for v in values],
        *[F.lead(ahead).over(followed).alias("_next") for _ in heads],
    )
    joined = join_checked(summed, offsets, [*keys, "__part"])
    for v in values:
        joined = joined.withColumn(f"{prefix}{v}", F.col(f"_local_{v}") + F.col(f"_before_{v}"))
    following = [F.coalesce("_next", "_next_head").alias(f"next_{ahead}") for _ in heads]
    return joined.select(*df.columns, *[f"{prefix}{v}" for v in values], *following)


def group_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Exact interpolated percentile per group, from running counts of its distinct values.

    No task holds a group: values are counted first and the counts summed by range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    summed = pin(running_totals(counts, [F.col(value)], ["n"], keys))
    totals = summed.groupBy(*keys).agg(((F.max("cum_n") - 1) * F.lit(share)).alias("at"))
    placed = join_checked(summed, totals, keys)

    def holds(place: Column) -> Column:
        return (F.col("cum_n") > place) & (F.col("cum_n") - F.col("n") <= place)

    low, high = F.floor("at"), F.ceil("at")
    ends = placed.groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col(value))).alias("lo"),
        F.max(F.when(holds(high), F.col(value))).alias("hi"),
        F.max(F.col("at") - low).alias("part"),
    )
    return ends.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(name))
