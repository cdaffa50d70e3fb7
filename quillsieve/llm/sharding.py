"""Rows to shards by a hierarchical weighted hash tree.

Shards sit in racks and racks in regions. A row descends the tree: at each level every child draws
``-ln(u) / weight`` from a hash of the row's key and the child's number, and the smallest draw wins, so a child is
chosen in proportion to its weight. A child's draw depends on the key, its own number and its own weight alone:
when weights change, rows move only into or out of the subtrees whose weights changed.

Regions are filled one after the other. When the present ones are full, the next shard opens a region of its own,
and then the only rows that move are those it takes over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.ordering import global_index

RACK_SHARDS = 4
REGION_RACKS = 2
#: Bytes that every row costs besides its text.
ROW_BYTES = 16
_UNIT = 1 << 53


def _uniform(key: Column, level: str, child: Column) -> Column:
    """A number in (0, 1) from the key, the level and the child's number."""
    drawn = F.xxhash64(F.concat_ws(":", F.lit(level), child.cast("string"), key))
    return (F.pmod(drawn, F.lit(_UNIT)).cast("double") + 0.5) / float(_UNIT)


def _descend(key: Column, level: str, first: Column, last: Column, weights: Sequence[float]) -> Column:
    """The child from ``first`` to ``last`` with the smallest weighted draw; children of no weight take nothing."""
    weight = F.array(*[F.lit(float(w)) for w in weights])
    draws = F.transform(
        F.filter(F.sequence(first, last), lambda c: F.element_at(weight, c + 1) > 0),
        lambda c: F.struct((-F.ln(_uniform(key, level, c)) / F.element_at(weight, c + 1)).alias("draw"), c.alias("c")),
    )
    return F.array_min(draws)["c"]


def _sums(weights: Sequence[float], size: int) -> list[float]:
    return [float(sum(weights[i : i + size])) for i in range(0, len(weights), size)]


def tree_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key among ``len(weights)`` shards; at least one weight must be above zero."""
    if not any(w > 0 for w in weights):
        raise ValueError("a tree needs a shard of positive weight")
    shards, racks = len(weights), _sums(weights, RACK_SHARDS)
    regions = _sums(racks, REGION_RACKS)
    region = _descend(key, "region", F.lit(0), F.lit(len(regions) - 1), regions)
    last_rack = F.least(region * REGION_RACKS + (REGION_RACKS - 1), F.lit(len(racks) - 1))
    rack = _descend(key, "rack", region * REGION_RACKS, last_rack, racks)
    last_shard = F.least(rack * RACK_SHARDS + (RACK_SHARDS - 1), F.lit(shards - 1))
    return _descend(key, "shard", rack * RACK_SHARDS, last_shard, weights).cast("int")


def assign_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Shard, slot and the shard after growth of every row, by the law ``key``.

    The id and the shard weights alone decide. ``slot`` numbers the rows of a shard without gaps from 0 in order of
    id, then checksum and size; it comes from a range sort of (shard, id), so no task holds a shard. ``grown_shard``
    is the shard when one more of weight 1 is added. With whole regions (``shards`` divisible by eight) the added
    shard opens a region, and rows move only into it.

    A null id counts as one key of its own; a null text has no bytes and the checksum 0. Rows that repeat get slots
    of their own. An empty table gives an empty one. Other columns are not read.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, weights).alias("shard"),
        tree_shard(key, [*weights, 1.0]).alias("grown_shard"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = global_index(rows, order, ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
