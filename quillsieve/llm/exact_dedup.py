"""Exact duplicates by a heavy-hitter split.

Texts meet by their SHA-256. A Misra-Gries sketch over all digests names those that may be frequent; an exact count
verifies them. The verified ones are few (each holds at least one row in ``heavy_share``), so they are broadcast and
their rows are decided where they are read; of each only the row that stays goes on. All other digests are shuffled,
and no group of theirs is large. The text itself is never shuffled, and no step runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.session import pin

#: A digest is heavy if it holds at least one row in HEAVY_SHARE, so there are no more than HEAVY_SHARE heavy ones.
HEAVY_SHARE = 1000
#: Counters of the sketch. Its error is at most 3.5 / TRACKED of all rows, so each heavy digest is a candidate.
TRACKED = 1 << 14


def heavy_digests(rows: DataFrame, id_col: str, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """``digest, heavy_size, heavy_id`` of the digests that hold at least one in ``heavy_share`` of ``rows``.

    The sketch gives at most ``TRACKED`` candidates, named by a hash of the digest. Their rows are then counted
    exactly, each task adding up its own before the shuffle.
    """
    sketch = rows.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {TRACKED}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("_rows")
    )
    likely = pin(sketch.select("_rows", F.explode("top").alias("t")).select(F.col("t.item").alias("_name"), "_rows"))
    counted = (
        rows.withColumn("_name", F.xxhash64("digest"))
        .join(F.broadcast(likely), "_name")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("heavy_size"), F.max(id_col).alias("heavy_id"), F.first("_rows").alias("_rows"))
    )
    heavy = (F.col("heavy_size") > 1) & (F.col("heavy_size") * heavy_share >= F.col("_rows"))
    return pin(counted.where(heavy).select("digest", "heavy_size", "heavy_id"))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: int = HEAVY_SHARE
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text counts as the empty text; texts are compared as
    they are. A null id is below every other. If the largest id of a group occurs more than once, one of those rows
    stays. An empty table gives an empty one. Other columns are not read.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = pin(df.select(F.col(id_col).alias("doc_id"), digest.alias("digest")))
    marked = rows.join(F.broadcast(heavy_digests(rows, "doc_id", heavy_share)), "digest", "left")
    decided = F.col("heavy_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_id"))
    group = W.partitionBy("digest")
    place = F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last()))
    rest = marked.where(~decided).select(
        "doc_id",
        F.coalesce("heavy_id", F.max("doc_id").over(group)).alias("keep_id"),
        F.coalesce("heavy_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (place == 1).alias("kept"),
        "digest",
    )
    dropped = marked.where(decided).select(
        "doc_id",
        F.col("heavy_id").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        F.lit(False).alias("kept"),
        "digest",
    )
    return rest.unionByName(dropped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
