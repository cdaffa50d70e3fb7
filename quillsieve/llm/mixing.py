"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source asks for its weight's share of the budget. A source that would need more than ``max_epochs`` passes over
its words is clamped there, and what it cannot take is shared again among the others by weight, until none is above.
A source's rate is its target over its size: each document is taken ``floor(rate)`` times whole, and the fraction
that is left takes further documents in a seeded random order until the target is reached. The document at which it
is reached gives only the words still wanted.

All of it is DataFrame operations: sizes are counted in the scan, sources are one small table, and the running sizes
come from a range sort over (source, draw), so a source that owns a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.ordering import global_index, running_totals
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

#: What parts words: space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_size(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, budget_halves: int, max_epochs: int) -> DataFrame:
    """``target`` per row of ``sources`` (``weight``, ``source_size`` as integers) for a budget in half words.

    Rounds of clamping: each one asks what the unclamped sources would get and clamps those above their cap. Every
    round but the last clamps a source, so it ends; three sums are all that reaches the driver. The sums are
    integers, so the targets do not depend on the order of the rows.
    """
    cap = F.col("source_size") * max_epochs
    left, weight = budget_halves, sources.agg(F.sum("weight")).first()[0] or 0
    clamped = F.lit(False)
    while weight:
        # above its cap: weight / all weights * left / 2 > cap, in whole numbers of 38 digits
        wide = "decimal(38,0)"
        clamped = F.col("weight").cast(wide) * F.lit(left) > cap.cast(wide) * F.lit(2 * weight)
        held = sources.where(clamped).agg(F.sum(cap), F.sum("weight")).first()
        free = sources.agg(F.sum("weight")).first()[0] - (held[1] or 0)
        after = budget_halves - 2 * (held[0] or 0)
        if (after, free) == (left, weight):
            break
        left, weight = after, free
    level = F.lit(left / 2 / weight) if weight else F.lit(0.0)
    return sources.withColumn(
        "target", F.when(clamped if weight else F.lit(True), cap.cast("double")).otherwise(F.col("weight") * level)
    )


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share_percent: int = 150,
    max_epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it.

    Sources are weighed ``weights`` in code point order, null last, repeating; together they are to have
    ``share_percent`` of all words. ``whole`` is how often the document is taken whole and ``part`` how many words
    are taken of it besides (fewer than its size; above zero for at most one document of a source), so
    ``taken = whole * size + part``. Each source's taken words are its target rounded to a whole number.

    A null text has size 0, a null source is a source of its own, a null id is drawn like any other. Documents of
    size 0 are never taken. Rows that repeat are documents of their own (their order among themselves does not
    change any result). An empty table gives an empty one. Other columns are not read.
    """
    source = F.col(source_col)
    rows = pin(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(source, F.lit("")).alias("_source"),
            source.isNull().alias("_none"),
            word_size(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_draw"),
        )
    )
    key = ["_none", "_source"]
    sizes = pin(rows.groupBy(*key).agg(F.sum("size").alias("source_size")))
    ranked = global_index(sizes, [F.col(k) for k in key], name="_place")
    repeating = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    weight = F.element_at(repeating, (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = pin(ranked.select(*key, "source_size", weight.alias("weight")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(weighed, total * share_percent * 2 // 100, max_epochs).select(
        *key, "source_size", "target", F.round("target").cast("bigint").alias("_want")
    )
    order = [F.col("_draw"), F.col("doc_id"), F.col("size"), F.col("text_key")]
    summed = running_totals(rows, order, ["size"], key, "_upto_")
    has_words = F.col("source_size") > 0
    times = F.when(has_words, F.expr("_want div source_size")).otherwise(F.lit(0).cast("bigint"))
    before = F.col("_upto_size") - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("_want - _times * source_size") - before))
    again = (F.col("_extra") == F.col("size")) & (F.col("size") > 0)
    return (
        join_checked(summed, targets, key)
        .withColumn("_times", times)
        .withColumn("_extra", extra)
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.expr("_times * size + _extra").alias("taken"),
            (F.col("_times") + again.cast("bigint")).alias("whole"),
            F.when(again, F.lit(0)).otherwise(F.col("_extra")).cast("bigint").alias("part"),
            "text_key",
        )
    )
