"""Cut the concatenation of all documents into windows of a fixed number of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.ordering import running_totals
from quillsieve.session import pin


def pack_windows(
    docs: DataFrame, length: int, order: Sequence[str] = ("doc_id",), words: str = "words", most: int | None = None
) -> DataFrame:
    """Windows of exactly ``length`` words; the remainder is dropped unless it is all there is.

    Offsets are summed over document lengths only; each document is cut into one slice per window that it
    touches before the slices are dealt out, so no task sees more than one window and a long document is
    read once. With ``most``, documents behind the first ``most`` windows are left out before the texts move.
    """
    sized = docs.select(*order, words, F.size(words).cast("bigint").alias("len")).where("len > 0")
    lengths = pin(sized.select(*order, "len"))
    placed = running_totals(lengths, [F.col(c) for c in order], ["len"])
    total = lengths.agg(F.sum("len")).first()[0] or 0
    starts = placed.withColumn("off", F.col("cum_len") - F.col("len")).drop("cum_len", "len")
    whole = total // length if most is None else min(total // length, most)
    if most is not None:
        starts = starts.where(F.col("off") < most * length)
    off, size = F.col("off"), F.size(words).cast("bigint")

    def cut(window: Column) -> Column:
        begin = F.greatest(window * length - off, F.lit(0))
        end = F.least((window + 1) * length - off, size)
        part = F.slice(words, (begin + 1).cast("int"), (end - begin).cast("int"))
        return F.struct(window.alias("window"), off.alias("off"), part.alias("part"))

    touched = F.sequence(F.expr(f"off div {length}"), F.expr(f"(off + len - 1) div {length}"))
    slices = F.transform(F.filter(touched, lambda w: w < max(whole, 1)), cut)
    kept = sized.join(starts, list(order)).select(F.explode(slices).alias("s")).select("s.*")
    pieces = F.sort_array(F.collect_list(F.struct("off", "part")))
    return kept.groupBy("window").agg(F.flatten(F.transform(pieces, lambda p: p["part"])).alias("words"))


def eval_windows(
    docs: DataFrame, length: int, max_windows: int | None = None, order: Sequence[str] = ("doc_id",), words: str = "words"
) -> DataFrame:
    """The full windows over the joined texts: all of them, or the first ``max_windows``."""
    return pack_windows(docs, length, order, words, max_windows).where(F.size("words") == length)
