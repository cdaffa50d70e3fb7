"""Add-one bigram language model over the corpus, as joins of counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.selection import DIGITS
from quillsieve.operators.skew import BROADCAST_ROWS, HOT_SHARE, join_counts
from quillsieve.session import pin


# Words with fewer than one in this many occurrences are joined by a shuffle; the others, at most so many, are broadcast.
WORD_SHARE = 200_000
COUNTED_ROWS = 4_000_000  # bigrams that a task is meant to count at once


@dataclass
class BigramModel:
    """A training corpus: its bigrams (``pair_counts``), how often words stand (``n``) and are followed (``n_a``), distinct words."""

    pairs: DataFrame
    starts: DataFrame
    vocabulary: int


def pair_counts(rows: DataFrame, keys: Sequence[str] = ("doc_id",), words: str = "words", pinned: bool = False) -> DataFrame:
    """``keys, a, b, c``: each row's bigrams in order, ``c`` is 1; its last word has a null neighbour.

    The texts are read once and kept as arrays of 64-bit hashes of their words, from which the model and the scores of the
    same rows are made. Hashes that are given as ``words`` are taken as they are, and not written again if they are a written table
    (``pinned``).
    """
    hashed = F.col(words)
    if not rows.schema[words].dataType.simpleString() == "array<bigint>":
        hashed = F.transform(hashed, lambda w: F.xxhash64(w))
    kept = rows.select(*keys, hashed.alias("words"))
    kept = kept if pinned else pin(kept)
    shifted = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    flat = kept.select(*keys, F.explode(F.arrays_zip(F.col("words").alias("a"), shifted.alias("b"))).alias("p"))
    return flat.select(*keys, "p.a", "p.b", F.lit(1).cast("bigint").alias("c"))


def train(pairs: DataFrame) -> BigramModel:
    """The model of the rows whose ``pair_counts`` are given."""
    followed = F.when(F.col("b").isNotNull(), F.col("c")).otherwise(0)
    starts = pin(pairs.groupBy("a").agg(F.sum("c").alias("n"), F.sum(followed).alias("n_a")))
    return BigramModel(pairs, starts, starts.count())


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.where("b is not null").groupBy("a", "b").agg(F.sum("c").alias("n_ab"))


def pair_nll(pairs: DataFrame, model: BigramModel) -> DataFrame:
    """``a, b, n, nll`` of the distinct bigrams of ``pairs``; ``n`` is how many rows of ``pairs`` have it.

    A bigram that the model has not seen counts as seen zero times, and so does its first word. Only these bigrams are
    counted in the model's corpus if they are few enough to be broadcast.
    """
    own = pin(pairs.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    trained = model.pairs
    if own.count() <= BROADCAST_ROWS:
        trained = trained.join(F.broadcast(own.select("a", "b")), ["a", "b"], "left_semi")
    firsts = own.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(model.starts.select("a", "n_a"), "a", "left")
    known = own.join(_counted(trained), ["a", "b"], "left")
    with_starts = join_counts(known, pin(firsts.select("a", F.col("n").alias("m"), "n_a")), ["a"], n="m")
    seen, after = F.coalesce("n_ab", F.lit(0)) + 1, F.coalesce("n_a", F.lit(0)) + F.lit(model.vocabulary)
    return pin(with_starts.select("a", "b", "n", (-F.log(F.try_divide(seen, after))).alias("nll")))


def _own_nll(model: BigramModel, keys: Sequence[str]) -> DataFrame:
    """``mean_nll`` of the model's own rows.

    A row's sum falls into logarithms of counts of its bigrams and of counts of their first words. Each bigram is shuffled
    once, by its words, and counted where it arrives; frequent ones, and frequent words, are looked up in a broadcast.
    """
    pairs = model.pairs.where("b is not null")
    total = model.starts.agg(F.sum("n")).first()[0] or 0
    # a bigram is as frequent as its words at most; no more than HOT_SHARE are left
    often = model.starts.where(F.col("n") * HOT_SHARE >= total)
    both = pairs.join(F.broadcast(often.select("a")), "a", "left_semi")
    both = both.join(F.broadcast(often.select(F.col("a").alias("b"))), "b", "left_semi")
    hot = pin(_counted(both).where(F.col("n_ab") * HOT_SHARE >= total))
    frequent = model.starts.where(F.col("n") * WORD_SHARE >= total)
    rare = model.starts.where(F.col("n") * WORD_SHARE < total)
    seen, after = F.log(F.col("n_ab") + 1), F.log(F.col("n_a") + F.lit(model.vocabulary))

    def part(rows: DataFrame, value: Column, count: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(F.col("c") * value).alias("s"), F.sum(count).alias("n"))

    near = pairs.join(F.broadcast(hot), ["a", "b"], "left").join(F.broadcast(frequent.select("a", "n_a")), "a", "left")
    zero = F.lit(0.0)
    known = part(near, F.coalesce(after, zero) - F.coalesce(seen, zero), F.col("c"))
    others = pairs.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
    schema = ", ".join(f"{name} {kind}" for name, kind in pairs.select(*keys).dtypes) + ", s double, n bigint"
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNTED_ROWS))
    others = others.select(*keys, "a", "b", "c").repartition(parts, "a", "b")
    cold = pairs.join(F.broadcast(frequent.select("a")), "a", "left_anti").join(rare.select("a", "n_a"), "a")
    none = F.lit(0).cast("bigint")
    met = others.mapInArrow(lambda batches: _seen_where_met(batches, list(keys)), schema)
    whole = known.unionByName(met).unionByName(part(cold, after, none))
    return whole.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("nll"), F.sum("n").alias("n"))


def _seen_where_met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """``keys, s, n``: for each row less the logarithms of one more than the counts of its bigrams, all of which are in this task.

    None of the bigrams is frequent, so a task holds about as many as it is meant to.
    """
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    part = pa.Table.from_batches(held)
    del held
    a, b, c = (part.column(name).to_numpy() for name in ("a", "b", "c"))
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    seen = np.empty(len(a))
    seen[order] = -c * np.log(np.add.reduceat(c, first) + 1.0)[np.cumsum(new) - 1]
    summed = part.select(keys).append_column("s", pa.array(seen)).group_by(keys).aggregate([("s", "sum")])
    out = summed.rename_columns([{"s_sum": "s"}.get(name, name) for name in summed.column_names])
    yield from out.select([*keys, "s"]).append_column("n", pa.array(np.zeros(len(out), dtype=np.int64))).combine_chunks().to_batches()


def mean_nll(pairs: DataFrame, model: BigramModel, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mean negative log likelihood of each row's bigrams, seen or not; rows without bigrams have none."""
    if pairs is model.pairs:
        return _own_nll(model, keys)
    scored = join_counts(pairs.where("b is not null"), pair_nll(pairs, model), ["a", "b"])
    weighted = F.sum(F.col("c") * F.col("nll")) / F.sum("c")
    return scored.groupBy(*keys).agg(weighted.alias("nll"), F.sum("c").alias("n"))


def ngram_perplexity(pairs: DataFrame, model: BigramModel, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return mean_nll(pairs, model, keys).select(*keys, F.round(F.exp("nll"), DIGITS - 3).alias("score"))


def corpus_perplexity(pairs: DataFrame, model: BigramModel, key: str = "window") -> DataFrame:
    """Perplexity of windows: from the plain mean and from the mean weighted by tokens."""
    scored = mean_nll(pairs, model, (key,)).where(~F.isnan("nll"))
    return scored.agg(
        F.exp(F.avg("nll")).alias("perplexity"),
        F.exp(F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("weighted_perplexity"),
        F.count(F.lit(1)).alias("windows"),
    )
