"""Generated rows: random words, bags of corpus words, and the word list itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import counts as ct
from quillsieve.operators.ordering import global_index
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

HEX_DIGITS = 12
LETTERS = 8  # of a word and its blank, when words are guessed


def word_list(docs: DataFrame, words: Column | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """The distinct words of the corpus in order, numbered from 0; of ``tokens``, if its words are known already."""
    words = (ct.token_rows(docs, words, keep=()) if tokens is None else tokens.select("token")).distinct()
    return global_index(words, [F.col("token")], name="idx")


def _rows_of(placed: DataFrame, length: int, pad: bool = False) -> DataFrame:
    """Deal (place, token) rows out into texts of ``length`` words."""
    row = F.floor(F.col("place") / length).alias("row_id")
    entries = F.sort_array(F.collect_list(F.struct("place", "token")))
    dealt = placed.groupBy(row).agg(F.transform(entries, lambda e: e["token"]).alias("words"))
    kept = dealt.withColumn("n_words", F.size("words"))
    if pad:
        kept = kept.withColumn(
            "words", F.concat("words", F.array_repeat(F.lit("<pad>"), F.lit(length) - F.col("n_words")))
        )
    return kept.select("row_id", F.array_join("words", " ").alias("text"), "n_words")


def gen_random_words(words: DataFrame, n: int, length: int = 128, seed: int = 42) -> DataFrame:
    """``n`` texts of words drawn evenly, with replacement, from a numbered word list."""
    pinned = pin(words)
    size = pinned.count()
    draws = words.sparkSession.range(n * length).select(
        F.col("id").alias("place"), tx.seeded_int(seed, size, F.col("id")).alias("idx")
    )
    return _rows_of(draws.join(pinned, "idx"), length)


def gen_bag_of_words(docs: DataFrame, n: int, length: int = 128, seed: int = 42, words: Column | None = None) -> DataFrame:
    """``n`` texts dealt from one global shuffle of all word occurrences, cycling if the pool is smaller.

    Only the ``n * length`` smallest random keys are needed. Keys are uniform, so nearly all other
    occurrences are dropped in the scan by a bound far above the expected cut; should the bound ever be too
    low, it is raised until the pool is whole. The cut is guessed from the lengths of the texts, which are split only once
    unless they have far fewer words; only a pool that is everything needs the exact number of words.
    """
    need = n * length
    if words is None or "text" in docs.columns:
        guess = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // LETTERS
    else:
        guess = docs.agg(F.sum(F.size(words))).first()[0] or 0
    words = tx.plain_words(F.col("text")) if words is None else words
    keyed = docs.select("doc_id", F.posexplode(words).alias("pos", "token")).withColumn(
        "_key", tx.seeded_key(seed, F.col("doc_id"), F.col("pos"))
    )
    share = (need + 10 * math.sqrt(need) + 100) / max(guess, 1)
    while True:
        bound = format(int(share * 16**HEX_DIGITS), f"0{HEX_DIGITS}x")
        kept = pin(keyed.where(F.col("_key") < bound) if share < 1 else keyed)
        total = kept.count()
        if share >= 1 or total >= need:
            break
        share *= 8
    if total == 0:
        return docs.sparkSession.createDataFrame([], "row_id bigint, text string, n_words int")
    pool = pin(global_index(kept, [F.col("_key"), F.col("doc_id"), F.col("pos")], name="place"))
    pool = pool.where(F.col("place") < need).select("place", "token")
    if total < need:
        cycles = F.sequence(F.lit(0), F.floor((F.lit(need - 1) - F.col("place")) / total))
        pool = pool.select("token", "place", F.explode(cycles).alias("_cycle")).select(
            "token", (F.col("place") + F.col("_cycle") * total).alias("place")
        )
    return _rows_of(pool, length)


def gen_dictionary(words: DataFrame, length: int = 128) -> DataFrame:
    """The whole numbered word list in order, cut into rows; the last row is padded."""
    return _rows_of(words.withColumnRenamed("idx", "place"), length, pad=True)


def attach_vectors(ids: DataFrame, vocab_vectors: DataFrame) -> DataFrame:
    """The vector of each token id at each position."""
    placed = ids.select("doc_id", F.posexplode("ids").alias("pos", "token_id"))
    return join_checked(placed, vocab_vectors, ["token_id"])
