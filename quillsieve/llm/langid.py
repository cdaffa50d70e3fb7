"""Language ID with word-first backoff.

A word that the model knows votes with its log frequency in each language. A word that it does not know falls back to
character n-grams: the longest order of which any n-gram of the word is known votes, shorter ones are not asked. A
text's score is the posterior of the best language, given every word of the text.

The model is counted from a bounded sample of labelled texts (``FIT_DOCS`` per language; the sample's texts are used
whole) and keeps the ``MODEL_WORDS`` most frequent words and the ``MODEL_GRAMS`` most frequent n-grams of each order, so its
size is bounded whatever the corpus. Scoring covers every text of the table.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm.arrow import give_back, slices
from quillsieve.session import pin

#: Labelled texts of a language that the model is counted from (expected number; every text if there are fewer).
FIT_DOCS = 4_000
#: Words and, for each order, n-grams that the model keeps; at least MIN_COUNT occurrences each.
MODEL_WORDS = 50_000
MODEL_GRAMS = 20_000
MIN_COUNT = 3
ORDERS = (5, 4, 3, 2, 1)
#: A word of a lower order votes with less weight.
BACKOFF = 0.4
#: Counts that a task holds before it passes them on.
HELD = 500_000
#: Unknown words whose votes a task remembers.
MEMO_WORDS = 100_000
NO_LANGUAGE = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out(id_col: str):
    """Rows that are kept from learning: those whose id's checksum divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)] if order > 1 else list(word)


def fit_sample(labelled: DataFrame, lang_col: str, id_col: str, fit_docs: int) -> DataFrame:
    """About ``fit_docs`` rows of each language, chosen by a hash of their id; all rows of smaller languages."""
    sizes = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(fit_docs)) / F.col("_n") * float(1 << 32)
    drawn = F.crc32(F.concat(F.lit("fit:"), F.col(id_col).cast("string")).cast("binary"))
    return labelled.join(F.broadcast(sizes), lang_col).where(drawn <= share).drop("_n")


def count_features(sample: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``kind, item, lang, n``: words (kind 0) and n-grams (kind = order, once per word occurrence) by language.

    Tasks add up what they read before the shuffle and pass their counts on when they hold many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                counts: Counter = Counter()
                for word, n in words.items():
                    counts[0, word] += n
                    for order in ORDERS:
                        for gram in grams_of(word, order):
                            counts[order, gram] += n
                items = list(counts.items())
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([k for (k, _), _ in items], pa.int32()),
                        "item": pa.array([w for (_, w), _ in items], pa.string()),
                        "lang": pa.array([lang] * len(items), pa.string()),
                        "n": pa.array([n for _, n in items], pa.int64()),
                    }
                )
            held.clear()

        for batch in batches:
            for part, texts in slices(batch):
                for text, lang in zip(texts, part.column(0).to_pylist(), strict=True):
                    held[lang].update(words_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield from flush()
        yield from flush()

    counted = sample.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        run, "kind int, item string, lang string, n bigint"
    )
    return counted.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))


class Backoff:
    """The model: log frequencies per language of words (kind 0) and of n-grams (kind = order)."""

    def __init__(self, langs: list[str], known: dict[int, dict[str, tuple[float, ...]]]):
        self.langs, self.known = langs, known

    @classmethod
    def of_counts(
        cls, rows: list[tuple[int, str, str, int]], totals: dict[tuple[int, str], int], langs: list[str]
    ) -> Backoff:
        at = {lang: i for i, lang in enumerate(langs)}
        known: dict[int, dict[str, tuple[float, ...]]] = {}
        by_kind: dict[int, dict[str, list[int]]] = defaultdict(dict)
        for kind, item, lang, n in rows:
            by_kind[kind].setdefault(item, [0] * len(langs))[at[lang]] = n
        for kind, items in by_kind.items():
            floor = [math.log(totals.get((kind, lang), 0) + 1.0) for lang in langs]
            known[kind] = {
                item: tuple(math.log(n + 0.05) - z for n, z in zip(counts, floor, strict=True))
                for item, counts in items.items()
            }
        return cls(langs, known)

    def unseen(self, word: str) -> tuple[float, ...] | None:
        """Votes of a word that is not known: the mean of its n-grams of the longest known order, weighed down."""
        weight = 1.0
        for order in ORDERS:
            weight *= BACKOFF
            table = self.known.get(order, {})
            found = [v for v in map(table.get, grams_of(word, order)) if v is not None]
            if found:
                return tuple(weight * sum(column) / len(found) for column in zip(*found, strict=True))
        return None

    def scorer(self) -> Callable[[str], tuple[str, float]]:
        words, memo = self.known.get(0, {}), {}
        langs, unseen = self.langs, self.unseen
        nothing = (0.0,) * len(langs)

        def score(text: str) -> tuple[str, float]:
            counts = Counter(words_of(text))
            if not counts or not langs:
                return NO_LANGUAGE, 0.0
            total = list(nothing)
            for word, n in counts.items():
                votes = words.get(word)
                if votes is None:
                    votes = memo.get(word)
                    if votes is None:
                        votes = unseen(word) or nothing
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[word] = votes
                for i, v in enumerate(votes):
                    total[i] += n * v
            best = max(range(len(langs)), key=lambda i: (total[i], -i))
            return langs[best], 1.0 / sum(math.exp(max(-700.0, t - total[best])) for t in total)

        return score


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int = FIT_DOCS) -> Backoff:
    """The model of ``labelled`` rows (null languages are not learned from)."""
    labelled = labelled.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    counts = pin(count_features(fit_sample(labelled, lang_col, id_col, fit_docs), text_col, lang_col))
    langs = sorted(r[0] for r in labelled.select(F.col(lang_col).cast("string")).distinct().collect())
    per_item = counts.groupBy("kind", "item").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by_lang")
    )
    totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    rows = []
    per_item = pin(per_item.where(F.col("all") >= MIN_COUNT))
    for kind in (0, *ORDERS):
        most = MODEL_GRAMS if kind else MODEL_WORDS
        for r in per_item.where(F.col("kind") == kind).orderBy(F.col("all").desc(), "item").limit(most).collect():
            rows.extend((kind, r.item, one.lang, one.n) for one in r.by_lang)
    return Backoff.of_counts(rows, totals, langs)


def language_column(spark: SparkSession, model: Backoff, text: Column) -> Column:
    """``lang_pred`` and ``score`` of a text as one column; ``und`` with score 0 if it is null or has no letter."""
    # plain values only: a broadcast class would have to be installed on the executors
    shared = spark.sparkContext.broadcast((model.langs, model.known))

    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Backoff(*shared.value).scorer()
        for texts in batches:
            yield pd.DataFrame([score(t if isinstance(t, str) else "") for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(detect, "lang_pred string, score double")(text)


def in_known_language(docs: DataFrame, model: Backoff, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text is in one of the model's languages with a score of ``least`` or more, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.known))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Backoff(*shared.value).scorer()
        for batch in batches:
            for part, texts in slices(batch, at):
                found = [score(t) for t in texts]
                yield part.filter(pa.array([lang != NO_LANGUAGE and value >= least for lang, value in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang_pred, score`` of every row, by a model of the rows that are not held out.

    ``lang_pred`` is a language that occurs among those rows, or ``und`` if the text is null or empty, has no letter,
    or nothing was there to learn from; the score is the posterior from 0 to 1. Equal scores go to the language that
    comes first. Rows that repeat give rows that repeat; a null id is scored but never learned from. An empty table
    gives an empty one. Other columns are not read.
    """
    model = fit(df.where(~held_out(id_col)), id_col, text_col, lang_col)
    found = language_column(df.sparkSession, model, F.col(text_col))
    return df.select(id_col, found.alias("_found")).select(id_col, "_found.lang_pred", "_found.score")
