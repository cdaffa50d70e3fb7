"""Selections by name, with pluggable words, vectors and scores."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import generation as gen
from quillsieve.operators import counts, greedy, overlap, perplexity, set_bounds
from quillsieve.operators import selection as sel
from quillsieve.operators.ordering import global_index
from quillsieve.session import pin

ALIASES = {"most_similar": "prototype", "most_dissimilar": "most_different", "random": "random_sample"}
BY_HERDING = ("herding", "distribution_matching", "distribution_matching_no_outliers")
GENERATED = ("random_words", "words_dataset", "dictionary")
HASH_DIMENSIONS = 256

Strategy = Callable[["Request"], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


@dataclass
class Request:
    """What a strategy is given: the documents, the budget per dataset and overall, and the hooks.

    ``shared`` keeps what several strategies of the same corpus have in common.
    """

    docs: DataFrame
    per_dataset: int
    n: int
    words: Column
    vectors: DataFrame
    scorer: Callable[[DataFrame], DataFrame] | None
    seed: int = 42
    shared: dict[Hashable, Any] = field(default_factory=dict)

    def common(self, key: Hashable, make: Callable[[], Any]) -> Any:
        return _common(self.shared, key, make)


def _common(shared: dict[Hashable, Any], key: Hashable, make: Callable[[], Any]) -> Any:
    if key not in shared:
        shared[key] = make()
    return shared[key]


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a strategy under a name; callers may add their own."""

    def register(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return register


def hashed_vectors(docs: DataFrame, words: Column | None = None, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """Hashed word frequencies as vectors, for corpora that come without any."""
    words = tx.zipf_words(F.col("text")) if words is None else words
    counted = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(
        docs.select("dataset", "doc_id", words.alias("_words"))
    )
    return counted.select("dataset", "doc_id", vector_to_array("_tf").alias("embedding"))


def lm_scorer(words: Column, pinned: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Scores by the perplexity of a bigram model of the same documents, or of a written table of their words' hashes."""

    def score(docs: DataFrame) -> DataFrame:
        key = ("dataset", "doc_id")
        pairs = perplexity.pair_counts(docs.select(*key, words.alias("words")), key, pinned=pinned)
        return perplexity.ngram_perplexity(pairs, perplexity.train(pairs), key)

    return score


def _ids(df: DataFrame) -> DataFrame:
    return df.select("dataset", "doc_id", "rank")


def _hashes(r: Request) -> DataFrame:
    """The hashes of each row's words in order, as ``words``: texts are split once for all strategies that only compare words."""
    hashes = F.transform(r.words, lambda w: F.xxhash64(w))
    return r.common("hashes", lambda: pin(r.docs.select("dataset", "doc_id", hashes.alias("words"))))


def _bags(r: Request) -> DataFrame:
    return r.common("bags", lambda: pin(counts.word_bags(_hashes(r), F.col("words"), ["dataset", "doc_id"], hashed=True)))


def _tokens(r: Request) -> DataFrame:
    """The words of every dataset with their counts."""
    return r.common("tokens", lambda: pin(counts.word_counts(counts.token_rows(r.docs, r.words, keep=("dataset",)), ["dataset"])))


def _similarity(r: Request) -> DataFrame:
    return r.common("similarity", lambda: pin(sel.mean_similarity(r.vectors).select("dataset", "doc_id", "score")))


@strategy("random_sample")
def _random(r: Request) -> DataFrame:
    return _ids(sel.select_random(r.docs, r.per_dataset, r.seed))


@strategy("prototype")
def _prototype(r: Request) -> DataFrame:
    return _ids(sel.select_most_similar(r.vectors, r.per_dataset, scored=_similarity(r)))


@strategy("most_different")
def _different(r: Request) -> DataFrame:
    return _ids(sel.select_most_different(r.vectors, r.per_dataset, scored=_similarity(r)))


@strategy("distribution_matching")
def _matching(r: Request) -> DataFrame:
    return _ids(sel.select_distribution_matching(r.vectors, r.per_dataset, scored=_similarity(r)))


@strategy("distribution_matching_no_outliers")
def _matching_trimmed(r: Request) -> DataFrame:
    return _ids(sel.select_distribution_matching(r.vectors, r.per_dataset, trim=0.05, scored=_similarity(r)))


@strategy("herding")
def _herding(r: Request) -> DataFrame:
    return _ids(greedy.select_herding(r.vectors, r.per_dataset))


@strategy("decoupled")
def _decoupled(r: Request) -> DataFrame:
    rows = _similarity(r).join(r.docs.select("dataset", "doc_id", "text"), ["dataset", "doc_id"])
    return _ids(greedy.select_decoupled(rows, r.per_dataset, words=r.words))


def _bounds(r: Request) -> set_bounds.Bounds:
    """Overlap bounds of both ends."""
    by = ["dataset"]
    return r.common("bounds", lambda: set_bounds.bound_overlap(overlap.token_sets(_hashes(r), F.col("words"), by, hashed=True), by))


@strategy("prototype_iou")
def _iou(r: Request) -> DataFrame:
    return _ids(set_bounds.refine(_bounds(r), r.per_dataset, False)[0])


@strategy("most_different_iou")
def _different_iou(r: Request) -> DataFrame:
    return _ids(set_bounds.refine(_bounds(r), r.per_dataset, True)[0])


# Vectors here are pooled already, so the pooled variants select as the plain ones do.
STRATEGIES["prototype_st"] = _prototype
STRATEGIES["most_different_st"] = _different


@strategy("least_perplexity")
def _least_perplexity(r: Request) -> DataFrame:
    score = r.scorer or (lambda _: lm_scorer(F.col("words"), pinned=True)(_hashes(r)))
    return _ids(sel.select_by_score(score(r.docs), r.per_dataset, True, ["dataset"]))


@strategy("zipf")
def _zipf(r: Request) -> DataFrame:
    return _ids(sel.select_zipf(r.docs, r.per_dataset, r.words, _bags(r)))


STRATEGIES["shuffled_zipf"] = _zipf


@strategy("unique_tokens")
def _unique(r: Request) -> DataFrame:
    return _ids(greedy.select_unique_tokens(_hashes(r), r.per_dataset, F.col("words"), hashed=True))


STRATEGIES["unique_tokens_shuffled"] = _unique


@strategy("tail_then_match")
def _tail(r: Request) -> DataFrame:
    return _ids(greedy.select_tail_then_match(r.docs, r.per_dataset, r.words, bags=_bags(r), tokens=_tokens(r)))


def _generated(r: Request, name: str) -> DataFrame:
    if name == "words_dataset":
        rows = gen.gen_bag_of_words(r.docs, r.n, seed=r.seed, words=r.words)
    else:
        words = r.common("list", lambda: pin(gen.word_list(r.docs, r.words, _tokens(r))))
        rows = gen.gen_dictionary(words) if name == "dictionary" else gen.gen_random_words(words, r.n, seed=r.seed)
    return rows.select(F.lit(name).alias("dataset"), F.col("row_id").alias("doc_id"), F.col("row_id").cast("int").alias("rank"), "text")


def _surrogates(docs: DataFrame) -> DataFrame:
    """``dataset, doc_id, _row``: consecutive numbers in the order of ids, then datasets."""
    named = docs.select("dataset", "doc_id").distinct()
    return pin(global_index(named, [F.col("doc_id"), F.col("dataset")], name="_row"))


def _with_surrogates(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` with row numbers as ids and datasets that are never null."""
    named = keys.select(F.col("dataset").alias("_dataset"), F.col("doc_id").alias("_doc_id"), "_row")
    same = F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = df.join(named, same)
    # no name is like that of rows without one
    known = F.when(F.col("dataset").isNull(), F.lit("none")).otherwise(F.concat(F.lit("in:"), F.col("dataset")))
    return joined.withColumns({"dataset": known, "doc_id": F.col("_row")}).select(*df.columns)


def prepare_selection(
    docs: DataFrame,
    name: str,
    n: int = 128,
    vectors: DataFrame | None = None,
    words: Column | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``n`` rows (``dataset, doc_id, rank, text``) of a corpus of one or more datasets by a named strategy.

    Each dataset has ids of its own: within the strategies a row's id is its place in the order of ids and datasets, so
    equal ids of different datasets stay apart and ties still go to the smaller id. Ids may be negative or of any size,
    and rows without a dataset or an id count as those of one more. Hooks are given and give back the ids of the corpus.

    With several datasets every dataset gives ``n`` rows and a coreset of their union is kept: by herding
    for the strategies that match distributions, by farthest points otherwise.
    """
    return prepare_selections(docs, [name], n, vectors, words, embedder, scorer, seed)[name]


def prepare_selections(
    docs: DataFrame,
    names: Sequence[str],
    n: int = 128,
    vectors: DataFrame | None = None,
    words: Column | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """``prepare_selection`` by several strategies of one corpus, by name. What they have in common is made once: row numbers,
    hashes, bags and counts of words, mean similarities, bounds of overlaps, and the picks of names that stand for one strategy."""
    shared: dict[Hashable, Any] = {}
    return {name: _prepared(docs, name, n, vectors, words, embedder, scorer, seed, shared) for name in names}


def _prepared(
    docs: DataFrame,
    name: str,
    n: int,
    vectors: DataFrame | None,
    words: Column | None,
    embedder: Callable[[DataFrame], DataFrame] | None,
    scorer: Callable[[DataFrame], DataFrame] | None,
    seed: int,
    shared: dict[Hashable, Any],
) -> DataFrame:
    kind = ALIASES.get(name, name)
    if kind == "concat":
        return docs.select("dataset", "doc_id", F.lit(None).cast("int").alias("rank"), "text")
    if kind not in STRATEGIES and kind not in GENERATED:
        raise ValueError(f"unknown strategy {name}; known: {', '.join(sorted({*STRATEGIES, *GENERATED, 'concat'}))}")
    # Generated rows are of plain words unless the caller names others.
    hooked = words
    words = tx.zipf_words(F.col("text")) if words is None else words
    seen = _common(shared, "seen", lambda: docs.select("dataset").distinct().limit(2).collect())
    several = len(seen) > 1
    corpus = docs
    numbered = several or any(r[0] is None for r in seen)
    keys = _common(shared, "keys", lambda: _surrogates(corpus)) if numbered else None

    def inner(df: DataFrame) -> DataFrame:
        return df if keys is None else _with_surrogates(df, keys)

    if vectors is None:
        vectors = (embedder or (lambda d: hashed_vectors(d, words)))(docs)
    vectors = inner(vectors)
    docs = inner(docs)
    if kind in GENERATED:
        bag = tx.plain_words(F.col("text")) if hooked is None and kind == "words_dataset" else words
        return _generated(Request(docs, n, n, bag, vectors, None, seed, shared), kind)
    # a hook is given the corpus as it is
    score = None if scorer is None else lambda _: inner(scorer(corpus))
    request = Request(docs, n, n, words, vectors, score, seed, shared)
    chosen = request.common(STRATEGIES[kind], lambda: pin(STRATEGIES[kind](request)))
    if several:
        pool = sel.join_checked(vectors.select("dataset", "doc_id", "embedding"), chosen.select("dataset", "doc_id"), ["dataset", "doc_id"])
        core = greedy.resample(pool, n, kind in BY_HERDING)
        chosen = core.select("doc_id", "rank")
    rows = sel.join_checked(docs.select("dataset", "doc_id", "text"), chosen.select("doc_id", "rank"), ["doc_id"])
    if kind in ("shuffled_zipf", "unique_tokens_shuffled"):
        shuffled = F.array_join(tx.shuffle_words(words, F.col("doc_id"), seed), " ")
        rows = rows.withColumn("text", shuffled)
    if keys is None:
        return rows.select("dataset", "doc_id", "rank", "text")
    picked = rows.select(F.col("doc_id").alias("_row"), "rank", "text")
    return sel.join_checked(keys, picked, ["_row"]).select("dataset", "doc_id", "rank", "text")
