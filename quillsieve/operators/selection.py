"""Row selection by seeded chance, by scores and by position. Ties always go to the smaller id."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.functions import vectors as vx
from quillsieve.operators import counts as ct
from quillsieve.operators.ordering import global_index, top_n
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

DIGITS = 9
LLOYD_STEPS = 20
LABELLED_ROWS = 4_000_000  # rows of growing sets that a task writes


def with_rows(chosen: DataFrame, docs: DataFrame, on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The full rows of a selection; only ids and scores were ranked."""
    extra = [c for c in docs.columns if c in on or c not in chosen.columns]
    return join_checked(docs.select(*extra), chosen, on)


def select_random(rows: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """``n`` rows per dataset (all if there are fewer), without replacement."""
    keyed = rows.select(*keys, "doc_id", tx.seeded_key(seed, F.col("doc_id")).alias("_key"))
    return top_n(keyed, [F.col("_key"), F.col("doc_id")], n, keys).drop("_key")


def select_all(*datasets: DataFrame) -> DataFrame:
    """Every row of every dataset."""
    whole = datasets[0]
    for more in datasets[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def select_by_score(
    scored: DataFrame, n: int, ascending: bool = False, keys: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """The ``n`` highest (or lowest) scores, overall or per dataset; rows without a score are left out."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ties = [F.col("doc_id"), *[F.col(c) for c in _dataset(scored) if c not in keys]]
    return top_n(scored.where(F.col(score).isNotNull()), [order, *ties], n, keys)


def _dataset(rows: DataFrame) -> list[str]:
    """The dataset column, if there is one: ids are unique within it only."""
    return [c for c in ("dataset",) if c in rows.columns]


def mean_similarity(rows: DataFrame, keys: Sequence[str] = ("dataset",), vector: str = "embedding") -> DataFrame:
    """Mean cosine of each row to its whole dataset, itself included.

    The mean of the dot products with all unit vectors is the dot product with their mean, so one
    aggregate and one small join replace the matrix of all pairs.
    """
    units = rows.withColumn("_unit", vx.l2_normalize(vx.as_doubles(F.col(vector))))
    centroids = units.groupBy(*keys).agg(vx.mean_vector(F.col("_unit")).alias("_centroid"))
    joined = join_checked(units, centroids, keys)
    return joined.withColumn("score", F.round(vx.dot(F.col("_unit"), F.col("_centroid")), DIGITS)).drop(
        "_unit", "_centroid"
    )


def select_most_similar(rows: DataFrame, n: int, keys: Sequence[str] = ("dataset",), scored: DataFrame | None = None) -> DataFrame:
    """The rows nearest to their dataset; ``scored`` is their ``mean_similarity``, if that is known already."""
    scored = mean_similarity(rows, keys) if scored is None else scored
    return select_by_score(scored.select(*keys, "doc_id", "score"), n, False, keys)


def select_most_different(rows: DataFrame, n: int, keys: Sequence[str] = ("dataset",), scored: DataFrame | None = None) -> DataFrame:
    scored = mean_similarity(rows, keys) if scored is None else scored
    return select_by_score(scored.select(*keys, "doc_id", "score"), n, True, keys)


def pick_quantiles(
    scored: DataFrame, n: int, trim: float = 0.0, keys: Sequence[str] = ("dataset",), score: str = "score"
) -> DataFrame:
    """``n`` evenly spaced places of each dataset's ascending score order, between the trimmed ends."""
    narrow = pin(scored.select(*keys, "doc_id", score))
    placed = pin(global_index(narrow, [F.col(score), F.col("doc_id")], keys, name="_place"))
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    if trim:
        low = F.floor(F.col("_size") * F.lit(trim))
        high = F.least(F.floor(F.col("_size") * F.lit(1.0 - trim)), F.col("_size") - 1)
    else:
        low, high = F.lit(0), F.col("_size") - 1
    steps = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    share = F.col("_i") / F.lit(float(max(n - 1, 1)))
    wanted = (
        sizes.withColumn("_low", low)
        .withColumn("_high", high)
        .select("*", F.explode(steps).alias("_i"))
        .select(
            *keys,
            (F.col("_i") + 1).alias("rank"),
            F.floor(F.round(F.col("_low") + share * (F.col("_high") - F.col("_low")), 6)).alias("_place"),
        )
    )
    return join_checked(placed, wanted, [*keys, "_place"]).drop("_place")


def select_distribution_matching(
    rows: DataFrame, n: int, trim: float = 0.0, keys: Sequence[str] = ("dataset",), scored: DataFrame | None = None
) -> DataFrame:
    """Rows whose mean similarities are spread like those of the dataset; ``scored`` has them, if they are known already."""
    return pick_quantiles(mean_similarity(rows, keys) if scored is None else scored, n, trim, keys)


def word_rarity(docs: DataFrame, words: Column | None = None, bags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bags of word hashes of the rows that have words, and ``token, n, rarity`` of every word's hash; both are written."""
    words = tx.zipf_words(F.col("text")) if words is None else words
    bags = pin(ct.word_bags(docs, words, [*_dataset(docs), "doc_id"])) if bags is None else bags
    return bags, pin(ct.rarity_scores(ct.bag_counts(bags)))


def rarity_of_bags(bags: DataFrame, counts: DataFrame) -> DataFrame:
    """``rarity_of_rows`` from what ``word_rarity`` gives."""
    summed = ct.sum_of_items(bags, counts, "rarity", [*_dataset(bags), "doc_id"], "score")
    return summed.withColumn("score", F.round("score", DIGITS))


def rarity_of_rows(docs: DataFrame, words: Column | None = None, bags: DataFrame | None = None) -> DataFrame:
    """Sum over the distinct words of each document of one over the word's corpus count.

    With a dataset column, equal ids of different datasets are different documents. Texts are split once and kept as bags of
    64-bit hashes of their words; frequent words are looked up where a bag is read. ``bags`` are a written table of them.
    """
    return rarity_of_bags(*word_rarity(docs, words, bags))


def select_zipf(docs: DataFrame, n: int, words: Column | None = None, bags: DataFrame | None = None) -> DataFrame:
    """The ``n`` documents of all datasets with the most, and the rarest, words."""
    return select_by_score(rarity_of_rows(docs, words, bags), n)


def select_shuffled_zipf(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rarity selection with the words of each chosen text in random order."""
    chosen = with_rows(select_zipf(docs, n), docs, [*_dataset(docs), "doc_id"])
    words = tx.shuffle_words(tx.zipf_words(F.col("text")), F.col("doc_id"), seed)
    return chosen.withColumn("text", F.array_join(words, " "))


def with_selection(scored: DataFrame, chosen: DataFrame, on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Scores of the whole corpus with a flag for the chosen rows."""
    flags = chosen.select(*on).withColumn("selected", F.lit(True))
    return join_checked(scored, flags, on, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def pool_prefix(rows: DataFrame, n: int, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """The first ``n`` rows of each dataset by id."""
    return top_n(rows, [F.col("doc_id")], n, keys)


def fraction_subset(
    rows: DataFrame, fractions: Sequence[float], at_least: int = 0, keys: Sequence[str] = ("dataset",)
) -> DataFrame:
    """The first ``floor(rows * fraction)`` rows of each dataset, once per fraction that gives enough.

    Only ids are ordered, to find the last id of each fraction; the rows themselves are not shuffled.
    """
    placed = pin(global_index(rows.select(*keys, "doc_id"), [F.col("doc_id")], keys, "_place", 1))
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    parts = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    limits = sizes.select(*keys, "_size", parts).select(
        *keys, "fraction", F.floor(F.col("_size") * F.col("fraction")).alias("_place")
    )
    cuts = join_checked(placed, limits.where((F.col("_place") > 0) & (F.col("_place") >= at_least)), [*keys, "_place"])
    cuts = cuts.groupBy(*keys).agg(F.collect_list(F.struct("fraction", F.col("doc_id").alias("last"))).alias("_cuts"))
    fitting = F.filter("_cuts", lambda cut: cut["last"] >= F.col("doc_id"))
    joined = join_checked(rows, cuts, keys)
    return joined.select(*rows.columns, F.explode(fitting).alias("_cut")).select(*rows.columns, "_cut.fraction")


def centroid_split(rows: DataFrame, chosen: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows inside the chosen set's radius (mean plus one deviation of its own distances), and the tail.

    The tail is ranked from the farthest; inside rows have no rank.
    """
    own = join_checked(rows, chosen.select("doc_id"), ["doc_id"])
    centroid = own.agg(vx.mean_vector(F.col(vector)).alias("c")).first()["c"]
    center = F.array(*[F.lit(float(x)) for x in centroid])
    distance = F.round(F.sqrt(vx.squared_distance(F.col(vector), center)), DIGITS)
    spread = F.coalesce(F.stddev_samp("d"), F.lit(0.0))  # one row has no deviation
    limits = own.select(distance.alias("d")).agg((F.avg("d") + spread).alias("limit"))
    limit = round(limits.first()["limit"], DIGITS)
    placed = rows.select("doc_id", distance.alias("distance"))
    placed = pin(placed).withColumn("part", F.when(F.col("distance") <= F.lit(limit), "inside").otherwise("tail"))
    ranked = global_index(placed, [F.col("distance").desc(), F.col("doc_id")], ["part"], "rank", 1)
    return ranked.withColumn("rank", F.when(F.col("part") == "tail", F.col("rank")))


def incremental_intervals(split: DataFrame, rows: DataFrame, step: int, seed: int = 42) -> DataFrame:
    """Growing sets as ``doc_id, series, added``: each row once with the size of the first set of a series that has it.

    Inside rows have no series and belong to all sets. The series ``tail`` adds the farthest tail rows, ``random`` seeded
    random ones of the rows that are not inside, ``step`` rows at a time until as many are added as there are tail rows; the
    last step may be smaller. ``set_members`` reads one set.
    """
    inside = split.where("part = 'inside'").select("doc_id")
    tail = pin(split.where(F.col("part") == "tail").select("doc_id", F.col("rank").cast("bigint").alias("rank")))
    size = tail.count()
    keyed = rows.join(inside, "doc_id", "left_anti").select("doc_id", tx.seeded_key(seed, F.col("doc_id")).alias("_key"))
    chance = global_index(keyed, [F.col("_key"), F.col("doc_id")], name="rank", start=1).where(F.col("rank") <= size)

    def series(extra: DataFrame, name: str) -> DataFrame:
        added = F.least(F.ceil(F.col("rank") / step) * step, F.lit(size)).cast("bigint")
        return extra.select("doc_id", F.lit(name).alias("series"), added.alias("added"))

    base = inside.select("doc_id", F.lit(None).cast("string").alias("series"), F.lit(0).cast("bigint").alias("added"))
    return base.unionByName(series(tail, "tail")).unionByName(series(chance, "random"))


def set_members(intervals: DataFrame, series: str | None = None, added: int = 0) -> DataFrame:
    """The rows of one set: the inside rows and those that ``series`` has added up to this size."""
    held = (F.col("series") == series) & (F.col("added") <= added) if series else F.lit(False)
    return intervals.where(F.col("series").isNull() | held).select("doc_id")


def incremental_sets(split: DataFrame, rows: DataFrame, step: int, seed: int = 42) -> DataFrame:
    """The sets of ``incremental_intervals`` written out: ``doc_id, label`` with a row for every set that has the row.

    That is every inside row once per set, so the output grows with the number of sets; the intervals do not. Rows are dealt out
    evenly to as many tasks as the output needs, and take their labels as a slice of one constant list.
    """
    held = pin(incremental_intervals(split, rows, step, seed))
    found = {r["series"]: r["n"] for r in held.groupBy("series").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = found.get("tail", 0)
    steps = -(-size // step)
    labels = [f"{name}_add_{min(i * step, size)}" for name in ("tail", "random") for i in range(1, steps + 1)]
    every = F.split(F.lit(",".join(["intersection", *labels])), ",")
    nth = F.ceil(F.col("added") / step)
    own = F.when(F.col("series") == "tail", nth + 1).otherwise(nth + 1 + steps)
    first = F.when(F.col("series").isNull(), 1).otherwise(own).cast("int")
    length = F.when(F.col("series").isNull(), 1 + 2 * steps).otherwise(steps + 1 - nth).cast("int")
    written = sum(n * (1 + 2 * steps if name is None else (steps + 1) / 2) for name, n in found.items())
    dealt = held.repartition(max(1, math.ceil(written / LABELLED_ROWS)))
    return dealt.select("doc_id", F.explode(F.slice(every, first, length)).alias("label"))


def cluster_representatives(
    rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding", steps: int = LLOYD_STEPS
) -> DataFrame:
    """One row per k-means cluster: the one nearest to its center, and the cluster's size.

    The first centers are ``k`` distinct vectors in seeded order. Each step reads the rows once: they go to the nearest
    center (ties to the smaller number) and sums per center are shuffled, nothing else. Centers and distances are rounded
    to ``DIGITS``, so the result does not depend on partitions. It ends early when no center moves; a center that lost
    all its rows stays where it is and has no representative. Rows without a vector are left out.
    """
    narrow = pin(rows.select("doc_id", vx.as_doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull()))
    firsts = narrow.groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.orderBy(tx.seeded_key(seed, F.col("doc_id")), "doc_id").limit(k).select("v")
    centers = [list(r["v"]) for r in firsts.collect()]
    if not centers:
        return narrow.select(F.lit(0).cast("bigint").alias("cluster"), "doc_id", F.lit(0).cast("bigint").alias("members"))

    def assigned() -> DataFrame:
        # k centers as one constant instead of an expression per number
        fixed = F.from_json(F.lit(json.dumps(centers)), "array<array<double>>")
        away = F.transform(fixed, lambda c: F.round(vx.squared_distance(F.col("v"), c), DIGITS))
        near = narrow.withColumn("_away", away).withColumn("d", F.array_min("_away"))
        return near.withColumn("cluster", F.array_position("_away", F.col("d")) - 1).drop("_away")

    for _ in range(steps):
        means = assigned().groupBy("cluster").agg(vx.mean_vector(F.col("v")).alias("m"))
        rounded = means.select("cluster", F.transform("m", lambda x: F.round(x, DIGITS)).alias("m"))
        moved = {r["cluster"]: list(r["m"]) for r in rounded.collect()}
        after = [moved.get(c, center) for c, center in enumerate(centers)]
        if after == centers:
            break
        centers = after
    nearest = F.min(F.struct("d", "doc_id"))
    return assigned().groupBy("cluster").agg(nearest.alias("m"), F.count(F.lit(1)).alias("members")).select(
        "cluster", F.col("m.doc_id").alias("doc_id"), "members"
    )


def subsample_values(rows: DataFrame, n: int, key: str, row_id: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` seeded random values per group."""
    keyed = rows.withColumn("_key", tx.seeded_key(seed, *[F.col(c) for c in row_id]))
    return top_n(keyed, [F.col("_key"), *[F.col(c) for c in row_id]], n, [key]).drop("_key", "rank")


def sample_pairs(weights: DataFrame, scales: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """``m`` seeded random cells of a matrix, with replacement, with the scale of their column.

    ``weights``: row, col, w with indices from 0; ``scales``: col, s. Every draw gives a row: ``w`` is null where the matrix has
    no such cell, ``s`` where the column has no scale. An empty matrix gives no rows.
    """
    spark = weights.sparkSession
    size = weights.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    rows, columns = (0 if size[c] is None else size[c] + 1 for c in ("r", "c"))
    draws = spark.range(min(m, rows * columns)).select(
        F.col("id").alias("draw"),
        tx.seeded_int(seed, max(rows, 1), F.lit("r"), F.col("id")).alias("row"),
        tx.seeded_int(seed, max(columns, 1), F.lit("c"), F.col("id")).alias("col"),
    )
    found = draws.join(weights, ["row", "col"], "left").join(scales, "col", "left")
    return found.select("draw", "row", "col", "w", "s")
