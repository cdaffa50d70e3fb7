"""Joins, pivots and rankings over experiment result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.functions import labels as lb
from quillsieve.operators.skew import join_checked

EXPERIMENT_KEYS = ("model", "compression_type", "pruning_type", "nsamples", "sparsity", "calibration_datasets")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str, *values: str) -> DataFrame:
    """The values of the first row of each key; combined before the shuffle."""
    packed = F.min_by(F.struct(*values), order).alias("_v")
    return rows.groupBy(*keys).agg(packed).select(*keys, "_v.*")


def join_original_pruned(pruned: DataFrame, original: DataFrame, keys: Sequence[str] = ("task", "metric"), order: str = "row_id") -> DataFrame:
    """Each pruned row with the first original value of its task and metric, null if there is none."""
    first = first_per_key(original, keys, order, "original_value")
    return join_checked(pruned, first, keys, "left")


def task_sets(results: DataFrame, keys: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    """Tasks done per experiment; the distinct names are few, whatever the number of rows."""
    return results.groupBy(*keys).agg(F.collect_set("task").alias("tasks"))


def completed_experiments(results: DataFrame, requested: Sequence[str], keys: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    """Experiments in which every requested task is covered; rows with a missing key are left out."""
    sets = task_sets(results.dropna(subset=list(keys)), keys)
    for task in requested:
        sets = sets.where(lb.task_covered(F.col("tasks"), F.lit(task)))
    return sets.select(*keys)


def remaining_experiments(grid: DataFrame, results: DataFrame, requested: Sequence[str], keys: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    return grid.join(completed_experiments(results, requested, keys), list(keys), "left_anti")


def experiment_grid(axes: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the axes, numbered in mixed radix with the last axis fastest.

    The axes are short lists of settings, collected as arrays and exploded one within the other.
    """
    lists = {name: [r[0] for r in frame.select(name).distinct().orderBy(name).collect()] for name, frame in axes.items()}
    spark = next(iter(axes.values())).sparkSession
    total = 1
    for values in lists.values():
        total *= len(values)
    grid, stride = spark.range(total).withColumnRenamed("id", "task_id"), total
    for name, values in lists.items():
        stride //= max(len(values), 1)
        at = F.floor(F.col("task_id") / stride) % len(values)
        grid = grid.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int")))
    return grid


def task_semi(rows: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Rows whose task is one of the requested ones or a subtask of one."""
    condition = F.lit(False)
    for task in requested:
        condition = condition | lb.task_in_group(F.col("task"), F.lit(task))
    return rows.where(condition)


def unknown_keys(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return requested.join(results.select(key).distinct(), key, "left_anti")


def numeric_metrics(results: DataFrame, keys: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """One row per numeric metric of a nested map, standard errors left out."""
    flat = results.select(*keys, F.explode(metrics).alias("metric", "raw"))
    kept = flat.where(~F.col("metric").contains("stderr"))
    return kept.select(*keys, "metric", lb.to_number(F.col("raw")).alias("value")).dropna(subset=["value"])


def attach_original(pivot: DataFrame, results: DataFrame, keys: Sequence[str], order: str = "row_id") -> DataFrame:
    """The first known original value of each group next to its means; rows without a key are dropped."""
    known = results.where(F.col("original_value").isNotNull()).dropna(subset=list(keys))
    first = first_per_key(known, keys, order, F.col("original_value").alias("original"))
    return join_checked(pivot, first, keys, "left")


def mean_pivot(results: DataFrame, keys: Sequence[str], methods: Sequence[str], value: str = "pruned_value", column: str = "pruning_type") -> DataFrame:
    """Mean value per group and method, methods as columns; rows with a missing key are dropped."""
    return results.dropna(subset=list(keys)).groupBy(*keys).pivot(column, list(methods)).agg(F.avg(value))


def mean_levels(results: DataFrame, levels: Sequence[Sequence[str]], value: str = "pruned_value") -> DataFrame:
    """The long form of several groupings at once, by grouping sets over one scan."""
    names = sorted({name for level in levels for name in level})
    sets = [[F.col(n) for n in level] for level in levels]
    columns = [F.col(n) for n in names]
    known = results.dropna(subset=names)
    return known.groupingSets(sets, *columns).agg(
        F.grouping_id(*columns).cast("bigint").alias("level"),
        F.avg(value).alias("mean_value"),
        F.avg("original_value").alias("mean_original"),
    )


def mean_of_group_means(results: DataFrame, keys: Sequence[str], group: str = "group", value: str = "pruned_value") -> DataFrame:
    """Mean over groups of each group's mean, so that large groups weigh no more than small ones."""
    inner = results.dropna(subset=[*keys, group]).groupBy(*keys, group).agg(F.avg(value).alias("m"))
    return inner.groupBy(*keys).agg(F.avg("m").alias("mean_value"))


def with_mean_row(table: DataFrame, label: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The table and a row 'Mean' of its column means, missing values left out."""
    mean = table.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]).withColumn(label, F.lit("Mean"))
    return table.select(*keys, label, *values).unionByName(mean)


def geo_mean_pct(value: Column, dense: Column) -> Column:
    """Aggregate: geometric mean of value over dense in percent, over pairs of positive numbers."""
    usable = (value > 0) & (dense > 0) & ~F.isnan(value) & ~F.isnan(dense)
    return F.exp(F.avg(F.when(usable, F.log(value / dense)))) * 100


def of_task_metric(rows: DataFrame) -> DataFrame:
    """Rows of the metric that stands for their task; a task's other metrics are not averaged with it."""
    return rows.where(F.col("metric") == lb.metric_for_task(F.col("task")))


def method_vs_baseline(ours: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Both means side by side for the tasks where both are known."""
    return join_checked(ours, baseline, keys).dropna()


def group_grid(results: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per task and dataset group: dense value, ours and the baseline; means and geometric means below.

    Both tables hold one metric for each task (see ``of_task_metric``).
    """
    by = [*keys, "group", "task"]
    ours = results.groupBy(*by).agg(F.avg("pruned_value").alias("ours"), F.min_by("original_value", "row_id").alias("dense"))
    other = baseline.groupBy(*by).agg(F.avg("value").alias("baseline"))
    cells = ours.join(other, by, "left")
    per_group = cells.groupBy(*keys, "group").agg(
        F.avg("dense").alias("dense"),
        F.avg("ours").alias("ours"),
        F.avg("baseline").alias("baseline"),
        geo_mean_pct(F.col("ours"), F.col("dense")).alias("geo_ours"),
        geo_mean_pct(F.col("baseline"), F.col("dense")).alias("geo_baseline"),
    )
    geo = per_group.select(
        *keys, "group", F.lit("Geo%").alias("task"), F.lit(100.0).alias("dense"),
        F.col("geo_ours").alias("ours"), F.col("geo_baseline").alias("baseline"),
    )
    overall = geo.groupBy(*keys).agg(
        F.lit("All").alias("group"), F.lit("Geo%").alias("task"), F.lit(100.0).alias("dense"),
        F.avg("ours").alias("ours"), F.avg("baseline").alias("baseline"),
    )
    mean = per_group.select(*keys, "group", F.lit("Mean").alias("task"), "dense", "ours", "baseline")
    return cells.unionByName(mean).unionByName(geo).unionByName(overall)


def top3_per_row(long: DataFrame, keys: Sequence[str], value: str = "mean_value", position: str = "position", n: int = 3) -> DataFrame:
    """The best three columns of each row; missing values are out, ties keep the earlier column."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(position)))
    return long.where(F.col(value).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def highlight(value: Column, place: Column) -> Column:
    """A cell with four decimals, marked if it is among the best three."""
    plain = F.format_string("%.4f", value)
    marked = F.format_string("%.4f (%d)", value, place)
    return F.when(value.isNull(), "nan").when(place.isNull(), plain).otherwise(marked)


def winner(ours: Column, baseline: Column) -> Column:
    """Which of two values to set in bold; a tie favours ours."""
    return F.when(ours >= baseline, "ours").when(ours < baseline, "baseline")


def mean_by_step(sets: DataFrame, value: str = "value") -> DataFrame:
    """Mean per label family and size, each family starting from the point of the shared inside rows."""
    family = F.regexp_extract("label", r"^(tail|random)_add_", 1)
    start = sets.where("label = 'intersection'")
    shared = start.withColumn("family", F.explode(F.array(F.lit("tail"), F.lit("random"))))
    grown = sets.withColumn("family", family).where("family <> ''")
    return shared.unionByName(grown).groupBy("family", "n_samples").agg(F.avg(value).alias("mean_value"))


def unpivot_pairs(stats: DataFrame, keys: Sequence[str], metric: str, names: dict[str, str]) -> DataFrame:
    """``metric_<suffix>`` columns as rows with a sampling label."""
    columns = {f"{metric}_{suffix}": label for suffix, label in names.items()}
    long = stats.unpivot([*keys], list(columns), "source", metric)
    mapping = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    return long.select(*keys, mapping[F.col("source")].alias("sampling"), metric)


def extremes_by_fraction(timings: DataFrame) -> DataFrame:
    """Smallest and largest time per method and fraction."""
    return timings.groupBy("method", "fraction").agg(F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"))
