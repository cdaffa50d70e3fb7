"""Queries over experiment result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import labels as lb
from quillsieve.operators import results as rs
from quillsieve.plans.registry import load, query
from quillsieve.plans.tables import SQL_FACTS, facts
from quillsieve.session import pin

METHODS = ("unique_tokens", "random_sample", "most_similar")
REQUESTED = ("mmlu", "gsm8k", "boolq")


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def sql_group(name: str) -> str:
    return (
        f"case when {name} is null then 'Other' when contains({name}, '_') then 'Mixed' when {name} = 'c4' then 'General' when {name} = 'gsm8k' "
        f"then 'Arithmetic Reasoning' when {name} = 'opc' then 'Coding' else 'Other' end"
    )


SQL_METRIC = (
    "case task when 'gsm8k' then 'exact_match,flexible-extract' when 'xquad_es' then 'f1,none' when 'arc_challenge' then 'acc_norm,none' "
    "else 'acc,none' end"
)


@query(
    "calib_group",
    f"with {SQL_FACTS} select {sql_group('calibration_datasets')} as \"group\", count(*)::bigint as n from facts group by 1",
)
def q_calib_group(spark, sf):
    return facts(spark, sf).groupBy(lb.calib_group(F.col("calibration_datasets")).alias("group")).agg(F.count(F.lit(1)).alias("n"))


@query("metric_for_task", f"with {SQL_FACTS} select task, {SQL_METRIC} as metric, count(*)::bigint as n from facts group by all")
def q_metric_for_task(spark, sf):
    return facts(spark, sf).groupBy("task", lb.metric_for_task(F.col("task")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "task_covered",
    f"with {SQL_FACTS}, req as (select unnest(['mmlu', 'gsm8k', 'boolq', 'arc', 'xnli']) as requested) select model, requested, "
    "bool_or(task = requested or starts_with(task, requested || '_')) as covered from facts, req group by all",
)
def q_task_covered(spark, sf):
    sets = rs.task_sets(facts(spark, sf), ["model"])
    asked = F.explode(F.array(*[F.lit(t) for t in ("mmlu", "gsm8k", "boolq", "arc", "xnli")])).alias("requested")
    return sets.select("model", "tasks", asked).select(
        "model", "requested", lb.task_covered(F.col("tasks"), F.col("requested")).alias("covered")
    )


@query(
    "numeric_metric_filter",
    f"with {SQL_FACTS}, m as (select row_id, 'acc,none' as metric, cast(pruned_value as varchar) as raw from facts union all select row_id, "
    "'acc_stderr,none', '0.5' from facts union all select row_id, 'alias', task from facts union all select row_id, 'n', "
    "cast(nsamples as varchar) from facts) select row_id, metric, round(try_cast(raw as double), 9) as value from m where not contains(metric, "
    "'stderr') and try_cast(raw as double) is not null",
)
def q_numeric_metric_filter(spark, sf):
    nested = facts(spark, sf).select(
        "row_id",
        F.create_map(
            F.lit("acc,none"), F.col("pruned_value").cast("string"),
            F.lit("acc_stderr,none"), F.lit("0.5"),
            F.lit("alias"), F.col("task"),
            F.lit("n"), F.col("nsamples").cast("string"),
        ).alias("metrics"),
    )
    return _rounded(rs.numeric_metrics(nested, ["row_id"]), 9, "value")


@query(
    "to_numeric_coerce",
    "select o_orderkey as row_id, cast(substr(o_orderpriority, 1, 1) as double) as value from orders where o_orderkey % 5 <> 0",
)
def q_to_numeric_coerce(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1))
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), lb.to_number(raw).alias("value"))
    return orders.dropna(subset=["value"])


@query(
    "best_accuracy",
    f"with {SQL_FACTS} select row_id, greatest(case when row_id % 3 <> 0 then pruned_value end, case when row_id % 5 <> 0 then original_value "
    "end) as best from facts where not (row_id % 3 = 0 and row_id % 5 = 0) and greatest(case when row_id % 3 <> 0 then pruned_value end, case "
    "when row_id % 5 <> 0 then original_value end) is not null",
)
def q_best_accuracy(spark, sf):
    wide = facts(spark, sf).select(
        "row_id",
        F.when(F.col("row_id") % 3 != 0, F.col("pruned_value")).alias("acc,none"),
        F.when(F.col("row_id") % 5 != 0, F.col("original_value")).alias("acc_norm,none"),
        F.lit(9.0).alias("acc_stderr,none"),
    )
    return wide.select("row_id", lb.best_accuracy(wide.columns[1:]).alias("best")).dropna(subset=["best"])


@query(
    "unpivot_stats",
    f"with {SQL_FACTS}, w as (select model, task, max(pruned_value) as x_1, min(pruned_value) as x_2 from facts group by all) select model, "
    "task, 'First' as sampling, x_1 as x from w union all select model, task, 'Second', x_2 from w",
)
def q_unpivot_stats(spark, sf):
    wide = facts(spark, sf).groupBy("model", "task").agg(F.max("pruned_value").alias("x_1"), F.min("pruned_value").alias("x_2"))
    return rs.unpivot_pairs(wide, ["model", "task"], "x", {"1": "First", "2": "Second"})


@query(
    "relabel",
    "select p_partkey, case p_partkey % 4 when 0 then 'Random' when 1 then 'Bag of words' when 2 then 'GSM8K' else 'other' end as shown, "
    "split_part('org/' || p_brand || case p_partkey % 4 when 0 then '-70B' when 1 then '-8B' when 2 then '-3B' else '' end, "
    "'/', -1) as short_name, case p_partkey % 4 when 0 then '70B' when 1 then '8B' when 2 then '3B' else 'org/' || p_brand end as size from part",
)
def q_relabel(spark, sf):
    tail = F.element_at(F.array(F.lit("-70B"), F.lit("-8B"), F.lit("-3B"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    model = F.concat(F.lit("org/"), F.col("p_brand"), tail)
    names = F.array(*[F.lit(n) for n in ("random", "words_dataset", "gsm8k", "other")])
    labels = {"random": "Random", "words_dataset": "Bag of words", "gsm8k": "GSM8K"}
    shown = lb.display_name(F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")), labels).alias("shown")
    return load(spark, sf, "part").select("p_partkey", shown, lb.short_model(model).alias("short_name"), lb.size_tag(model).alias("size"))


@query(
    "unknown_keys",
    "select distinct p_brand as model from part where p_brand not in (select 'Brand#' || n_nationkey from nation where n_nationkey < 3)",
)
def q_unknown_keys(spark, sf):
    asked = load(spark, sf, "part").select(F.col("p_brand").alias("model")).distinct()
    known = load(spark, sf, "nation").where("n_nationkey < 3").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("model"))
    return rs.unknown_keys(asked, known, "model")


@query(
    "join_original_pruned",
    f"with {SQL_FACTS}, o as (select task, metric, arg_min(original_value, row_id) as original_value from facts where model <> 'ASIA' and "
    "metric <> 'acc_stderr,none' group by all) select row_id, facts.task, facts.metric, round(pruned_value, 9) as pruned_value, "
    "o.original_value from facts left join o using (task, metric)",
)
def q_join_original_pruned(spark, sf):
    rows = facts(spark, sf)
    original = rows.where("model <> 'ASIA' and metric <> 'acc_stderr,none'").select("task", "metric", "row_id", "original_value")
    pruned = rows.select("row_id", "task", "metric", F.round("pruned_value", 9).alias("pruned_value"))
    return rs.join_original_pruned(pruned, original)


SQL_DONE = (
    "done as (select model, compression_type, pruning_type, nsamples, sparsity, calibration_datasets from facts where pruned_value is not null and "
    "calibration_datasets is not null group by all having bool_or(task = 'mmlu' or starts_with(task, 'mmlu_')) and bool_or(task = 'gsm8k' or "
    "starts_with(task, 'gsm8k_')) and bool_or(task = 'boolq' or starts_with(task, 'boolq_')))"
)


@query(
    "remaining_experiments",
    f"with {SQL_FACTS}, {SQL_DONE}, grid as (select distinct model, compression_type, pruning_type, nsamples, sparsity, calibration_datasets "
    "from facts where calibration_datasets is not null) select * from grid anti join done using (model, compression_type, pruning_type, "
    "nsamples, sparsity, calibration_datasets)",
)
def q_remaining_experiments(spark, sf):
    rows = facts(spark, sf)
    grid = rows.dropna(subset=["calibration_datasets"]).select(*rs.EXPERIMENT_KEYS).distinct()
    return rs.remaining_experiments(grid, rows.where("pruned_value is not null"), REQUESTED)


@query(
    "experiment_grid",
    f"with {SQL_FACTS}, m as (select distinct model from facts), t as (select distinct task from facts), s as (select distinct nsamples from "
    "facts), g as (select model, task, nsamples from m, t, s) select row_number() over (order by model, task, nsamples) - 1 as task_id, "
    "model, task, nsamples from g",
)
def q_experiment_grid(spark, sf):
    rows = facts(spark, sf)
    return rs.experiment_grid({name: rows for name in ("model", "task", "nsamples")})


@query(
    "task_semi",
    f"with {SQL_FACTS} select row_id, task from facts where task in ('mmlu', 'gsm8k', 'arc') or starts_with(task, 'mmlu_') or "
    "starts_with(task, 'gsm8k_') or starts_with(task, 'arc_')",
)
def q_task_semi(spark, sf):
    return rs.task_semi(facts(spark, sf).select("row_id", "task"), ["mmlu", "gsm8k", "arc"])


def _sql_pivot(keys: str) -> str:
    return (
        f"p as (select {keys}, "
        + ", ".join(f"avg(pruned_value) filter (pruning_type = '{m}') as {m}" for m in METHODS)
        + f" from facts where {' and '.join(k.strip() + ' is not null' for k in keys.split(','))} group by {keys})"
    )


_SQL_ROUNDED = ", ".join(f"round({m}, 9) as {m}" for m in METHODS)


@query(
    "mean_pivot",
    f"with {SQL_FACTS}, {_sql_pivot('model, task, calibration_datasets')} select model, task, calibration_datasets, {_SQL_ROUNDED} from p",
)
def q_mean_pivot(spark, sf):
    return _rounded(rs.mean_pivot(facts(spark, sf), ["model", "task", "calibration_datasets"], METHODS), 9, *METHODS)


@query(
    "attach_original",
    f"with {SQL_FACTS}, {_sql_pivot('model, task')}, o as (select model, task, arg_min(original_value, row_id) as original from facts group "
    f"by all) select model, task, original, {_SQL_ROUNDED} from p left join o using (model, task)",
)
def q_attach_original(spark, sf):
    rows = facts(spark, sf)
    pivot = rs.mean_pivot(rows, ["model", "task"], METHODS)
    return _rounded(rs.attach_original(pivot, rows, ["model", "task"]), 9, *METHODS)


@query(
    "first_original",
    f"with {SQL_FACTS} select model, task, metric, arg_min(original_value, row_id) as original, min(row_id) as row_id from facts "
    "where pruned_value is not null group by all",
)
def q_first_original(spark, sf):
    rows = facts(spark, sf).where("pruned_value is not null").withColumn("id", F.col("row_id"))
    first = rs.first_per_key(rows, ["model", "task", "metric"], "row_id", "original_value", "id")
    return first.select("model", "task", "metric", F.col("original_value").alias("original"), F.col("id").alias("row_id"))


_LEVELS = (
    ("calibration_datasets", "model", "pruning_type", "task"),
    ("calibration_datasets", "model", "pruning_type"),
    ("model", "pruning_type", "task"),
    ("model", "pruning_type"),
)


@query(
    "mean_levels",
    f"with {SQL_FACTS} select calibration_datasets, model, pruning_type, task, grouping(calibration_datasets, model, pruning_type, task)::bigint "
    "as level, round(avg(pruned_value), 9) as mean_value, round(avg(original_value), 9) as mean_original from facts where "
    "calibration_datasets is not null group by grouping sets ("
    + ", ".join(f"({', '.join(level)})" for level in _LEVELS)
    + ")",
)
def q_mean_levels(spark, sf):
    out = rs.mean_levels(facts(spark, sf), _LEVELS)
    return _rounded(out, 9, "mean_value", "mean_original").select(*_LEVELS[0], "level", "mean_value", "mean_original")


_SQL_GROUP_MEANS = (
    SQL_FACTS + f", g as (select model, task, pruning_type, {sql_group('calibration_datasets')} as grp, avg(pruned_value) as m from facts group by "
    "all), mm as (select model, task, pruning_type, avg(m) as mean_value from g group by all)"
)


def _group_means(spark, sf):
    rows = facts(spark, sf).withColumn("group", lb.calib_group(F.col("calibration_datasets")))
    return rs.mean_of_group_means(rows, ["model", "task", "pruning_type"])


@query(
    "mean_of_group_means",
    f"with {_SQL_GROUP_MEANS} select model, task, pruning_type, round(mean_value, 9) as mean_value from mm",
)
def q_mean_of_group_means(spark, sf):
    return _rounded(_group_means(spark, sf), 9, "mean_value")


@query(
    "mean_row",
    f"with {SQL_FACTS}, {_sql_pivot('model, task')} select model, task, {_SQL_ROUNDED} from p union all select model, 'Mean', "
    + ", ".join(f"round(avg({m}), 9)" for m in METHODS)
    + " from p group by model",
)
def q_mean_row(spark, sf):
    pivot = rs.mean_pivot(facts(spark, sf), ["model", "task"], METHODS)
    return _rounded(rs.with_mean_row(pivot, "task", METHODS, ["model"]), 9, *METHODS)


@query(
    "geo_mean_pct",
    f"with {SQL_FACTS} select model, pruning_type, round(100 * exp(avg(ln(pruned_value / original_value))), 9) as geo, round(avg(pruned_value), 9) "
    "as arith from facts where pruned_value > 0 and original_value > 0 group by all",
)
def q_geo_mean_pct(spark, sf):
    rows = facts(spark, sf).groupBy("model", "pruning_type")
    out = rows.agg(
        rs.geo_mean_pct(F.col("pruned_value"), F.col("original_value")).alias("geo"), F.avg("pruned_value").alias("arith")
    )
    return _rounded(out, 9, "geo", "arith")


_SQL_BASE = SQL_FACTS + (
    f", f as (select *, {sql_group('calibration_datasets')} as grp from facts where metric = {SQL_METRIC}), base as (select model, grp, task, "
    "avg(pruned_value) as baseline from f where pruning_type = 'most_similar' group by all), ours as (select model, grp, task, "
    "avg(pruned_value) as ours, arg_min(original_value, row_id) as dense from f where pruning_type = 'unique_tokens' group by all)"
)


def _ours_and_baseline(spark, sf):
    rows = rs.of_task_metric(facts(spark, sf))
    rows = rows.withColumn("group", lb.calib_group(F.col("calibration_datasets")))
    baseline = rows.where("pruning_type = 'most_similar'").withColumnRenamed("pruned_value", "value")
    return rows.where("pruning_type = 'unique_tokens'"), baseline


@query(
    "method_vs_baseline",
    f"with {_SQL_BASE} select model, grp as \"group\", task, round(ours, 9) as ours, round(baseline, 9) as baseline from ours join base using "
    "(model, grp, task) where ours is not null and baseline is not null",
)
def q_method_vs_baseline(spark, sf):
    ours, baseline = _ours_and_baseline(spark, sf)
    keys = ["model", "group", "task"]
    joined = rs.method_vs_baseline(
        ours.groupBy(*keys).agg(F.avg("pruned_value").alias("ours")), baseline.groupBy(*keys).agg(F.avg("value").alias("baseline")), keys
    )
    return _rounded(joined, 9, "ours", "baseline")


@query(
    "group_grid",
    f"with {_SQL_BASE}, c as (select model, grp, task, dense, ours, baseline from ours left join base using (model, grp, task)), gm as (select "
    "model, grp, avg(dense) as dense, avg(ours) as ours, avg(baseline) as baseline, 100 * exp(avg(ln(ours / dense))) as go, 100 * "
    "exp(avg(ln(baseline / dense))) as gb from c group by all), u as (select model, grp, task, dense, ours, baseline from c union all select "
    "model, grp, 'Mean', dense, ours, baseline from gm union all select model, grp, 'Geo%', 100, go, gb from gm union all select model, 'All', "
    "'Geo%', 100, avg(go), avg(gb) from gm group by model) select model, grp as \"group\", task, round(dense, 6) as dense, round(ours, 6) as "
    "ours, round(baseline, 6) as baseline from u",
)
def q_group_grid(spark, sf):
    out = rs.group_grid(*_ours_and_baseline(spark, sf))
    return _rounded(out, 6, "dense", "ours", "baseline")


@query(
    "distinct_results",
    f"with {SQL_FACTS} select distinct model, task, metric, original_value from facts",
)
def q_distinct_results(spark, sf):
    return facts(spark, sf).select("model", "task", "metric", "original_value").distinct()


@query(
    "task_sets",
    f"with {SQL_FACTS} select model, pruning_type, nsamples, string_agg(distinct task, ',' order by task) as tasks from facts group by all",
)
def q_task_sets(spark, sf):
    sets = rs.task_sets(facts(spark, sf), ["model", "pruning_type", "nsamples"])
    return sets.withColumn("tasks", F.array_join(F.sort_array("tasks"), ","))


_SQL_TOP3 = (
    _SQL_GROUP_MEANS + ", t as (select model, task, pruning_type, round(mean_value, 9) as mean_value, row_number() over (partition by model, "
    "task order by round(mean_value, 9) desc, pruning_type) as place from mm where mean_value is not null)"
)


def _top(spark, sf, n):
    means = pin(_rounded(_group_means(spark, sf), 9, "mean_value"))
    return means, rs.top3_per_row(means.withColumn("position", F.col("pruning_type")), ["model", "task"], n=n)


@query("top3_per_row", f"with {_SQL_TOP3} select model, task, pruning_type, mean_value, place::integer as place from t where place <= 3")
def q_top3_per_row(spark, sf):
    return _top(spark, sf, 3)[1].drop("position")


@query(
    "rank_highlight",
    f"with {_SQL_TOP3} select model, task, pruning_type, case when mean_value is null then 'nan' when place <= 2 then format('{{:.4f}} ({{}})', "
    "mean_value, place) else format('{:.4f}', mean_value) end as cell from t",
)
def q_rank_highlight(spark, sf):
    means, best = _top(spark, sf, 2)
    keys = ["model", "task", "pruning_type"]
    joined = means.join(best.select(*keys, "place"), keys, "left")
    return joined.select(*keys, rs.highlight(F.col("mean_value"), F.col("place")).alias("cell"))


@query(
    "winner_of_two",
    f"with {_SQL_BASE} select model, grp as \"group\", task, case when round(ours, 9) >= round(baseline, 9) then 'ours' when round(ours, 9) < "
    "round(baseline, 9) then 'baseline' end as winner from ours left join base using (model, grp, task)",
)
def q_winner_of_two(spark, sf):
    ours, baseline = _ours_and_baseline(spark, sf)
    cells = rs.group_grid(ours, baseline).where(~F.col("task").isin("Mean", "Geo%"))
    picked = rs.winner(F.round("ours", 9), F.round("baseline", 9)).alias("winner")
    return cells.select("model", "group", "task", picked)


_SQL_STEPS = (
    SQL_FACTS + ", s as (select case row_id % 7 when 0 then 'intersection' when 1 then 'tail_add_5' when 2 then 'tail_add_10' when 3 then "
    "'random_add_5' when 4 then 'random_add_10' when 5 then 'tail_add_15' else 'random_add_15' end as label, 20 + 5 * (row_id % 7) as n_samples, "
    "pruned_value as value from facts)"
)


@query(
    "mean_by_step",
    f"with {_SQL_STEPS}, u as (select 'tail' as family, n_samples, value from s where label = 'intersection' or starts_with(label, 'tail') union "
    "all select 'random', n_samples, value from s where label = 'intersection' or starts_with(label, 'random')) select family, n_samples, "
    "round(avg(value), 9) as mean_value from u group by all",
)
def q_mean_by_step(spark, sf):
    names = ("intersection", "tail_add_5", "tail_add_10", "random_add_5", "random_add_10", "tail_add_15", "random_add_15")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("row_id") % 7 + 1).cast("int"))
    sets = facts(spark, sf).select(
        label.alias("label"), (20 + 5 * (F.col("row_id") % 7)).alias("n_samples"), F.col("pruned_value").alias("value")
    )
    return _rounded(rs.mean_by_step(sets), 9, "mean_value")


@query(
    "pool_size_timing",
    f"with {SQL_FACTS} select pruning_type as method, sparsity as fraction, min(pruned_value) as fastest, max(pruned_value) as slowest from facts "
    "group by all",
)
def q_pool_size_timing(spark, sf):
    rows = facts(spark, sf).select(F.col("pruning_type").alias("method"), F.col("sparsity").alias("fraction"), F.col("pruned_value").alias("seconds"))
    return rs.extremes_by_fraction(rows)
