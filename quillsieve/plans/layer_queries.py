"""Queries over layer values, masks and vectors per layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import labels as lb
from quillsieve.operators import layers as ly
from quillsieve.plans.registry import query
from quillsieve.plans.tables import SQL_LAYERS, SQL_UNITS, layers, vectors
from quillsieve.session import pin


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


SQL_SUMS = (
    SQL_LAYERS
    + ", per as (select layer_no as layer, feature, seq, sum(x) as sx, sum(x * x) as sq, count(*) as tokens from layers group by all), "
    "sums as (select layer, feature, sum(sx) as sum_x, sum(sq) as sum_sq, sum(sqrt(sq + 1e-12)) as sum_l2, sum(sq + 1e-12) as sum_l2_sq, "
    "count(*) as samples, sum(tokens) as tokens from per group by layer, feature)"
)


def facts_of(spark, sf):
    return layers(spark, sf).select(F.col("layer_no").alias("layer"), "feature", "seq", "x")


@query(
    "running_moments",
    f"with {SQL_SUMS} select layer, feature, samples::bigint as samples, tokens::bigint as tokens, round(sum_x / tokens, 9) as mean, "
    "round(greatest(sum_sq / tokens - (sum_x / tokens) * (sum_x / tokens), 0), 9) as variance, round(sqrt(sum_sq + 1e-12), 9) as "
    "feature_norm, round(sum_l2 / samples, 9) as mean_l2, round(sqrt(greatest(sum_l2_sq / samples - (sum_l2 / samples) * "
    "(sum_l2 / samples), 0)), 6) as std_l2 from sums",
)
def q_running_moments(spark, sf):
    out = ly.finish_moments(ly.running_sums(facts_of(spark, sf)))
    out = _rounded(out, 9, "mean", "variance", "feature_norm", "mean_l2")
    return _rounded(out, 6, "std_l2").select(
        "layer", "feature", "samples", "tokens", "mean", "variance", "feature_norm", "mean_l2", "std_l2"
    )


@query(
    "second_moment_max",
    f"with {SQL_LAYERS} select layer_no as layer, feature, round(avg(x * x), 9) as second_moment, round(sqrt(avg(x * x)), 9) as rms, "
    "round(max(abs(x)), 9) as max_abs from layers group by all",
)
def q_second_moment_max(spark, sf):
    return _rounded(ly.second_moment(facts_of(spark, sf)), 9, "second_moment", "rms", "max_abs")


_SQL_MATRIX = (
    SQL_UNITS
    + ", w as (select dataset as module, doc_id as row, unnest(range(len(embedding))) as col, unnest(embedding) as w from vecs), "
    "s as (select module, col, avg(w * w) as s from w group by all)"
)


def _matrix(spark, sf):
    cells = vectors(spark, sf).select(
        F.col("dataset").alias("module"), F.col("doc_id").alias("row"), F.posexplode("embedding").alias("col", "w")
    )
    return cells.withColumn("col", F.col("col").cast("bigint"))


@query(
    "weighted_scores",
    f"with {_SQL_MATRIX} select module, row, col, round(abs(w) * sqrt(s), 9) as score from w join s using (module, col)",
)
def q_weighted_scores(spark, sf):
    weights = _matrix(spark, sf)
    scales = weights.groupBy("module", "col").agg(F.avg(F.col("w") * F.col("w")).alias("s"))
    return _rounded(ly.weighted_scores(weights, scales), 9, "score")


def _masks(spark, sf):
    cells = _matrix(spark, sf)
    a = cells.select("module", "row", "col", F.abs("w").alias("score"))
    return a, a.withColumn("score", F.col("score") * (1 + F.col("col") % 7 / 10.0))


@query(
    "mask_overlap",
    f"with {_SQL_MATRIX}, k as (select module, greatest(floor((max(col) + 1) * 0.5::double), 1)::bigint as k from w group by module), a as (select "
    "module, row, col, row_number() over (partition by module, row order by abs(w) desc, col) as place from w), b as (select module, row, "
    "col, row_number() over (partition by module, row order by abs(w) * (1 + col % 7 / 10.0::double) desc, col) as place from w) select "
    "a.module, round(count(b.col) / count(*), 9) as overlap, count(*)::bigint as kept from a join k using (module) left join (select b.* from "
    "b join k using (module) where place <= k) b using (module, row, col) where a.place <= k group by a.module",
)
def q_mask_overlap(spark, sf):
    return _rounded(ly.mask_overlap(*_masks(spark, sf), 0.5), 9, "overlap")


@query(
    "topk_per_matrix_row",
    f"with {_SQL_MATRIX} select module, row, col, row_number() over (partition by module, row order by abs(w) desc, col)::integer as place "
    "from w qualify place <= 4",
)
def q_topk_per_matrix_row(spark, sf):
    from quillsieve.operators.ordering import top_n

    a, _ = _masks(spark, sf)
    best = top_n(a, [F.col("score").desc(), F.col("col")], 4, ["module", "row"], "place")
    return best.select("module", "row", "col", "place")


@query(
    "overlap_by_layer",
    f"with {SQL_LAYERS}, m as (select layer_no % 3 as dataset, layer, avg(value) as overlap from layers group by all) select layer, "
    "round(avg(overlap) filter (dataset = 0), 6) as d0, round(avg(overlap) filter (dataset = 1), 6) as d1, "
    "round(avg(overlap) filter (dataset = 2), 6) as d2 from m group by layer",
)
def q_overlap_by_layer(spark, sf):
    rows = layers(spark, sf).groupBy((F.col("layer_no") % 3).alias("dataset"), "layer").agg(F.avg("value").alias("overlap"))
    wide = rows.groupBy("layer").pivot("dataset", [0, 1, 2]).agg(F.avg("overlap"))
    return wide.select("layer", *[F.round(F.col(str(i)), 6).alias(f"d{i}") for i in range(3)])


@query(
    "describe_layer",
    f"with {SQL_LAYERS} select method, layer, max(value) as score_max, round(avg(value), 4) as score_mean, min(value) as score_min, "
    "round(median(value), 6) as score_median, round(max(x), 9) as activation_max, round(avg(x), 9) as activation_mean, round(min(x), 9) as "
    "activation_min, round(median(x), 9) as activation_median, round(var_pop(x), 9) as activation_var from layers group by all",
)
def q_describe_layer(spark, sf):
    rows = layers(spark, sf)
    scores = rows.select("method", "layer", F.col("value").alias("x"))
    out = ly.describe_layer(scores, rows.select("method", "layer", "x"))
    names = [f"activation_{s}" for s in ("max", "mean", "min", "median", "var")]
    return _rounded(_rounded(_rounded(out, 9, *names), 4, "score_mean"), 6, "score_median")


@query(
    "topk_mean",
    f"with {SQL_LAYERS}, r as (select layer, value, row_number() over (partition by layer order by value desc, seq, part_no) as p, "
    "greatest(floor(count(*) over (partition by layer) * 0.1::double), 1) as k from layers) select layer, round(avg(value), 4) as "
    "topk_mean, count(*)::bigint as k from r where p <= k group by layer",
)
def q_topk_mean(spark, sf):
    out = ly.topk_mean(layers(spark, sf), 0.1, "layer", "value", ["seq", "part_no"])
    return _rounded(out, 4, "topk_mean")


@query(
    "topk_mean_average",
    f"with {SQL_LAYERS}, r as (select layer, value, row_number() over (partition by layer order by value desc, seq, part_no) as p from layers), "
    "m as (select layer, avg(value) as m from r where p <= 25 group by layer) select round(avg(m), 4) as average, count(*)::bigint as layers from m",
)
def q_topk_mean_average(spark, sf):
    best = ly.topk_mean(layers(spark, sf), 25, "layer", "value", ["seq", "part_no"])
    return best.agg(F.round(F.avg("topk_mean"), 4).alias("average"), F.count(F.lit(1)).alias("layers"))


_SQL_STATS = (
    SQL_LAYERS + ", stats as (select method, layer, avg(value) as mean, var_pop(value) as variance from layers group by all), "
    "diffs as (select t.method, layer, t.mean - r.mean as d, t.variance as va, r.variance as vb, r.mean as ref from stats t join stats r "
    "using (layer) where t.method <> 'random_sample' and r.method = 'random_sample')"
)


def _stats(spark, sf):
    return layers(spark, sf).groupBy("method", "layer").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


@query(
    "diff_vs_reference",
    f"with {_SQL_STATS} select method, layer, round(d, 4) as diff, round(sqrt(d * d + va + vb), 4) as spread, "
    "round(d / (abs(ref) + 1e-8), 9) as relative from diffs",
)
def q_diff_vs_reference(spark, sf):
    out = ly.diff_vs_reference(_stats(spark, sf), "random_sample")
    return _rounded(_rounded(out, 4, "diff", "spread"), 9, "relative")


@query(
    "diff_summary",
    f"with {_SQL_STATS} select method, round(avg(d), 4) as mean_diff, round(sqrt(avg(d * d)), 4) as rmse from diffs group by method",
)
def q_diff_summary(spark, sf):
    return _rounded(ly.diff_summary(ly.diff_vs_reference(_stats(spark, sf), "random_sample")), 4, "mean_diff", "rmse")


@query(
    "median_rel_diff",
    f"with {_SQL_STATS}, r as (select method, d / (abs(ref) + 1e-8) as relative from diffs) select method, round(median(relative), 9) as "
    "median_relative, round(quantile_cont(abs(relative), 0.95), 9) as clip from r group by method",
)
def q_median_rel_diff(spark, sf):
    out = ly.median_rel_diff(pin(ly.diff_vs_reference(_stats(spark, sf), "random_sample")))
    return _rounded(out, 9, "median_relative", "clip")


@query(
    "layer_cosine",
    f"with {SQL_UNITS} select dataset as layer, round(avg(list_dot_product(embedding, list_reverse(embedding)) / "
    "list_dot_product(embedding, embedding)), 9) as cosine from vecs group by dataset",
)
def q_layer_cosine(spark, sf):
    rows = vectors(spark, sf).select(F.col("dataset").alias("layer"), F.col("doc_id").alias("pos"), F.col("embedding").alias("vector"))
    return _rounded(ly.layer_cosine(rows, rows.withColumn("vector", F.reverse("vector"))), 9, "cosine")


@query(
    "pair_stats_join",
    f"with {SQL_LAYERS}, s as (select method, layer, avg(value) as mean, max(value) as top from layers group by all) select a.method as "
    "method_a, b.method as method_b, layer, round(a.mean, 4) as mean_a, a.top as top_a, round(b.mean, 4) as mean_b, b.top as top_b from s a "
    "join s b using (layer) where a.method = 'random_sample' and b.method = 'unique_tokens'",
)
def q_pair_stats_join(spark, sf):
    stats = layers(spark, sf).groupBy("method", "layer").agg(F.avg("value").alias("mean"), F.max("value").alias("top"))
    out = ly.pair_stats_join(stats, [("random_sample", "unique_tokens")])
    return _rounded(out, 4, "mean_a", "mean_b")


@query(
    "layer_range",
    f"with {SQL_LAYERS} select layer_no, count(*)::bigint as n, round(avg(value), 4) as mean from layers where layer_no in (select distinct "
    "layer_no from layers order by layer_no desc limit 3) group by layer_no",
)
def q_layer_range(spark, sf):
    kept = ly.layer_range(layers(spark, sf), 3)
    return kept.groupBy("layer_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(
    "pick_first_mid_last",
    f"with {SQL_LAYERS}, n as (select layer, row_number() over (order by layer) as rank, count(*) over () as total from (select distinct layer "
    "from layers)) select layer, rank::bigint as rank from n where rank in (1, total // 2 + 1, total)",
)
def q_pick_first_mid_last(spark, sf):
    return ly.pick_first_mid_last(layers(spark, sf))


@query(
    "layer_sequence",
    f"with {SQL_LAYERS} select dataset, method, layer, row_number() over (partition by dataset, method order by layer) - 1 as layer_idx from "
    "(select distinct feature % 4 as dataset, method, layer from layers)",
)
def q_layer_sequence(spark, sf):
    return ly.layer_sequence(layers(spark, sf).withColumn("dataset", F.col("feature") % 4))


@query(
    "layer_parts",
    f"with {SQL_LAYERS} select layer, cast(regexp_extract(layer, 'layers?[._](\\d+)', 1) as integer) as idx, split_part(layer, '.', -1) as "
    "component, replace(replace(layer, 'model.layers.', 'L'), '_proj', '') as short_name, count(*)::bigint as n from layers group by all",
)
def q_layer_parts(spark, sf):
    layer = F.col("layer")
    return layers(spark, sf).groupBy("layer").agg(F.count(F.lit(1)).alias("n")).select(
        "layer",
        lb.layer_index(layer).alias("idx"),
        lb.layer_component(layer).alias("component"),
        lb.layer_short(layer).alias("short_name"),
        "n",
    )


@query(
    "key_layer_filter",
    f"with {SQL_LAYERS} select layer, count(*)::bigint as n from layers where regexp_matches(layer, '(a_proj|r_proj)$') group by layer",
)
def q_key_layer_filter(spark, sf):
    kept = layers(spark, sf).where(lb.key_layer(F.col("layer"), "(a_proj|r_proj)$"))
    return kept.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coef_variation",
    f"with {SQL_LAYERS}, s as (select method, layer, avg(value) as m, var_pop(value) as v from layers group by all) select method, layer, "
    "round(sqrt(v) / (m + 1e-8), 6) as cv, round(sqrt(v) / abs(m), 6) as cv_abs from s",
)
def q_coef_variation(spark, sf):
    stats = layers(spark, sf).groupBy("method", "layer").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return stats.select(
        "method",
        "layer",
        F.round(lb.coef_variation(F.col("v"), F.col("m")), 6).alias("cv"),
        F.round(lb.coef_variation(F.col("v"), F.col("m"), True), 6).alias("cv_abs"),
    )
