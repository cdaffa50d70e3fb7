"""Queries that compare samples, measure coverage and score texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import counts as ct
from quillsieve.operators import distribution as dist
from quillsieve.operators import generation as gen
from quillsieve.operators import greedy, packing, perplexity, reports, spectral
from quillsieve.operators import selection as sel
from quillsieve.plans.registry import load, query
from quillsieve.plans.select_queries import _SQL_ZIPF
from quillsieve.plans.tables import SQL_CENTROIDS, SQL_COUNTS, SQL_DOCS, SQL_UNITS, documents, sql_zipf_words, vectors
from quillsieve.session import pin


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "kl_divergence",
    f"with {_SQL_ZIPF}, chosen as (select 'zipf' as method, doc_id from (select doc_id from scores order by score desc, doc_id limit 64) "
    "union all select 'random_sample', doc_id from (select doc_id from documents qualify row_number() over (partition by source order by "
    "md5('42:' || doc_id), doc_id) <= 8)), sub as (select method, token, count(*) as n from tokens join chosen using (doc_id) group by all), "
    "grid as (select method, token, coalesce(c.n, 0)::double as p0, coalesce(s.n, 0)::double as q0 from (select method, token from sub union "
    "select m.method, token from counts, (select distinct method from sub) m) u left join counts c using (token) left join sub s using "
    "(method, token)), pq as (select method, p0 / sum(p0) over (partition by method) as p, q0 / sum(q0) over (partition by method) + 1e-10 "
    "as q1 from grid), pr as (select method, p, q1 / sum(q1) over (partition by method) as q from pq) "
    "select method, round(sum(case when p > 0 then p * ln(p / q) else 0 end), 7) as kl from pr group by method",
)
def q_kl_divergence(spark, sf):
    docs = documents(spark, sf)
    bags, counts = sel.word_rarity(docs)
    chosen = sel.select_by_score(sel.rarity_of_bags(bags, counts), 64).select(F.lit("zipf").alias("method"), "doc_id").union(
        sel.select_random(docs, 8).select(F.lit("random_sample"), "doc_id")
    )
    picked = sel.join_checked(bags.select("doc_id", "items", "counts"), chosen, ["doc_id"])
    return _rounded(dist.kl_divergence(counts, ct.bag_counts(picked, ["method"])), 7, "kl")


@query(
    "zipf_curve",
    f"with {SQL_COUNTS}, r as (select token, n, row_number() over (order by n desc, token) as rank from counts) select token, n::bigint as n, "
    "rank::bigint as rank, round(n / sum(n) over (), 12) as frequency, round((1.0::double / rank) / sum(1.0::double / rank) over (), 12) as "
    "ideal from r",
)
def q_zipf_curve(spark, sf):
    return _rounded(dist.zipf_curve(ct.word_counts(ct.token_rows(documents(spark, sf)))), 12, "frequency", "ideal")


_SQL_VALUES = (
    "vals as (select user_id % 5 as layer, value as x, case when event_type = 'click' then 'a' else 'b' end as side from events)"
)
_SQL_MERGED = (
    _SQL_VALUES
    + ", d as (select layer, x, sum((side = 'a')::int) as na, sum((side = 'b')::int) as nb from vals group by layer, x), "
    "m as (select layer, x, lead(x) over w - x as dx, abs(sum(na) over w / sum(na) over (partition by layer) - "
    "sum(nb) over w / sum(nb) over (partition by layer)) as gap, sum(na) over (partition by layer) as ta, "
    "sum(nb) over (partition by layer) as tb from d window w as (partition by layer order by x))"
)


def _values(spark, sf, layer=None):
    rows = load(spark, sf, "events")
    side = F.when(F.col("event_type") == "click", "a").otherwise("b")
    layer = F.col("user_id") % 5 if layer is None else layer
    return rows.select(layer.alias("layer"), F.col("value").alias("x"), side.alias("side"))


@query("wasserstein_1d", f"with {_SQL_MERGED} select layer, round(sum(gap * coalesce(dx, 0)), 9) as wasserstein from m group by layer")
def q_wasserstein_1d(spark, sf):
    found = dist.two_sample_distances(_values(spark, sf))
    return _rounded(found, 9, "wasserstein").select("layer", "wasserstein")


_P_VALUE = (
    "case when s < 0.01 then 1.0::double else least(greatest(list_sum(list_transform(range(1, 101), lambda k: "
    "case when k % 2 = 1 then 2.0::double else -2.0::double end * exp(-2.0::double * k * k * s))), 0.0::double), 1.0::double) end"
)


@query(
    "ks_two_sample",
    f"with {_SQL_MERGED}, k as (select layer, max(gap) as ks, max(ta) as ta, max(tb) as tb from m group by layer), "
    "z as (select *, ks * ks * ta * tb / (ta + tb) as s from k) select layer, round(ks, 9) as ks, ta::bigint as n_a, tb::bigint as n_b, "
    f"round({_P_VALUE}, 9) as p_value from z",
)
def q_ks_two_sample(spark, sf):
    found = dist.two_sample_distances(_values(spark, sf), exact_rows=0)
    return _rounded(found, 9, "ks", "p_value").select("layer", "ks", "n_a", "n_b", "p_value")


# Lane i of a list is the chance of having taken i - 1 values of the smaller sample after t steps, with the edge never reached.
_SQL_PATHS = (
    "k as (select layer, max(gap) as ks, max(ta)::bigint as n_a, max(tb)::bigint as n_b from m group by layer having max(gap) is not null), "
    "p as (select layer, least(n_a, n_b) as m, greatest(n_a, n_b) as n, round(ks * n_a * n_b)::bigint as reach from k), "
    "walk as (select layer, m, n, reach, 0::bigint as t, list_transform(range(m + 1), lambda i: case when i = 0 then 1.0::double else 0.0::double end) "
    "as inside, 0.0::double as past from p union all select layer, m, n, reach, t + 1, list_transform(moved, lambda x, i: case when "
    "abs((i - 1) * n - (t + 2 - i) * m) >= reach then 0.0::double else x end), past + list_sum(list_transform(moved, lambda x, i: case when "
    "abs((i - 1) * n - (t + 2 - i) * m) >= reach then x else 0.0::double end)) from (select *, list_transform(list_zip(inside, "
    "list_prepend(0.0::double, inside[:-2])), lambda z, i: (z[1] * (n - t + i - 1) + z[2] * (m - i + 2)) / (m + n - t)) as moved from walk "
    "where t < m + n))"
)


@query(
    "ks_exact",
    f"with recursive {_SQL_MERGED.replace('user_id % 5', 'user_id')}, {_SQL_PATHS} select k.layer, round(ks, 9) as ks, n_a, n_b, "
    "round(case when reach = 0 then 1.0::double else least(past, 1.0::double) end, 9) as p_value from k join walk w on w.layer = k.layer and w.t = w.m + w.n",
)
def q_ks_exact(spark, sf):
    values = _values(spark, sf, F.col("user_id"))
    found = dist.two_sample_distances(values).where(F.col("ks").isNotNull())
    return _rounded(found, 9, "ks", "p_value").select("layer", "ks", "n_a", "n_b", "p_value")


def _sql_moments(side: str) -> str:
    x = f"(case when side = '{side}' then x end)"
    mean = f"avg({x})"
    second = f"(avg({x} * {x}) - {mean} * {mean})"
    third = f"(avg({x} * {x} * {x}) - 3 * {mean} * avg({x} * {x}) + 2 * {mean} * {mean} * {mean})"
    return (
        f"round({mean}, 9) as mean_{side}, max{x} as max_{side}, min{x} as min_{side}, "
        f"round({third} / pow({second}, 1.5), 6) as skew_{side}, round(kurtosis_pop{x}, 6) as kurtosis_{side}"
    )


_PAIR_SQL = f"{_sql_moments('a')}, {_sql_moments('b')}"


@query(
    "pair_describe",
    f"with {_SQL_VALUES} select layer, {_PAIR_SQL}, round(avg(case when side = 'a' then x end) - avg(case when side = 'b' then x end), 9) as "
    "mean_diff, max(case when side = 'a' then x end) - max(case when side = 'b' then x end) as max_diff from vals group by layer",
)
def q_pair_describe(spark, sf):
    found = dist.pair_describe(_values(spark, sf))
    found = _rounded(found, 9, "mean_a", "mean_b", "mean_diff")
    return _rounded(found, 6, "skew_a", "skew_b", "kurtosis_a", "kurtosis_b")


_SQL_NEAR = (
    SQL_UNITS
    + ", sample as (select dataset, doc_id, u, embedding from units qualify row_number() over (partition by dataset order by "
    "md5('42:' || doc_id), doc_id) <= 8), near as (select a.dataset, a.doc_id, 1 - max(list_dot_product(a.u, b.u)) as distance "
    "from units a join sample b using (dataset) group by all)"
)


def _sample(rows):
    return sel.with_rows(sel.select_random(rows, 8).select("dataset", "doc_id"), rows, ["dataset", "doc_id"])


@query("nearest_neighbor", f"with {_SQL_NEAR} select dataset, doc_id, round(distance, 9) as distance from near")
def q_nearest_neighbor(spark, sf):
    rows = vectors(spark, sf)
    found = dist.nearest_neighbor(rows, _sample(rows)).withColumn("distance", F.round("distance", 9))
    return found.select("dataset", "doc_id", F.when(F.col("distance") == 0, 0.0).otherwise(F.col("distance")).alias("distance"))


def _sql_center(source: str, name: str) -> str:
    return (
        f"{name} as (select dataset, list(m order by d) as c from (select dataset, d, avg(x) as m from (select dataset, "
        f"unnest(range(len(embedding))) as d, unnest(embedding) as x from {source}) group by dataset, d) group by dataset)"
    )


@query(
    "coverage_metrics",
    f"with {_SQL_NEAR}, {_sql_center('vecs', 'ca')}, {_sql_center('sample', 'cb')}, cd as (select dataset, 1 - "
    "list_dot_product(ca.c, cb.c) / sqrt(list_dot_product(ca.c, ca.c) * list_dot_product(cb.c, cb.c)) as g from ca join cb using (dataset)) "
    "select dataset, round(avg(distance), 9) as mean_distance, round(max(distance), 9) as max_distance, round(max(g), 9) as "
    "centroid_distance from near join cd using (dataset) group by dataset",
)
def q_coverage_metrics(spark, sf):
    rows = vectors(spark, sf)
    return _rounded(dist.coverage_metrics(rows, _sample(rows)), 9, "mean_distance", "max_distance", "centroid_distance")


_SQL_X = "v as (select event_type as kind, value as x from events)"


def _kinds(spark, sf):
    return load(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("x"))


@query("ecdf", f"with {_SQL_X} select distinct kind, x, round(cume_dist() over (partition by kind order by x), 12) as share from v")
def q_ecdf(spark, sf):
    return _rounded(dist.ecdf(_kinds(spark, sf), ["kind"]), 12, "share")


@query(
    "histogram",
    f"with {_SQL_X}, s as (select kind, min(x) as lo, max(x) as hi, count(*) as total from v group by kind), b as (select kind, "
    "least(floor((x - lo) / ((hi - lo) / 20)), 19)::bigint as bin, total, (hi - lo) / 20 as width from v join s using (kind)) "
    "select kind, bin, count(*)::bigint as n, round(count(*) / (max(total) * max(width)), 9) as density from b group by kind, bin",
)
def q_histogram(spark, sf):
    return _rounded(dist.histogram(_kinds(spark, sf), ["kind"], 20), 9, "density")


@query(
    "density_grid",
    f"with {_SQL_X}, s as (select kind, min(x) as lo, max(x) as hi, count(*) as total, stddev_samp(x) * pow(count(*), -0.2) as w from v "
    "group by kind), g as (select kind, lo, hi, total, w, p as point, lo + (hi - lo) * p / 63.0::double as grid_x from s, range(64) t(p)) "
    "select kind, point::integer as point, round(grid_x, 9) as grid_x, round(sum(exp(-0.5 * ((grid_x - x) / w) * ((grid_x - x) / w))) / "
    "(max(total) * max(w) * sqrt(2 * pi())), 9) as density from g join v using (kind) group by kind, point, grid_x",
)
def q_density_grid(spark, sf):
    return _rounded(dist.density(_kinds(spark, sf), ["kind"], 64), 9, "grid_x", "density")


_SQL_LM = (
    SQL_DOCS
    + ", bi as materialized (select doc_id, words[i] as a, words[i + 1] as b from (select doc_id, words, unnest(range(1, len(words))) as i "
    "from docs)), ab as materialized (select a, b, count(*) as n from bi group by a, b), s as materialized (select a, sum(n) as n from ab "
    "group by a), v as (select count(distinct w) as v from (select unnest(words) as w from docs)), lm as materialized (select a, b, "
    "-ln((ab.n + 1) / (s.n + v.v)) as nll from ab join s using (a), v), ppl as (select doc_id, avg(nll) as m, count(*) as n from bi join "
    "lm using (a, b) group by doc_id)"
)


def _lm(spark, sf):
    rows = documents(spark, sf).select("doc_id", tx.zipf_words(F.col("text")).alias("words"))
    pairs = perplexity.pair_counts(rows)
    return pairs, perplexity.train(pairs)


@query("ngram_perplexity", f"with {_SQL_LM} select doc_id, round(exp(m), 6) as score from ppl")
def q_ngram_perplexity(spark, sf):
    return perplexity.ngram_perplexity(*_lm(spark, sf))


@query(
    "perplexity_unseen",
    f"with {SQL_DOCS}, bi as materialized (select words[i] as a, words[i + 1] as b from (select words, unnest(range(1, len(words))) as i from "
    "docs)), ab as materialized (select a, b, count(*) as n from bi group by a, b), s as materialized (select a, sum(n) as n from ab group by a), "
    "v as (select count(distinct w) as v from (select unnest(words) as w from docs)), "
    f"tests as (select item_id, {sql_zipf_words()} as words from benchmark), tb as (select item_id, words[i] as a, words[i + 1] as b from (select "
    "item_id, words, unnest(range(1, len(words))) as i from tests)) select item_id, round(exp(avg(-ln((coalesce(ab.n, 0) + 1) / "
    "(coalesce(s.n, 0) + v.v)))), 6) as score from tb left join ab using (a, b) left join s using (a), v group by item_id",
)
def q_perplexity_unseen(spark, sf):
    """Trained on one table and scored on another, most of whose bigrams the model has not seen."""
    _, model = _lm(spark, sf)
    rows = load(spark, sf, "benchmark").select("item_id", tx.zipf_words(F.col("text")).alias("words"))
    return perplexity.ngram_perplexity(perplexity.pair_counts(rows, ("item_id",)), model, ("item_id",))


@query(
    "select_lowest_score",
    f"with {_SQL_LM} select doc_id, round(exp(m), 6) as score, row_number() over (order by round(exp(m), 6), doc_id) as rank from ppl "
    "qualify rank <= 128",
)
def q_select_lowest_score(spark, sf):
    out = sel.select_by_score(perplexity.ngram_perplexity(*_lm(spark, sf)), 128, ascending=True)
    return out.select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "corpus_perplexity",
    f"with {_SQL_LM}, flat as (select unnest(words) as w, doc_id, unnest(range(len(words))) as pos from docs), placed as (select w, "
    "row_number() over (order by doc_id, pos) - 1 as off from flat), wins as (select off // 512 as win, off, w as a, lead(w) over "
    "(partition by off // 512 order by off) as b, count(*) over (partition by off // 512) as size from placed), wb as (select win, a, b from "
    "wins where size = 512 and b is not null), wn as materialized (select a, b, count(*) as n from wb group by a, b), ws as (select a, "
    "sum(n) as n from wn group by a), wv as (select count(distinct a) as v from (select a from wins where size = 512)), wl as (select a, b, "
    "-ln((wn.n + 1) / (ws.n + wv.v)) as nll from wn join ws using (a), wv), per as (select win, avg(nll) as m, count(*) as n from wb join wl "
    "using (a, b) group by win) select round(exp(avg(m)), 6) as perplexity, round(exp(sum(n * m) / sum(n)), 6) as weighted_perplexity, "
    "count(*)::bigint as windows from per",
)
def q_corpus_perplexity(spark, sf):
    words = F.transform(tx.zipf_words(F.col("text")), lambda w: F.xxhash64(w))
    rows = pin(documents(spark, sf).select("doc_id", words.alias("words")))
    pairs = perplexity.pair_counts(packing.pack_windows(rows, 512), ("window",))
    found = perplexity.corpus_perplexity(pairs, perplexity.train(pairs))
    return _rounded(found, 6, "perplexity", "weighted_perplexity")


@query("spectral_summary")
def q_spectral_summary(spark, sf):
    found = spectral.spectral_summary(vectors(spark, sf))
    return _rounded(found, 6, *[c for c in found.columns if c != "dataset"])


@query(
    "spectral_frobenius",
    f"with {SQL_UNITS} select dataset, round(sqrt(sum(list_dot_product(embedding, embedding))), 6) as frobenius from vecs group by dataset",
)
def q_spectral_frobenius(spark, sf):
    return _rounded(spectral.spectral_summary(vectors(spark, sf)), 6, "frobenius").select("dataset", "frobenius")


@query("subspace_overlap")
def q_subspace_overlap(spark, sf):
    rows = vectors(spark, sf)
    chosen = sel.select_random(rows, 24).select("dataset", "doc_id")
    part = sel.with_rows(chosen, rows, ["dataset", "doc_id"])
    return _rounded(spectral.subspace_overlap(rows, part, 8), 6, "overlap")


@query(
    "mean_pairwise_similarity",
    f"with {SQL_UNITS} select a.dataset, count(distinct a.doc_id)::bigint + 1 as n, round(avg(list_dot_product(a.u, b.u)), 9) as similarity "
    "from units a join units b on a.dataset = b.dataset and a.doc_id < b.doc_id group by a.dataset",
)
def q_mean_pairwise_similarity(spark, sf):
    return _rounded(dist.mean_pairwise_similarity(vectors(spark, sf)), 9, "similarity")


def _sql_chosen(part: str) -> str:
    order = {
        "random_sample": "md5('42:' || doc_id), doc_id",
        "prototype": "score desc, doc_id",
        "most_different": "score, doc_id",
    }
    return " union all ".join(
        f"select '{m}' as method, dataset, doc_id from {part} qualify row_number() over (partition by dataset order by {o}) <= 8"
        for m, o in order.items()
    )


_METHODS = ("random_sample", "prototype", "most_different")


@query(
    "zipf_selection_report",
    f"with {SQL_CENTROIDS}, chosen as materialized ({_sql_chosen('scored')}), near as (select c.method, a.dataset, a.doc_id, 1 - "
    "max(list_dot_product(a.u, b.u)) as distance from units a join chosen c using (dataset) join units b on b.doc_id = c.doc_id group by all), "
    "cov as (select method, dataset, avg(distance) as mean_distance, max(distance) as max_distance from near group by all), "
    f"{_sql_center('vecs', 'ca')}, cb as (select method, dataset, list(m order by d) as c from (select method, dataset, d, avg(x) as m from "
    "(select method, dataset, unnest(range(len(embedding))) as d, unnest(embedding) as x from chosen join vecs using (dataset, doc_id)) group "
    "by method, dataset, d) group by method, dataset), cd as (select method, dataset, 1 - list_dot_product(ca.c, cb.c) / "
    "sqrt(list_dot_product(ca.c, ca.c) * list_dot_product(cb.c, cb.c)) as g from ca join cb using (dataset)), both_sides as (select method, "
    "dataset, score as x, 1 as a, 0 as b from scored, (select distinct method from chosen) union all select method, dataset, score, 0, 1 from "
    "chosen join scored using (dataset, doc_id)), d as (select method, dataset, x, sum(a) as na, sum(b) as nb from both_sides group by all), "
    "m as (select method, dataset, lead(x) over w - x as dx, abs(sum(na) over w / sum(na) over (partition by method, dataset) - sum(nb) over w "
    "/ sum(nb) over (partition by method, dataset)) as gap from d window w as (partition by method, dataset order by x)), "
    "w1 as (select method, dataset, sum(gap * coalesce(dx, 0)) as w from m group by all) select dataset, method, round(w, 9) as wasserstein, "
    "round(mean_distance, 9) as mean_distance, round(max_distance, 9) as max_distance, round(g, 9) as centroid_distance from w1 join cov "
    "using (method, dataset) join cd using (method, dataset)",
)
def q_zipf_selection_report(spark, sf):
    found = reports.selection_report(vectors(spark, sf), 8, _METHODS)
    return _rounded(found, 9, "wasserstein", "mean_distance", "max_distance", "centroid_distance")


_SQL_SCALED = (
    "vecs as (select vec_id as doc_id, 'all' as dataset, list_transform(embedding::double[], lambda x: x * (1 + vec_id % 7)) as embedding "
    "from embeddings)"
)


@query(
    "norm_shift_report",
    "with "
    + _SQL_SCALED
    + SQL_CENTROIDS[SQL_CENTROIDS.index(", units as") :]
    + f", chosen as materialized ({_sql_chosen('scored')}), norms as (select doc_id, round(sqrt(list_dot_product(embedding, embedding)), 9) as x "
    "from vecs), both_sides as (select method, x, 1 as a, 0 as b from norms, (select distinct method from chosen) union all select method, x, "
    "0, 1 from chosen join norms using (doc_id)), d as (select method, x, sum(a) as na, sum(b) as nb from both_sides group by all), m as "
    "(select method, lead(x) over w - x as dx, abs(sum(na) over w / sum(na) over (partition by method) - sum(nb) over w / sum(nb) over "
    "(partition by method)) as gap from d window w as (partition by method order by x)), w1 as (select method, sum(gap * coalesce(dx, 0)) as w "
    "from m group by all) select method, round(max(w), 7) as wasserstein, round(avg(x), 7) as mean_norm from w1 join chosen using (method) "
    "join norms using (doc_id) group by method",
)
def q_norm_shift_report(spark, sf):
    scale = 1 + F.col("doc_id") % 7
    scaled = F.zip_with("embedding", F.array_repeat(scale, F.size("embedding")), lambda x, s: x * s)
    rows = vectors(spark, sf).withColumn("embedding", scaled)
    return _rounded(reports.norm_shift_report(rows, 8, None, _METHODS), 7, "wasserstein", "mean_norm")


@query(
    "selection_timing",
    "with f(fraction) as (values (0.25::double), (1.0::double)), parts as (select fraction, source, floor(count(*) * fraction)::bigint as "
    "used from documents, f group by fraction, source), whole as (select fraction, sum(used)::bigint as n_used, sum(least(used, 8))::bigint as picks from parts "
    "group by fraction) select 'zipf' as method, fraction, n_used, least(n_used, 128)::bigint as n_chosen from whole union all select "
    "'words_dataset', fraction, n_used, 128::bigint from whole union all select 'unique_tokens', fraction, n_used, picks from whole",
)
def q_selection_timing(spark, sf):
    """Rows that each method reads and gives; the seconds it takes are the operator's fifth column."""
    docs = documents(spark, sf).select("dataset", "doc_id", "text")
    methods = {
        "zipf": lambda d: sel.select_zipf(d, 128),
        "words_dataset": lambda d: gen.gen_bag_of_words(d, 128),
        "unique_tokens": lambda d: greedy.select_unique_tokens(d, 8),
    }
    return reports.selection_timing(docs, methods, (0.25, 1.0)).drop("selection_time_s")
