"""Queries that choose or generate rows without greedy rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.functions import vectors as vx
from quillsieve.operators import counts as ct
from quillsieve.operators import generation as gen
from quillsieve.operators import pooling
from quillsieve.operators import selection as sel
from quillsieve.plans.registry import load, query
from quillsieve.plans.tables import (
    SQL_CENTROIDS,
    SQL_COUNTS,
    SQL_TOKENS,
    SQL_UNITS,
    SQL_VECTORS,
    documents,
    sql_plain_words,
    vectors,
)
from quillsieve.session import pin


@query(
    "select_random",
    "select source as dataset, doc_id, row_number() over (partition by source order by md5('42:' || doc_id), doc_id) as rank "
    "from documents qualify rank <= 8",
)
def q_select_random(spark, sf):
    out = sel.select_random(documents(spark, sf), 8)
    return out.select("dataset", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "select_concat",
    "select source as dataset, doc_id as row_id, text from documents union all select 'benchmark', item_id, text from benchmark",
)
def q_select_concat(spark, sf):
    docs = documents(spark, sf).select("dataset", F.col("doc_id").alias("row_id"), "text")
    bench = load(spark, sf, "benchmark").select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("row_id"), "text")
    return sel.select_all(docs, bench)


def _ranked(df):
    return df.select("dataset", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "select_most_similar",
    f"with {SQL_CENTROIDS} select dataset, doc_id, score, row_number() over (partition by dataset order by score desc, doc_id) "
    "as rank from scored qualify rank <= 8",
)
def q_select_most_similar(spark, sf):
    return _ranked(sel.select_most_similar(vectors(spark, sf), 8))


@query(
    "select_most_different",
    f"with {SQL_CENTROIDS} select dataset, doc_id, score, row_number() over (partition by dataset order by score, doc_id) "
    "as rank from scored qualify rank <= 8",
)
def q_select_most_different(spark, sf):
    return _ranked(sel.select_most_different(vectors(spark, sf), 8))


def _sql_quantiles(low: str, high: str, n: int) -> str:
    return (
        f"with {SQL_CENTROIDS}, placed as (select dataset, doc_id, score, "
        "row_number() over (partition by dataset order by score, doc_id) - 1 as place from scored), "
        f"sizes as (select dataset, {low} as lo, {high} as hi from (select dataset, count(*) as n from scored group by dataset)), "
        f"wanted as (select dataset, i + 1 as rank, lo + (i * (hi - lo)) // {n - 1} as place from sizes, range({n}) t(i)) "
        "select dataset, doc_id, score, rank::bigint as rank from wanted join placed using (dataset, place)"
    )


@query("select_distribution_matching", _sql_quantiles("0", "n - 1", 8))
def q_select_distribution_matching(spark, sf):
    return _ranked(sel.select_distribution_matching(vectors(spark, sf), 8))


@query(
    "select_distribution_matching_trimmed",
    _sql_quantiles("floor(n * 0.05::double)::bigint", "least(floor(n * 0.95::double)::bigint, n - 1)", 8),
)
def q_select_distribution_matching_trimmed(spark, sf):
    return _ranked(sel.select_distribution_matching(vectors(spark, sf), 8, trim=0.05))


@query(
    "quantile_pick",
    "with s as (select source as dataset, doc_id, n_chars as score from documents), placed as (select *, "
    "row_number() over (partition by dataset order by score, doc_id) - 1 as place from s), sizes as "
    "(select dataset, count(*) as n from s group by dataset), wanted as (select dataset, i + 1 as rank, "
    "(i * (n - 1)) // 4 as place from sizes, range(5) t(i)) select dataset, doc_id, score, rank::bigint as rank "
    "from wanted join placed using (dataset, place)",
)
def q_quantile_pick(spark, sf):
    docs = load(spark, sf, "documents")
    return _ranked(sel.pick_quantiles(docs.select(F.col("source").alias("dataset"), "doc_id", F.col("n_chars").alias("score")), 5))


@query(
    "return_distribution",
    f"with {SQL_CENTROIDS} select dataset, doc_id, score, "
    "row_number() over (partition by dataset order by score desc, doc_id) <= 8 as selected from scored",
)
def q_return_distribution(spark, sf):
    scored = pin(sel.mean_similarity(vectors(spark, sf)).select("dataset", "doc_id", "score"))
    return sel.with_selection(scored, sel.select_by_score(scored, 8, keys=["dataset"]))


# Sequences of ten vectors each, for the pooled operators.
_SQL_SEQS = (
    "seqs as (select 'all' as dataset, vec_id // 10 as seq, vec_id % 10 as pos, embedding::double[] as embedding, "
    "case when vec_id % 3 <> 2 then 1 else 0 end as mask from embeddings)"
)


def _seqs(spark, sf):
    return load(spark, sf, "embeddings").selectExpr(
        "'all' as dataset",
        "vec_id div 10 as seq",
        "vec_id % 10 as pos",
        "cast(embedding as array<double>) as embedding",
        "case when vec_id % 3 <> 2 then 1 else 0 end as mask",
    )


@query(
    "masked_mean_pool",
    f"with {_SQL_SEQS}, dims as (select seq, mask, unnest(range(len(embedding))) as d, unnest(embedding) as x from seqs) "
    "select seq, d as dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 9) as value from dims group by seq, d",
)
def q_masked_mean_pool(spark, sf):
    pooled = pooling.masked_mean_pool(_seqs(spark, sf))
    flat = pooled.select("seq", F.posexplode("embedding").alias("dim", "value"))
    return flat.select("seq", F.col("dim").cast("bigint").alias("dim"), F.round("value", 9).alias("value"))


_SQL_SEQ_SCORES = (
    ", units as (select seq, len(v) as size, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from whole), "
    "dims as (select size, unnest(range(len(u))) as d, unnest(u) as x from units), "
    "center as (select size, list(m order by d) as c from (select size, d, avg(x) as m from dims group by size, d) group by size), "
    "scored as (select seq, size::bigint as dims, round(list_dot_product(u, c), 9) as score from units join center using (size))"
)


@query(
    "flatten_vectors",
    f"with {_SQL_SEQS}, whole as (select seq, flatten(list(embedding order by pos)) as v from seqs group by seq)"
    + _SQL_SEQ_SCORES
    + " select seq, dims, score from scored",
)
def q_flatten_vectors(spark, sf):
    flat = pooling.flatten_vectors(_seqs(spark, sf), ["dataset", "seq"])
    flat = flat.withColumn("dataset", F.size("embedding").cast("string"))  # vectors of one length are compared
    scored = sel.mean_similarity(flat)
    return scored.select("seq", F.size("embedding").cast("bigint").alias("dims"), "score")


@query(
    "select_pooled_similarity",
    f"with {_SQL_SEQS}, avgs as (select seq, d, avg(x) as m from (select seq, unnest(range(len(embedding))) as d, "
    "unnest(embedding) as x from seqs) group by seq, d), whole as (select seq, list(m order by d) as v from avgs group by seq)"
    + _SQL_SEQ_SCORES
    + ", ranked as (select seq, score, row_number() over (order by score desc, seq) as hi, "
    "row_number() over (order by score, seq) as lo from scored) select 'most_similar' as kind, seq, score, hi as rank from ranked "
    "where hi <= 10 union all select 'most_different', seq, score, lo from ranked where lo <= 10",
)
def q_select_pooled_similarity(spark, sf):
    pooled = pooling.mean_pool(_seqs(spark, sf), ["dataset", "seq"]).withColumnRenamed("seq", "doc_id")
    scored = pin(sel.mean_similarity(pooled).select("dataset", "doc_id", "score"))
    both = [
        sel.select_by_score(scored, 10, low, ["dataset"]).withColumn("kind", F.lit(kind))
        for kind, low in (("most_similar", False), ("most_different", True))
    ]
    return both[0].union(both[1]).select("kind", F.col("doc_id").alias("seq"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "vector_functions",
    f"with {SQL_CENTROIDS}, j as (select doc_id, embedding as e, rc from units join centroids using (dataset)) select doc_id, "
    "round(sqrt(list_dot_product(e, e)), 9) as norm, round(list_dot_product(e, rc), 9) as dot, "
    "round(list_dot_product(e, rc) / sqrt(list_dot_product(e, e) * list_dot_product(rc, rc)), 9) as cosine, "
    "round(list_sum(list_transform(list_zip(e, rc), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as sq_distance from j",
)
def q_vector_functions(spark, sf):
    rows = vectors(spark, sf)
    centers = rows.groupBy("dataset").agg(vx.mean_vector(F.col("embedding")).alias("c"))
    both = sel.join_checked(rows, centers, ["dataset"])
    e, c = F.col("embedding"), F.col("c")
    return both.select(
        "doc_id",
        F.round(vx.l2_norm(e), 9).alias("norm"),
        F.round(vx.dot(e, c), 9).alias("dot"),
        F.round(vx.cosine(e, c), 9).alias("cosine"),
        F.round(vx.squared_distance(e, c), 9).alias("sq_distance"),
    )


_SQL_ZIPF = (
    SQL_COUNTS
    + ", scores as (select doc_id, round(sum(1.0 / n::double), 9) as score from (select distinct doc_id, token from tokens) "
    "join counts using (token) group by doc_id)"
)


@query(
    "select_zipf",
    f"with {_SQL_ZIPF} select doc_id, score, row_number() over (order by score desc, doc_id) as rank from scores "
    "qualify rank <= 128",
)
def q_select_zipf(spark, sf):
    out = sel.select_zipf(documents(spark, sf), 128)
    return out.select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "select_shuffled_zipf",
    f"with {_SQL_ZIPF}, best as (select doc_id, score from scores order by score desc, doc_id limit 64) select doc_id, score, "
    "md5(string_agg(token, ' ' order by md5('42:' || doc_id || ':' || pos), pos)) as digest from best join tokens using (doc_id) "
    "group by doc_id, score",
)
def q_select_shuffled_zipf(spark, sf):
    out = sel.select_shuffled_zipf(documents(spark, sf), 64)
    return out.select("doc_id", "score", F.md5("text").alias("digest"))


@query(
    "score_rank",
    "select doc_id, n_chars as score, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 50",
)
def q_score_rank(spark, sf):
    scored = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    out = sel.select_by_score(scored, 50)
    return out.select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "pool_prefix",
    "select source as dataset, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 40",
)
def q_pool_prefix(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id")
    return sel.pool_prefix(rows, 40).select("dataset", "doc_id")


@query(
    "fraction_subset",
    "with placed as (select source as dataset, doc_id, row_number() over (partition by source order by doc_id) as place, "
    "count(*) over (partition by source) as n from documents), f as (select unnest([0.1::double, 0.25, 0.5, 1.0]) as fraction) "
    "select dataset, doc_id, fraction from placed, f where place <= floor(n * fraction) and floor(n * fraction) >= 8",
)
def q_fraction_subset(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("source").alias("dataset"), "doc_id")
    return sel.fraction_subset(rows, [0.1, 0.25, 0.5, 1.0], at_least=8)


_SQL_SPLIT = (
    SQL_UNITS
    + ", chosen as (select doc_id, embedding, row_number() over (order by md5('42:' || doc_id), doc_id) as rank "
    "from vecs qualify rank <= 50), center as (select list(m order by d) as c from (select d, avg(x) as m from (select "
    "unnest(range(len(embedding))) as d, unnest(embedding) as x from chosen) group by d)), dist as (select doc_id, "
    "round(sqrt(list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as distance "
    "from vecs, center), lim as (select round(avg(distance) + stddev_samp(distance), 9) as lim from dist semi join chosen "
    "using (doc_id)), split as (select doc_id, distance, case when distance <= lim then 'inside' else 'tail' end as part "
    "from dist, lim), ranked as (select doc_id, distance, part, case when part = 'tail' then "
    "row_number() over (partition by part order by distance desc, doc_id) end as rank from split)"
)


def _split(spark, sf):
    rows = vectors(spark, sf).withColumn("dataset", F.lit("all"))
    chosen = sel.select_random(rows, 50).select("doc_id")
    return sel.centroid_split(rows, chosen), rows


@query("centroid_split", f"with {_SQL_SPLIT} select doc_id, distance, part, rank::bigint as rank from ranked")
def q_centroid_split(spark, sf):
    return _split(spark, sf)[0]


@query(
    "incremental_sets",
    f"with {_SQL_SPLIT}, size as (select count(*) as t from ranked where part = 'tail'), chance as (select doc_id, row_number() over (order by "
    "md5('42:' || doc_id), doc_id) as rank from ranked where part = 'tail'), steps as (select i, least(i * 25, t) as added from size, "
    "range(1, 1000) r(i) where (i - 1) * 25 < t), base as (select doc_id from ranked where part = 'inside') select doc_id, 'intersection' as label "
    "from base union all select doc_id, 'tail_add_' || added from base, steps union all select doc_id, 'random_add_' || added from base, steps "
    "union all select doc_id, 'tail_add_' || added from ranked, steps where part = 'tail' and rank <= i * 25 union all select doc_id, "
    "'random_add_' || added from chance, steps where rank <= i * 25",
)
def q_incremental_sets(spark, sf):
    split, rows = _split(spark, sf)
    return sel.incremental_sets(pin(split), rows, 25)


@query(
    "incremental_intervals",
    f"with {_SQL_SPLIT}, size as (select count(*) as t from ranked where part = 'tail'), chance as (select doc_id, row_number() over (order by "
    "md5('42:' || doc_id), doc_id) as rank from ranked where part = 'tail'), grown as (select doc_id, 'tail' as series, rank from ranked where "
    "part = 'tail' union all select doc_id, 'random', rank from chance) select doc_id, null::varchar as series, 0::bigint as added from ranked "
    "where part = 'inside' union all select doc_id, series, least((rank + 24) // 25 * 25, t)::bigint from grown, size",
)
def q_incremental_intervals(spark, sf):
    split, rows = _split(spark, sf)
    return sel.incremental_intervals(pin(split), rows, 25)


def _sql_clusters(k: int, steps: int) -> str:
    parts = [
        SQL_VECTORS,
        "firsts as (select embedding as v, min(doc_id) as doc_id from vecs group by embedding)",
        "c0 as materialized (select row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as c, v from firsts qualify c "
        f"< {k})",
    ]
    distance = "round(list_sum(list_transform(list_zip(embedding, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
    for i in range(steps + 1):
        parts.append(
            f"a{i} as materialized (select doc_id, embedding, c, d from (select doc_id, embedding, c, {distance} as d from vecs, c{i}) "
            "qualify row_number() over (partition by doc_id order by d, c) = 1)"
        )
        parts.append(
            f"m{i} as (select c, list(m order by dim) as m from (select c, dim, round(avg(x), 9) as m from (select c, unnest(range(len("
            f"embedding))) as dim, unnest(embedding) as x from a{i}) group by c, dim) group by c)"
        )
        parts.append(f"c{i + 1} as materialized (select c, coalesce(m, v) as v from c{i} left join m{i} using (c))")
    return (
        "with " + ", ".join(parts) + f", sizes as (select c, count(*) as members from a{steps} group by c) select c::bigint as cluster, doc_id, "
        f"members::bigint as members from a{steps} join sizes using (c) qualify row_number() over (partition by c order by d, doc_id) = 1"
    )


@query("cluster_representatives", _sql_clusters(10, 4))
def q_cluster_representatives(spark, sf):
    return sel.cluster_representatives(vectors(spark, sf), 10, steps=4)


@query(
    "subsample_values",
    "select l_linenumber as layer, l_orderkey, l_partkey, l_suppkey, l_discount as x from lineitem qualify row_number() over ("
    "partition by l_linenumber order by md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey), l_orderkey, l_partkey, "
    "l_suppkey) <= 500",
)
def q_subsample_values(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("layer"), "l_orderkey", "l_partkey", "l_suppkey", F.col("l_discount").alias("x")
    )
    return sel.subsample_values(rows, 500, "layer", ["l_orderkey", "l_partkey", "l_suppkey"])


@query(
    "sample_pairs",
    "with w as (select vec_id as row, unnest(range(len(embedding))) as col, abs(unnest(embedding::double[])) as w from embeddings), "
    "s as (select col, sqrt(avg(w * w)) as s from w group by col), size as (select max(row) + 1 as r, max(col) + 1 as c from w), "
    "draws as (select i as draw, ('0x' || substr(md5('42:r:' || i), 1, 15))::bigint % r as row, "
    "('0x' || substr(md5('42:c:' || i), 1, 15))::bigint % c as col from size, range(100000) t(i) where i < least(100000, r * c)) "
    "select draw, row, col, round(w, 9) as w, round(s, 9) as s from draws left join w using (row, col) left join s using (col)",
)
def q_sample_pairs(spark, sf):
    cells = vectors(spark, sf).select(F.col("doc_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    weights = cells.select("row", F.col("col").cast("bigint").alias("col"), F.abs("x").alias("w"))
    scales = weights.groupBy("col").agg(F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("s"))
    out = sel.sample_pairs(weights, scales, 100_000)
    return out.select("draw", "row", "col", F.round("w", 9).alias("w"), F.round("s", 9).alias("s"))


@query(
    "gen_random_words",
    f"with {SQL_COUNTS}, list as (select token, row_number() over (order by token) - 1 as idx from counts), draws as (select i, "
    "('0x' || substr(md5('42:' || i), 1, 15))::bigint % (select count(*) from list) as idx from range(64 * 128) t(i)) "
    "select (i // 128)::bigint as row_id, md5(string_agg(token, ' ' order by i)) as digest from draws join list using (idx) group by 1",
)
def q_gen_random_words(spark, sf):
    rows = gen.gen_random_words(gen.word_list(documents(spark, sf)), 64, 128)
    return rows.select("row_id", F.md5("text").alias("digest"))


def _sql_bag(table: str, row_id: str, n: int, length: int) -> str:
    words = sql_plain_words()
    return (
        f"with t as (select {row_id} as id, unnest({words}) as token, unnest(range(len({words}))) as pos from {table}), "
        "pool as (select token, row_number() over (order by md5('42:' || id || ':' || pos), id, pos) - 1 as place, "
        f"count(*) over () as total from t), size as (select max(total) as total from pool), dealt as (select i as place, "
        f"i % total as src from size, range({n * length}) r(i)) select (d.place // {length})::bigint as row_id, "
        "md5(string_agg(token, ' ' order by d.place)) as digest from dealt d join pool p on d.src = p.place group by 1"
    )


@query("gen_bag_of_words", _sql_bag("documents", "doc_id", 128, 128))
def q_gen_bag_of_words(spark, sf):
    rows = gen.gen_bag_of_words(documents(spark, sf), 128, 128)
    return rows.select("row_id", F.md5("text").alias("digest"))


@query("gen_bag_of_words_cycled", _sql_bag("benchmark", "item_id", 256, 128))
def q_gen_bag_of_words_cycled(spark, sf):
    bench = load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return gen.gen_bag_of_words(bench, 256, 128).select("row_id", F.md5("text").alias("digest"))


@query(
    "gen_dictionary",
    f"with {SQL_COUNTS}, list as (select token, row_number() over (order by token) - 1 as idx from counts), rows as (select "
    "(idx // 128)::bigint as row_id, list(token order by idx) as ws from list group by 1) select row_id, len(ws)::integer as n_words, "
    "md5(array_to_string(list_concat(ws, list_transform(range(128 - len(ws)), lambda z: '<pad>')), ' ')) as digest from rows",
)
def q_gen_dictionary(spark, sf):
    rows = gen.gen_dictionary(gen.word_list(documents(spark, sf)), 128)
    return rows.select("row_id", "n_words", F.md5("text").alias("digest"))


@query(
    "embedding_lookup",
    f"with {SQL_TOKENS.replace('documents', 'benchmark').replace('doc_id', 'item_id').replace('source as dataset', 'item_id as dataset')}, "
    "counts as (select token, count(*) as n from tokens group by token), vocab as (select token, row_number() over "
    "(order by n desc, token) as token_id from counts), size as (select count(*) as n from embeddings), "
    "coded as (select item_id, pos, token_id from tokens join vocab using (token)), looked as (select item_id, pos, "
    "e.embedding::double[] as v from coded, size join embeddings e on e.vec_id = token_id % size.n) "
    "select item_id as doc_id, count(*)::bigint as n, round(sum(list_sum(v) * (pos + 1)), 6) as checksum from looked group by item_id",
)
def q_embedding_lookup(spark, sf):
    bench = load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    vocab = pin(ct.vocabulary(ct.word_counts(ct.token_rows(bench))))
    table = vectors(spark, sf).withColumnRenamed("doc_id", "token_id").drop("dataset")
    size = table.count()
    ids = ct.encode(bench, vocab).withColumn("ids", F.transform("ids", lambda i: i % size))
    looked = gen.attach_vectors(ids, table)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) * (F.col("pos") + 1)
    return looked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 6).alias("checksum"))


@query("drop_empty_text", "select conv_id, turn from conversations where trim(text) <> '' ")
def q_drop_empty_text(spark, sf):
    return tx.drop_empty_text(load(spark, sf, "conversations")).select("conv_id", "turn")


@query(
    "l2_normalize",
    f"with {SQL_UNITS} select doc_id, unnest(range(len(u))) as dim, round(unnest(u), 9) as value from units",
)
def q_l2_normalize(spark, sf):
    units = vectors(spark, sf).select("doc_id", F.posexplode(vx.l2_normalize(F.col("embedding"))).alias("dim", "value"))
    return units.select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 9).alias("value"))
