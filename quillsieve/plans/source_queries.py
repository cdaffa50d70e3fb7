"""Queries of sources, sinks, streams, text rules and the dispatcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import counts as ct
from quillsieve.operators import dispatch
from quillsieve.operators import selection as sel
from quillsieve.plans.greedy_queries import sql_distance, sql_picks
from quillsieve.plans.registry import load, query
from quillsieve.plans.tables import SQL_CENTROIDS, SQL_COUNTS, SQL_DOCS, SQL_FACTS, SQL_LAYERS, documents, facts, vectors
from quillsieve.session import scratch_table
from quillsieve.sources import corpora as cp
from quillsieve.sources import tables as tb
from quillsieve.streaming import jobs


@query(
    "corpus_registry",
    "select 'c4' as dataset, 'train' as split, count(*)::bigint as n, sum(length(text))::bigint as chars from documents",
)
def q_corpus_registry(spark, sf):
    """Reads a corpus written in the layout of its registered location."""
    root = scratch_table(spark, "corpora")
    location, config = cp.corpus_registry("c4")
    docs = documents(spark, sf).select("doc_id", "text")
    docs.write.parquet(f"{root}/{location}/{config}/train")
    load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id").write.parquet(f"{root}/{location}/{config}/validation")
    rows = cp.read_corpus(spark, "c4", root, "train")
    return rows.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("discover_files", "select 'c4' as corpus, 'parquet' as format, count(*)::bigint as n from documents union all select 'mine', 'json', count(*) from benchmark")
def q_discover_files(spark, sf):
    root = scratch_table(spark, "corpora")
    documents(spark, sf).select("doc_id", "text").write.parquet(f"{root}/c4")
    load(spark, sf, "benchmark").write.json(f"{root}/mine")
    files = cp.discover_files(spark, root)
    corpus = F.when(cp.split_by_path(F.col("path"), root, "mine"), "mine").otherwise("c4")
    kinds = files.groupBy(corpus.alias("corpus")).agg(F.max(cp.choose_format(F.col("path"))).alias("format"))
    whole = spark.read.parquet(f"{root}/c4").select(F.lit("c4").alias("corpus")).union(
        spark.read.json(f"{root}/mine").select(F.lit("mine"))
    )
    return whole.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).join(kinds, "corpus")


@query(
    "choose_format",
    "select 'parquet' as format, count(*)::bigint as n from documents union all select 'json', count(*)::bigint from benchmark",
)
def q_choose_format(spark, sf):
    """A folder that holds both formats is read whole."""
    root = scratch_table(spark, "mixed")
    bench = load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("json").alias("kind"))
    bench.write.json(f"{root}/mixed/a")
    documents(spark, sf).select("doc_id", "text").write.parquet(f"{root}/mixed/b")
    rows = cp.read_corpus(spark, "mixed", root)
    return rows.groupBy(F.coalesce("kind", F.lit("parquet")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_by_path",
    "select 'validation' as split, sum((doc_id % 10 = 9)::int)::bigint as n from documents union all select 'train', sum((doc_id % 10 <> 9)::int)::bigint "
    "from documents",
)
def q_split_by_path(spark, sf):
    root = scratch_table(spark, "splits")
    docs = documents(spark, sf).select("doc_id", "text")
    docs.where("doc_id % 10 <> 9").write.parquet(f"{root}/corpus/train")
    docs.where("doc_id % 10 = 9").write.parquet(f"{root}/corpus/validation")
    parts = [cp.read_corpus(spark, "corpus", root, split) for split in ("train", "validation")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_SQL_SPLITS = (
    "s as (select distinct source as dataset, doc_id % 4 as ordinal, case doc_id % 4 when 0 then 'dev_matched' when 1 then 'train_r1' when 2 "
    "then 'train_r2' else 'validation' end as split from documents), r as (select unnest(['train', 'validation', 'test', 'dev']) as requested)"
)


@query(
    "resolve_split",
    f"with {_SQL_SPLITS} select dataset, requested, arg_min(split, (case when split = requested then 0 when requested in ('train', 'validation', "
    "'test') and contains(split, requested) then 1 else 2 end) * 10 + ordinal) as split from s, r group by all",
)
def q_resolve_split(spark, sf):
    names = F.array(F.lit("dev_matched"), F.lit("train_r1"), F.lit("train_r2"), F.lit("validation"))
    splits = documents(spark, sf).select(
        "dataset", (F.col("doc_id") % 4).alias("ordinal"), F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("split")
    ).distinct()
    asked = F.explode(F.array(*[F.lit(x) for x in ("train", "validation", "test", "dev")])).alias("requested")
    return cp.resolve_split(splits.select("*", asked))


@query(
    "prefer_split",
    "with d as (select source as dataset, doc_id, doc_id % 5 as ordinal, case when source in ('src1', 'src2') then case doc_id % 2 when 0 then "
    "'test' else 'validation' end when source = 'src3' then 'extra' else case doc_id % 3 when 0 then 'train' when 1 then 'validation' else "
    "'test' end end as split from documents), b as (select dataset, arg_min(split, (case split when 'train' then 0 when 'test' then 1 else 2 end) "
    "* 10 + ordinal) as split from d group by dataset) select dataset, split, doc_id from d join b using (dataset, split)",
)
def q_prefer_split(spark, sf):
    usual = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    split = (
        F.when(F.col("dataset").isin("src1", "src2"), F.when(F.col("doc_id") % 2 == 0, "test").otherwise("validation"))
        .when(F.col("dataset") == "src3", "extra")
        .otherwise(usual)
    )
    rows = documents(spark, sf).select("dataset", "doc_id", (F.col("doc_id") % 5).alias("ordinal"), split.alias("split"))
    return cp.prefer_split(rows).select("dataset", "split", "doc_id")


@query("skip_take", "select doc_id, n_chars from documents order by doc_id offset 50 limit 100")
def q_skip_take(spark, sf):
    path = scratch_table(spark, "piece")
    cp.skip_take(load(spark, sf, "documents").select("doc_id", "n_chars"), 50, 100).write.parquet(path)
    return spark.read.parquet(path)


@query("bounded_nonempty_scan", "select conv_id, turn, md5(text) as digest from conversations where trim(text) <> '' order by conv_id, turn limit 60")
def q_bounded_nonempty_scan(spark, sf):
    rows = cp.bounded_nonempty_scan(load(spark, sf, "conversations"), 60, order=("conv_id", "turn"))
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"))


_SQL_FACT_SUMS = "select model, task, count(*)::bigint as n, round(sum(pruned_value), 6) as total from facts group by all"


@query("read_results_csv", f"with {SQL_FACTS} {_SQL_FACT_SUMS}")
def q_read_results_csv(spark, sf):
    """Written with blanks around every value, once with and once without a header, half of the rows each."""
    root = scratch_table(spark, "csv")
    rows = facts(spark, sf).select("row_id", "model", "task", "pruned_value")
    padded = rows.select("row_id", *[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" ")).alias(f" {c}") for c in rows.columns[1:]])
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    padded.where("row_id % 2 = 0").drop("row_id").write.options(header="true", **options).csv(f"{root}/a")
    padded.where("row_id % 2 = 1").drop("row_id").write.options(**options).csv(f"{root}/b")
    both = tb.read_results_csv(spark, f"{root}/a").unionByName(tb.read_results_csv(spark, f"{root}/b", rows.columns[1:]))
    numbers = both.withColumn("pruned_value", F.col("pruned_value").try_cast("double"))
    return numbers.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pruned_value"), 6).alias("total"))


@query(
    "scan_result_tree",
    f"with {SQL_FACTS}, f as (select model, task, metric, row_id, row_id / 1000003e0 as original_value, case when row_id % 2 = 0 then 'a' else 'b' end "
    "as folder from facts where row_id % 5 <> 0) select model, task, metric, round(arg_min(original_value, (folder, row_id)), 9) as "
    "original_value from f group by all",
)
def q_scan_result_tree(spark, sf):
    root = scratch_table(spark, "tree")
    value = F.when(F.col("row_id") % 5 != 0, F.col("row_id") / 1000003.0).alias("original_value")
    rows = facts(spark, sf).select("row_id", "model", "task", "metric", value)
    for folder, part in (("a", rows.where("row_id % 2 = 0")), ("b", rows.where("row_id % 2 = 1"))):
        kept = part.select("original_value", "row_id", "task", "model", "metric") if folder == "b" else part
        # several files whose names are in the order of their rows
        kept.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("header", "true").csv(f"{root}/{folder}")
    rows.select("model", "task").write.option("header", "true").csv(f"{root}/c")
    found = tb.scan_result_tree(spark, root)
    return found.withColumn("original_value", F.round("original_value", 9))


@query("path_partitions", f"with {SQL_FACTS} select model, pruning_type as method, nsamples::varchar as nsamples, count(*)::bigint as n from facts group by all")
def q_path_partitions(spark, sf):
    root = scratch_table(spark, "paths")
    rows = facts(spark, sf).select("model", "pruning_type", "nsamples", "row_id")
    rows.write.partitionBy("model", "pruning_type", "nsamples").parquet(root)
    read = spark.read.option("recursiveFileLookup", "true").parquet(root)
    lifted = tb.path_partitions(read, ("model", "method", "nsamples"), r"/model=([^/]+)/pruning_type=([^/]+)/nsamples=([^/]+)/[^/]+$")
    return lifted.groupBy("model", "method", "nsamples").agg(F.count(F.lit(1)).alias("n"))


@query("append_results", f"with {SQL_FACTS} {_SQL_FACT_SUMS}")
def q_append_results(spark, sf):
    path = scratch_table(spark, "appended")
    rows = facts(spark, sf).select("row_id", "model", "task", "pruned_value")
    for part in ("row_id % 2 = 0", "row_id % 2 = 1"):
        tb.append_results(rows.where(part), path, ["model"])
    back = spark.read.parquet(path)
    return back.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pruned_value"), 6).alias("total"))


@query("token_count_store", f"with {SQL_COUNTS} select token, n::bigint as count from counts")
def q_token_count_store(spark, sf):
    path = scratch_table(spark, "counts")
    full = ct.word_counts(ct.token_rows(documents(spark, sf)))
    tb.save_token_counts(full, path, "org/plain", "documents", "full", 0)
    tb.save_token_counts(ct.word_counts(ct.token_rows(load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))), path, "org/plain", "benchmark", "full", 0)
    return tb.load_token_counts(spark, path, model="org/plain", dataset="documents", label="full").select("token", "count")


@query(
    "selection_store",
    "select source as dataset, doc_id, row_number() over (partition by source order by md5('42:' || doc_id), doc_id)::integer as rank from documents "
    "qualify rank <= 4",
)
def q_selection_store(spark, sf):
    root = scratch_table(spark, "selections")
    docs = documents(spark, sf).select("dataset", "doc_id")
    first = tb.selection_store(docs, root, lambda d: sel.select_random(d, 4), name="random_sample", n=4)
    again = tb.selection_store(docs, root, lambda d: d.where(F.lit(False)).withColumn("rank", F.lit(0)), name="random_sample", n=4)
    return again.join(first, again.columns, "left_semi")


@query(
    "partitioned_report",
    f"with {SQL_FACTS} select compression_type, model, nsamples, task, pruning_type, round(avg(pruned_value), 9) as mean_value from facts group by all",
)
def q_partitioned_report(spark, sf):
    path = scratch_table(spark, "report")
    keys = ["compression_type", "model", "nsamples", "task", "pruning_type"]
    tb.partitioned_report(facts(spark, sf).groupBy(*keys).agg(F.avg("pruned_value").alias("mean_value")), path)
    return spark.read.parquet(path).select(*keys, F.round("mean_value", 9).alias("mean_value"))


def _raw_items(spark, sf):
    """Rows of many datasets in one table; fields a dataset lacks are null."""
    t = {n: load(spark, sf, n) for n in ("documents", "benchmark", "conversations", "events", "labels", "part", "supplier", "customer", "nation", "pages")}

    def rows(table, name, key, **fields):
        return t[table].select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("item"), *[v.alias(k) for k, v in fields.items()])

    c, s = F.col, lambda x: F.col(x).cast("string")
    english = F.struct(F.get_json_object("props", "$.k").alias("en"), c("event_type").alias("de"))
    parts = [
        rows("documents", "c4", "doc_id", text=c("text")),
        rows("documents", "mc4_es", "doc_id", text=c("text")),
        rows("benchmark", "gsm8k", "item_id", question=c("text")),
        rows("conversations", "boolq", "conv_id", passage=c("text"), question=c("role")),
        rows("labels", "anli_r1", "doc_id", premise=s("quality")),
        rows("labels", "xnli_zh", "doc_id", premise=s("quality"), hypothesis=s("toxic")),
        rows("supplier", "svamp", "s_suppkey", Body=c("s_name"), Question=s("s_nationkey")),
        rows("customer", "xcopa_zh", "c_custkey", premise=c("c_name"), choice1=c("c_mktsegment"), choice2=s("c_nationkey")),
        rows("nation", "hellaswag", "n_nationkey", ctx=c("n_name"), activity_label=s("n_regionkey")),
        rows("part", "arc_challenge", "p_partkey", question=c("p_name"), choices=F.struct(F.array("p_brand", "p_type").alias("text"))),
        rows("events", "wmt14", "event_id", translation=english),
        rows("pages", "ds1000", "page_id", prompt=c("url")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


@query(
    "extract_text",
    "with u as (select 'c4' as dataset, doc_id::varchar as item, text from documents union all select 'mc4_es', doc_id::varchar, text from documents "
    "union all select 'gsm8k', item_id::varchar, text from benchmark union all select 'boolq', conv_id::varchar, text || ' ' || role from "
    "conversations union all select 'anli_r1', doc_id::varchar, quality || ' ' from labels union all select 'xnli_zh', doc_id::varchar, quality || "
    "' ' || toxic from labels union all select 'svamp', s_suppkey::varchar, s_name || ' ' || s_nationkey from supplier union all select 'xcopa_zh', "
    "c_custkey::varchar, c_name || ' ' || c_mktsegment || ' ' || c_nationkey from customer union all select 'hellaswag', n_nationkey::varchar, "
    "n_name || ' ' || n_regionkey from nation union all select 'arc_challenge', p_partkey::varchar, p_name || ' ' || p_brand || ' ' || p_type from "
    "part union all select 'wmt14', event_id::varchar, json_extract_string(props, '$.k') from events union all select 'ds1000', page_id::varchar, "
    "url from pages) select dataset, item, md5(text) as digest from u",
)
def q_extract_text(spark, sf):
    return _raw_items(spark, sf).select("dataset", "item", F.md5(tx.extract_text(_raw_items(spark, sf))).alias("digest"))


@query(
    "extract_text_fallback",
    "select page_id, case page_id % 5 when 0 then 't' || page_id when 1 then 's' || page_id when 2 then 'p' || page_id when 3 then url else "
    "'{\"page_id\":' || page_id || '}' end as text, case page_id % 5 when 0 then 't' || page_id when 1 then 's' || page_id when 2 then 'p' || page_id "
    "when 3 then url else '' end as embedder_text from pages",
)
def q_extract_text_fallback(spark, sf):
    kind = F.col("page_id") % 5

    def only(place, value):
        return F.when(kind == place, value)

    key = F.col("page_id").cast("string")
    rows = load(spark, sf, "pages").select(
        "page_id",
        only(0, F.concat(F.lit("t"), key)).alias("text"),
        only(1, F.concat(F.lit("s"), key)).alias("sentence"),
        only(2, F.concat(F.lit("p"), key)).alias("prompt"),
        only(3, F.col("url")).alias("question"),
    )
    return rows.select("page_id", tx.fallback_text(rows).alias("text"), tx.embedder_text(rows).alias("embedder_text"))


@query("stream_word_counts", f"with {SQL_COUNTS} select token, n::bigint as n from counts")
def q_stream_word_counts(spark, sf):
    stream = jobs.read_stream(spark, f"{sf}/documents.parquet")
    return jobs.stream_word_counts(stream, *jobs.job_folders(spark, "word-counts"))


@query(
    "stream_running_moments",
    f"with {SQL_LAYERS} select layer_no as layer, feature, round(sum(x), 9) as sum_x, round(sum(x * x), 9) as sum_sq, round(max(abs(x)), 9) as max_abs, "
    "count(x)::bigint as n from layers group by all",
)
def q_stream_running_moments(spark, sf):
    stream = jobs.read_stream(spark, f"{sf}/lineitem.parquet").selectExpr(
        "l_linenumber as layer", "l_suppkey % 64 as feature", "(l_discount - 5e-2) / 1000003e-6 as x"
    )
    out = jobs.stream_running_moments(stream, *jobs.job_folders(spark, "moments"), ["layer", "feature"])
    return out.withColumns({c: F.round(c, 9) for c in ("sum_x", "sum_sq", "max_abs")})


@query("stream_results_append", "select event_id, user_id, event_type, value from events")
def q_stream_results_append(spark, sf):
    stream = jobs.read_stream(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return jobs.stream_results_append(stream, *jobs.job_folders(spark, "results")).select(*stream.columns)


@query("tokenizer_hook", "select doc_id, len(string_split(text, ' '))::bigint as n_words from documents")
def q_tokenizer_hook(spark, sf):
    """Any array column takes the place of the default words; here a plain split at blanks."""
    words = F.split("text", " ")
    return ct.token_rows(documents(spark, sf), words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


@query("embedder_hook", f"with {SQL_DOCS} select dataset, doc_id, len(words)::double as total from docs")
def q_embedder_hook(spark, sf):
    """Hashed word counts as vectors: whatever the hash, the counts of a text add up to its words."""
    hashed = dispatch.hashed_vectors(documents(spark, sf))
    return hashed.select("dataset", "doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    "scorer_hook",
    "select 'all' as dataset, doc_id, row_number() over (order by n_chars, doc_id)::integer as rank, md5(text) as digest from "
    "documents qualify rank <= 64",
)
def q_scorer_hook(spark, sf):
    lengths = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    docs = documents(spark, sf).withColumn("dataset", F.lit("all"))
    out = dispatch.prepare_selection(docs, "least_perplexity", 64, scorer=lambda d: d.join(lengths, "doc_id"))
    return out.select("dataset", "doc_id", "rank", F.md5("text").alias("digest"))


def _sql_prepare(pool: int, steps: int, vectors: str = SQL_CENTROIDS) -> str:
    parts = [
        vectors,
        f"pool as materialized (select doc_id, 'all' as dataset, embedding from scored qualify row_number() over (partition by dataset order by "
        f"score desc, doc_id) <= {pool})",
        "m0 as materialized (select dataset, doc_id, embedding, 'inf'::double as m from pool)",
        "p0 as materialized (select dataset, doc_id, embedding, 0.0::double as m from m0 order by doc_id limit 1)",
    ]
    for i in range(1, steps):
        parts.append(
            f"m{i} as materialized (select v.dataset, v.doc_id, v.embedding, least(v.m, {sql_distance('v.embedding', 'p.embedding')}) as m from "
            f"m{i - 1} v join p{i - 1} p using (dataset) where v.doc_id <> p.doc_id)"
        )
        parts.append(f"p{i} as materialized (select dataset, doc_id, embedding, m from m{i} order by m desc, doc_id limit 1)")
    return "with " + ", ".join(parts) + f" select doc_id, rank::integer as rank from ({sql_picks(steps, 'm')})"


@query("prepare_selection", _sql_prepare(6, 6))
def q_prepare_selection(spark, sf):
    rows = vectors(spark, sf)
    docs = rows.select("dataset", "doc_id", F.lit("").alias("text"))
    return dispatch.prepare_selection(docs, "most_similar", 6, vectors=rows).select("doc_id", "rank")


_SQL_TWO_SETS = SQL_CENTROIDS.replace("'set' || label as dataset", "case when vec_id % 2 = 0 then 'even' else 'odd' end as dataset")


@query(
    "prepare_selection_two_sets",
    f"select case when doc_id % 2 = 0 then 'even' else 'odd' end as dataset, doc_id // 2 as doc_id, rank from ({_sql_prepare(6, 6, _SQL_TWO_SETS)})",
)
def q_prepare_selection_two_sets(spark, sf):
    """Two datasets whose ids both begin at 0."""
    rows = vectors(spark, sf).withColumn("dataset", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    rows = rows.withColumn("doc_id", F.expr("doc_id div 2"))
    docs = rows.select("dataset", "doc_id", F.lit("").alias("text"))
    return dispatch.prepare_selection(docs, "most_similar", 6, vectors=rows).select("dataset", "doc_id", "rank")


_SQL_STRATEGY_NAMES = ", ".join(f"'{name}'" for name in sorted({*dispatch.STRATEGIES, *dispatch.GENERATED} - {"dictionary"}))


@query(
    "strategy_registry",
    f"with {SQL_COUNTS} select unnest([{_SQL_STRATEGY_NAMES}]) as strategy, 4::bigint as n union all select 'dictionary', "
    "ceil(count(*) / 128)::bigint from counts",
)
def q_strategy_registry(spark, sf):
    """Every named strategy over the documents of the corpus, by the number of rows it gives."""
    docs = documents(spark, sf).select(F.lit("documents").alias("dataset"), "doc_id", "text")
    hashed = sel.pin(dispatch.hashed_vectors(docs))
    whole = None
    for name, rows in dispatch.prepare_selections(docs, sorted({*dispatch.STRATEGIES, *dispatch.GENERATED}), 4, vectors=hashed).items():
        part = rows.select(F.lit(name).alias("strategy"), "doc_id")
        whole = part if whole is None else whole.union(part)
    return whole.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
