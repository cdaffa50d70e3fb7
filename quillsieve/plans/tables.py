"""Record shapes the operators expect, derived from the given tables, with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import WHITESPACE
from quillsieve.plans.registry import load, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), "lang", "text")
    return spread(docs, "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, dataset, embedding``: the vectors in double precision."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("set"), F.col("label").cast("string")).alias("dataset"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def sql_zipf_words(text: str = "text") -> str:
    return (
        f"list_filter(string_split_regex(lower(translate({text}, '.,', '  ')), '{WHITESPACE}'), lambda w: w <> '')"
    )


def sql_plain_words(text: str = "text") -> str:
    return f"list_filter(string_split_regex(lower({text}), '{WHITESPACE}'), lambda w: w <> '')"


SQL_DOCS = f"docs as (select doc_id, source as dataset, text, {sql_zipf_words()} as words from documents)"
SQL_TOKENS = (
    SQL_DOCS
    + ", tokens as (select doc_id, dataset, unnest(words) as token, unnest(range(len(words))) as pos from docs)"
)
SQL_COUNTS = SQL_TOKENS + ", counts as (select token, count(*) as n from tokens group by token)"
SQL_VECTORS = (
    "vecs as (select vec_id as doc_id, 'set' || label as dataset, embedding::double[] as embedding from embeddings)"
)
SQL_UNITS = (
    SQL_VECTORS
    + ", units as (select doc_id, dataset, embedding, list_transform(embedding, "
    + "lambda x: x / sqrt(list_dot_product(embedding, embedding))) as u from vecs)"
)
SQL_CENTROIDS = (
    SQL_UNITS
    + ", dims as (select dataset, unnest(range(len(u))) as d, unnest(u) as x, unnest(embedding) as r from units)"
    + ", centroids as (select dataset, list(m order by d) as c, list(mr order by d) as rc from "
    + "(select dataset, d, avg(x) as m, avg(r) as mr from dims group by dataset, d) group by dataset)"
    + ", scored as (select doc_id, dataset, embedding, u, round(list_dot_product(u, c), 9) as score "
    + "from units join centroids using (dataset))"
)

# Long result rows from the order tables; every expression reads the same in Spark and in DuckDB.
FACT_COLUMNS = {
    "row_id": "o_orderkey",
    "model": "r_name",
    "task": "case o_orderpriority when '1-URGENT' then 'arc_challenge' when '2-HIGH' then 'gsm8k' "
    "when '3-MEDIUM' then 'mmlu_history' when '5-LOW' then 'boolq' else 'xquad_es' end",
    "metric": "case o_orderkey % 3 when 0 then 'acc,none' when 1 then 'acc_norm,none' else 'acc_stderr,none' end",
    "pruning_type": "case o_orderstatus when 'F' then 'unique_tokens' when 'O' then 'random_sample' "
    "else 'most_similar' end",
    "calibration_datasets": "case c_mktsegment when 'AUTOMOBILE' then 'c4' when 'BUILDING' then 'gsm8k' "
    "when 'FURNITURE' then 'wmt14_boolq' when 'HOUSEHOLD' then 'opc' end",
    "pruned_value": "case when o_orderkey % 17 <> 0 then o_totalprice / 1000003e0 end",
    "original_value": "cast(substr(o_orderpriority, 1, 1) as double) / 100e0 + 5e-1",
    "nsamples": "case o_orderkey % 4 when 0 then 16 when 1 then 128 when 2 then 512 else 1024 end",
    "compression_type": "case when o_custkey % 2 = 0 then 'pruning' else 'quantization' end",
    "sparsity": "case when o_custkey % 3 = 0 then 25e-2 else 5e-1 end",
}
SQL_FACTS = (
    "facts as (select "
    + ", ".join(f"{e} as {n}" for n, e in FACT_COLUMNS.items())
    + " from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
    + " join region on n_regionkey = r_regionkey)"
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    joined = (
        load(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.selectExpr(*[f"{e} as {n}" for n, e in FACT_COLUMNS.items()])


# Layer values from the line items.
LAYER_COLUMNS = {
    "method": "case l_linestatus when 'F' then 'random_sample' else 'unique_tokens' end",
    "layer": "concat('model.layers.', cast(l_linenumber as varchar(9)), '.mlp.', lower(l_returnflag), '_proj')",
    "layer_no": "l_linenumber",
    "feature": "l_suppkey % 64",
    "seq": "l_orderkey",
    "part_no": "l_partkey",
    "x": "(l_discount - 5e-2) / 1000003e-6",
    "value": "l_extendedprice / 1000003e-6",
}
SQL_LAYERS = "layers as (select " + ", ".join(f"{e} as {n}" for n, e in LAYER_COLUMNS.items()) + " from lineitem)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in LAYER_COLUMNS.items()])
