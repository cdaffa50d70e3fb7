"""The operators of this subpackage as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm.alignment import align_documents
from quillsieve.llm.bpe import encode_documents
from quillsieve.llm.conversation_sql import REPAIR_SQL
from quillsieve.llm.conversations import damage, repair_conversations
from quillsieve.llm.exact_dedup import exact_groups
from quillsieve.llm.fingerprints import fingerprint_documents
from quillsieve.llm.htmltext import extract_pages
from quillsieve.llm.langid import held_out, identify
from quillsieve.llm.licenses import scan_licenses
from quillsieve.llm.minhash import near_duplicates
from quillsieve.llm.mixing import mix_sources
from quillsieve.llm.repeats import remove_repeats
from quillsieve.llm.sharding import assign_shards
from quillsieve.llm.toxicity import FEATURES, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


MIX_SQL = """
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        md5('7:' || coalesce(doc_id::varchar, 'null')) as draw
    from documents),
per_source as (
    select source, sum(size)::bigint as source_size,
        ([3, 1, 2])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
    from sized group by source),
ranked as (
    select *, 3 * sum(source_size) over () as budget, sum(weight) over () as all_weight,
        row_number() over (order by 2 * source_size / weight, source is null, source) as r
    from per_source),
levels as (
    select *, coalesce(sum(2 * source_size) over before, 0) as caps_before,
        coalesce(sum(weight) over before, 0) as weight_before
    from ranked window before as (order by r rows between unbounded preceding and 1 preceding)),
clamps as (
    select *, weight * (budget - 2 * caps_before) > 2 * (2 * source_size) * (all_weight - weight_before) as clamped
    from levels),
level as (
    select (any_value(budget) - 2 * coalesce(sum(2 * source_size) filter (where clamped), 0))::double / 2
        / nullif(sum(weight) filter (where not clamped), 0)::double as level
    from clamps),
targets as (
    select source, source_size,
        case when clamped then (2 * source_size)::double else weight * level end as target
    from clamps, level),
summed as (
    select s.doc_id, s.size, t.source_size::bigint as source_size, t.target, round(t.target)::bigint as want,
        sum(s.size) over (partition by s.source order by draw, s.doc_id, s.size
            rows between unbounded preceding and current row) as upto
    from sized s join targets t on s.source is not distinct from t.source),
timed as (
    select *, case when source_size > 0 then want // source_size else 0 end as times from summed),
given as (
    select *, greatest(0, least(size, want - times * source_size - (upto - size))) as extra from timed)
select doc_id, size, source_size, target, (times * size + extra)::bigint as taken,
    (times + case when extra = size and size > 0 then 1 else 0 end)::bigint as whole,
    (case when extra = size and size > 0 then 0 else extra end)::bigint as part
from given
"""


@query("op7_mix_sources", MIX_SQL)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_key")


EXACT_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
    count(*) over (partition by coalesce(text, '')) as group_size,
    doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
    sha256(coalesce(text, '')) as text_sha256
from documents
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *FEATURES,
    )


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


@query("op11_repeats")
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op12_conversations", REPAIR_SQL)
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), missing=F.col("missing"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_path, piece_path = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_documents(table(spark, sf_dir, "documents"), byte_path, piece_path, public_tokenizers.PATTERN)[0]
