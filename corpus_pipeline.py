"""From raw documents to tokens: language, exact copies, near copies, mixture, tokens.

Each stage works on all rows that the one before kept, is written as Parquet in the shared folder and read again. All but
the last return the columns of the documents they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.llm.bpe import encode_documents
from quillsieve.llm.exact_dedup import exact_groups
from quillsieve.llm.langid import fit, held_out, in_known_language
from quillsieve.llm.minhash import near_duplicates, text_key
from quillsieve.llm.mixing import mix_sources
from quillsieve.session import scratch_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text whose best language has a lower posterior is in no language that is known.
LEAST_SCORE = 0.5
#: Names of columns that stand beside those of the documents for a while.
_ID, _NONE, _TEXT, _TIMES, _FOUND = "__row_id", "__row_null", "__row_text", "__row_times", "__row_place"


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def _decided(docs: DataFrame, decisions: DataFrame, hashed: Column) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (``doc_id, key, times``) keeps, with ``__times``.

    The names of its columns do not meet those of the documents, ids and texts may be null, and of rows that repeat both
    id and text the one whose other columns come first stays. The join and the choice deal texts out by the same columns,
    so they are shuffled once.
    """
    keys = [_ID, _NONE, _TEXT]

    def keyed(df: DataFrame, key: Column) -> DataFrame:
        own = F.col("doc_id")
        return df.withColumns({_ID: F.coalesce(own.cast("string"), F.lit("")), _NONE: own.isNull(), _TEXT: key})

    wanted = keyed(decisions, F.col("key")).groupBy(*keys).agg(F.sum("times").alias(_TIMES))
    joined = keyed(docs, hashed).join(wanted, keys)
    others = [F.col(f"`{name}`") for name in docs.columns if name not in ("doc_id", "text")]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*others or [F.lit(0)]))
    return joined.withColumn(_FOUND, place).where(F.col(_FOUND) == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or with no clear language go."""
    model = fit(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    return in_known_language(docs, model, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    kept = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("key"), F.lit(1).alias("times"))
    hashed = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return _decided(docs, kept, hashed).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    kept = near_duplicates(docs).where("kept").select("doc_id", F.col("text_key").alias("key"), F.lit(1).alias("times"))
    return _decided(docs, kept, text_key(docs["text"])).select(*_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them whole; a part of at least half of a document counts as one more.

    Rows that repeat are taken as often as all of them together.
    """
    more = (F.col("part") * 2 >= F.greatest("size", F.lit(1))).cast("bigint")
    taken = mix_sources(docs).select("doc_id", F.col("text_key").alias("key"), (F.col("whole") + more).alias("times"))
    kept = _decided(docs, taken.where("times > 0"), F.xxhash64(docs["text"]))
    repeated = kept.withColumn(_TIMES, F.explode(F.sequence(F.lit(1), F.col(_TIMES).cast("int"))))
    return repeated.select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mixture holds, with what they decode to."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language scores, weighted signatures and token ids cannot be said in SQL; the tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
