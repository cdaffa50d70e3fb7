"""Where corpora lie, which files and splits are read, and bounded reads of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import drop_empty_text
from quillsieve.operators.skew import join_checked

# Location and configuration of the known corpora.
CORPORA: dict[str, tuple[str, str | None]] = {
    "c4": ("allenai/c4", "en"),
    "wikitext": ("wikitext", "wikitext-103-raw-v1"),
    "oscar": ("oscar-corpus/OSCAR-2301", "en"),
    "oscar_es": ("oscar-corpus/OSCAR-2301", "es"),
    "oscar_zh": ("oscar-corpus/OSCAR-2301", "zh"),
    "mc4_es": ("mc4", "es"),
    "mc4_zh": ("mc4", "zh"),
    "pile": ("monology/pile-uncopyrighted", None),
    "gsm8k": ("gsm8k", "main"),
    "svamp": ("ChilleD/SVAMP", None),
    "anli_r1": ("facebook/anli", None),
    "rte": ("aps/super_glue", "rte"),
    "boolq": ("google/boolq", None),
    "commonsense_qa": ("tau/commonsense_qa", None),
    "race": ("race", "all"),
    "winogrande": ("allenai/winogrande", "winogrande_xl"),
    "wmt14": ("wmt/wmt14", "de-en"),
    "arc_challenge": ("ai2_arc", "ARC-Challenge"),
    "hellaswag": ("Rowan/hellaswag", None),
    "mmlu": ("cais/mmlu", "all"),
    "xnli_es": ("xnli", "es"),
    "xnli_zh": ("xnli", "zh"),
    "xwinograd_zh": ("Muennighoff/xwinograd", "zh"),
    "xcopa_zh": ("xcopa", "zh"),
    "xquad_es": ("xquad", "xquad.es"),
    "xquad_zh": ("xquad", "xquad.zh"),
}
FILE_PATTERN = "{*.json*,*.jsonl*,*.parquet,*.parquet.zst,*.zst}"
FILE_PATTERNS = {"parquet": "*.parquet*", "json": "{*.json*,*.zst}"}
KNOWN_SPLITS = ("train", "validation", "test")
# Orders in which a missing split is replaced.
SPLIT_ORDERS = {
    "train_test": ("train", "test"),
    "train_validation": ("train", "validation"),
    "train_validation_test": ("train", "validation", "test"),
    "train_test_validation": ("train", "test", "validation"),
}


def corpus_registry(name: str) -> tuple[str, str | None]:
    """Location and configuration of a corpus; an unknown name is its own location."""
    return CORPORA.get(name, (name, None))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """Data files below ``root``, each once; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", FILE_PATTERN)
        .load(root)
    )
    return listed.select("path").distinct()


def choose_format(path: Column) -> Column:
    """Format of a file by its name."""
    return F.when(path.contains(".parquet"), "parquet").otherwise("json")


def split_by_path(path: Column, root: str, split: str) -> Column:
    """Whether a part of the path below ``root`` names the split; folders above it do not count."""
    below = F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), f"{root.rstrip('/')}/", -1)
    return F.exists(F.split(below, "/"), lambda part: part.contains(split))


def read_corpus(spark: SparkSession, name: str, root: str, split: str | None = None) -> DataFrame:
    """The files of a corpus below ``root``, as one table with its name and split.

    Files of both formats are read, columns that one lacks are null there. If no path names the split, all files are
    its files. Which files there are is asked by name; paths are never gathered, and the reader skips unwanted ones.
    """
    location, config = corpus_registry(name)
    base = f"{root.rstrip('/')}/{location}"
    listed = discover_files(spark, base)
    wanted: list[Callable[[Column], Column]] = []
    for part in (config, split):
        if part and not listed.where(split_by_path(F.col("path"), base, part)).isEmpty():
            wanted.append(lambda path, part=part: split_by_path(path, base, part))
    tables = []
    for kind in ("parquet", "json"):
        if listed.where(choose_format(F.col("path")) == kind).isEmpty():
            continue
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", FILE_PATTERNS[kind])
        rows = reader.format(kind).load(base)
        for condition in wanted:
            rows = rows.where(condition(F.col("_metadata.file_path")))
        tables.append(rows)
    if not tables:
        raise FileNotFoundError(f"no data files for {name} below {base}")
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True)
    return rows.withColumns({"dataset": F.lit(name), "split": F.lit(split or "train")})


def resolve_split(splits: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """The split to read for a requested one. ``splits``: keys, requested, ordinal, split.

    The split itself, else for the usual three the first that contains the name, else the first.
    """
    usual = F.col("requested").isin(*KNOWN_SPLITS)
    priority = (
        F.when(F.col("split") == F.col("requested"), 0).when(usual & F.col("split").contains(F.col("requested")), 1).otherwise(2)
    )
    best = F.min_by("split", F.struct(priority.alias("p"), F.col("ordinal").alias("o")))
    return splits.groupBy(*keys, "requested").agg(best.alias("split"))


def prefer_split(rows: DataFrame, order: Sequence[str] = SPLIT_ORDERS["train_test"], keys: Sequence[str] = ("dataset",), fallback: str = "ordinal") -> DataFrame:
    """Rows of each dataset's preferred split: the first of ``order`` that exists, else its first split."""
    priority = F.lit(len(order))
    for place, split in reversed(list(enumerate(order))):
        priority = F.when(F.col("split") == split, place).otherwise(priority)
    best = rows.groupBy(*keys).agg(F.min_by("split", F.struct(priority.alias("p"), F.col(fallback).alias("o"))).alias("split"))
    return join_checked(rows, best, [*keys, "split"])


def skip_take(rows: DataFrame, skip: int, take: int, order: str = "doc_id") -> DataFrame:
    """``take`` rows after the first ``skip``, in order of the id."""
    return rows.orderBy(order).offset(skip).limit(take)


def bounded_nonempty_scan(rows: DataFrame, limit: int, text: str = "text", order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first ``limit`` rows that hold text."""
    return drop_empty_text(rows, text).orderBy(*order).limit(limit)
