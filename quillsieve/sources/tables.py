"""Result tables and stored counts and selections on disk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

# Column names of result files that come without a header.
BASELINE_COLUMNS = ("task", "metric", "value", "model", "pruning_type", "sampling", "nsamples", "sparsity", "datasets")
RESULT_PATH = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
# A field of a line and what ends it; quoted fields may hold commas and quotes after a backslash.
FIELD = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"(?=,|$)|[^,]*+)(?:,|$)'
PATH_COLUMNS = ("model", "method", "nsamples", "dataset")


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_results_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """A result file as strings, blanks around names and values removed; ``names`` if it has no header."""
    if names is None:
        rows = spark.read.option("header", "true").csv(path)
        rows = rows.toDF(*[c.strip() for c in rows.columns])
    else:
        rows = spark.read.schema(_strings(names)).csv(path)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def _fields(line: Column) -> Column:
    """The fields of a line, without quotes and blanks around them; what is empty and not quoted is null."""

    def value(field: Column) -> Column:
        quoted = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('\\"'), F.lit('"'))
        return F.trim(F.when(field.startswith('"'), quoted).otherwise(F.nullif(field, F.lit(""))))

    return F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(1)), value)


def scan_result_tree(
    spark: SparkSession, root: str, needed: Sequence[str] = ("model", "task", "metric", "original_value")
) -> DataFrame:
    """First value of every (model, task, metric) over all result files below ``root`` that have the columns.

    Files come in order of their path, rows in order of their place in the file. Each file's first line says where its columns
    are; lines are split into fields and meet the places of their file in a join, so files of any number of layouts take
    one plan, and no header or path reaches the driver. A file that lacks a column is left out.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        .withColumn("line", F.monotonically_increasing_id())
    )
    headers = pin(lines.where("start = 0").groupBy("path").agg(F.min_by("value", "line").alias("header")))
    named = headers.select("path", _fields(F.col("header")).alias("names"))
    places = named.select("path", *[F.array_position("names", c).cast("int").alias(f"at{i}") for i, c in enumerate(needed)])
    places = pin(places.where(F.least(*[F.coalesce(f"at{i}", F.lit(0)) for i in range(len(needed))], F.lit(1)) > 0))
    if places.isEmpty():
        raise FileNotFoundError(f"no result file below {root} has the columns {list(needed)}")
    found = join_checked(lines.withColumn("fields", _fields(F.col("value"))), places, ["path"], pinned=True)
    whole = found.select(
        *[F.get("fields", F.col(f"at{i}") - 1).alias(c) for i, c in enumerate(needed)],
        F.struct("path", "start", "line").alias("place"),
    )
    value = needed[-1]
    # a header's own last name is no number, so header lines go with the rows without one
    kept = whole.withColumn(value, F.col(value).try_cast("double")).dropna(subset=[value])
    return kept.groupBy(*needed[:-1]).agg(F.min_by(value, "place").alias(value))


def path_partitions(rows: DataFrame, names: Sequence[str] = PATH_COLUMNS, pattern: str = RESULT_PATH) -> DataFrame:
    """The last folders of each row's file path as columns."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return rows.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def append_results(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a shared table; every task writes files of its own, so writers need no lock."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def save_token_counts(counts: DataFrame, path: str, model: str, dataset: str, label: str, n: int) -> None:
    """Store a counter under its key, replacing an earlier one."""
    key = {"model": model, "dataset": dataset, "label": label, "n": n}
    rows = counts.select("token", F.col("n").alias("count"), *[F.lit(v).alias(k) for k, v in key.items()])
    # Spark escapes what a folder name cannot hold; only this key's folder is replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)


def load_token_counts(spark: SparkSession, path: str, **key: str | int) -> DataFrame:
    """Stored counters; only the folders of the given key parts are read."""
    rows = spark.read.parquet(path)
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def fingerprint(rows: DataFrame, **params: object) -> str:
    """A key of the rows' content, whatever their order, and of the parameters."""
    columns = sorted(rows.columns)
    parts = rows.select(
        F.xxhash64(*columns).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit("salt"), *columns).cast("decimal(38,0)").alias("b")
    )
    sums = parts.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    named = ",".join(f"{k}={params[k]}" for k in sorted(params))
    text = ":".join([*[str(s) for s in sums], *columns, named])
    return rows.sparkSession.range(1).select(F.md5(F.lit(text))).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def selection_store(rows: DataFrame, root: str, select: Callable[[DataFrame], DataFrame], **params: object) -> DataFrame:
    """A selection read back if the same rows and parameters were selected before, else made and stored."""
    spark = rows.sparkSession
    path = f"{root}/{fingerprint(rows, **params)}"
    if not _exists(spark, path):
        select(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def partitioned_report(rows: DataFrame, path: str, by: Sequence[str] = ("compression_type", "model", "nsamples")) -> None:
    """One folder per combination of ``by``, written by one plan; a large combination is split over tasks."""
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
