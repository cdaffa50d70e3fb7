"""Incremental counts, moments and appends as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators import counts as ct
from quillsieve.session import scratch_table


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 512) -> DataFrame:
    """A parquet table as a stream of its files, old ones first: a folder to which files are added, or one file."""
    schema = spark.read.parquet(path).schema
    # a stream takes a plain path for a folder; a pattern may match a file as well
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def append_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Append what ``make`` gives for every batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    _run(stream, write, checkpoint)


def stream_word_counts(stream: DataFrame, path: str, checkpoint: str, merged: Sequence[str] = ("token",)) -> DataFrame:
    """Word counts kept as mergeable counts per batch, summed when read.

    The vocabulary never has to fit a state store, and a batch costs no more than its own words.
    """
    append_batches(stream, path, checkpoint, lambda batch: ct.word_counts(ct.token_rows(batch)))
    counted = stream.sparkSession.read.parquet(path)
    return counted.groupBy(*merged).agg(F.sum("n").alias("n"))


def stream_running_moments(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Running sums, sums of squares, largest absolute value and count per key, updated per batch.

    The state is one row per key; every batch replaces the published table by a new version.
    """
    totals = stream.groupBy(*keys).agg(
        F.sum("x").alias("sum_x"),
        F.sum(F.col("x") * F.col("x")).alias("sum_sq"),
        F.max(F.abs("x")).alias("max_abs"),
        F.count("x").alias("n"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    _run(totals, write, checkpoint, "complete")
    versions = stream.sparkSession.read.parquet(path)
    latest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == latest).drop("version")


def stream_results_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Result rows appended once each, however often a batch is retried."""
    append_batches(stream, path, checkpoint)
    return stream.sparkSession.read.parquet(path)


def job_folders(spark: SparkSession, label: str) -> tuple[str, str]:
    """A table folder and a checkpoint folder for one run of a job."""
    base = scratch_table(spark, label)
    return f"{base}/table", f"{base}/checkpoint"
