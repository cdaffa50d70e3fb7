"""Session settings and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("quillsieve-scope", default=None)


def build_session(master: str = "local[8]", app: str = "quillsieve", **conf: str) -> SparkSession:
    """A session with the settings the plans are tuned for; a cluster passes its own through ``conf``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Joins whose partitions are seen to be small at run time are hashed; larger ones stay sorted and can spill.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # Rank limits are applied before the shuffle up to this rank.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "1000000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local, unset session."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillsieve-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_table(spark: SparkSession, label: str) -> str:
    """A path of its own for a written table in the shared folder, or in the folder of the scope that is open."""
    return f"{_SCOPE.get() or checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what is pinned and written as scratch inside, at the end: results must be stored or collected by then."""
    path = f"{checkpoint_root(spark)}/scope-{uuid.uuid4().hex}"
    before = _SCOPE.set(path)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a table in the shared folder, so later reads agree and survive lost executors.

    A written table, unlike a checkpoint, is columnar: later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "pinned")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
