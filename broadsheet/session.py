"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and time pinned to UTC.

    Partition counts are left to the cluster's own settings; pass them in
    ``conf`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Written copies go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a
    cluster session without it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="broadsheet-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_small_input(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer splits than the cluster.

    A corpus of any size has more splits than cores and passes through
    unchanged, so no text is shuffled there.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Bytes of rows that go to a Python worker at one time.
ARROW_BYTES = 4 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """From now on Arrow batches to Python workers end at ``ARROW_BYTES``, or at the session's own lower bound.

    Spark's default lets up to 10,000 rows into one, whole texts among them.  Each
    task has such a batch in the JVM, outside its heap, and another in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark.conf.get(name, None) or ""
    kept = int(text) if text.isdecimal() else 0
    if not 0 < kept <= ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)
