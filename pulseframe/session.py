"""Session settings and the reliable cut of lineage used by multi-pass operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings that can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot stay or variable is split even when the split costs one more shuffle
    # (a join followed by a grouping on the same key).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Row limits per group (event caps, window draws) are applied before the shuffle up to this size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}


def get_spark(app: str = "pulseframe", master: str | None = None, **conf) -> SparkSession:
    """Build a session. On a cluster the master and the memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_CONF,
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used on a local master only: a folder of one machine
    would lose data with that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        wanted = tempfile.mkdtemp(prefix="pulseframe-")
    context.setCheckpointDir(wanted)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table the caller writes and reads back."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it reliably, so later passes read it and never recompute it.

    A DataFrame that came from here is returned as it is.
    """
    if getattr(df, "_settled", False):
        return df
    shared_dir(df.sparkSession)
    stored = df.checkpoint()
    stored._settled = True
    return stored


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside leave no shuffle files: they are removed as each query ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored_size(df: DataFrame) -> tuple[int, int]:
    """Rows of a settled DataFrame and about how many bytes they hold, measured once."""
    if getattr(df, "_size", None) is None:
        texts = []
        for name, kind in df.dtypes:
            if kind == "string":
                texts.append(F.octet_length(name))
            elif kind.startswith(("array", "map", "struct")):
                texts.append(F.octet_length(F.to_json(F.struct(name))))
        measures = [F.count(F.lit(1)), *[F.coalesce(F.sum(t), F.lit(0)) for t in texts]]
        rows, *lengths = df.agg(*measures).first()
        df._size = rows, rows * 8 * len(df.columns) + sum(lengths)
    return df._size
