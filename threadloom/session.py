"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Page and post times carry no zone and are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages differ in size by orders of magnitude, so bound Arrow batches by bytes too.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call on a session somebody else made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_local_dirs: dict[str, str] = {}


def workdir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by the session.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="threadloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[context.applicationId] = path
    return _local_dirs[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a plan needs an expensive input (parsed pages) more than once: readers get column pruning, and a lost
    executor costs a re-read instead of a second parse.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
