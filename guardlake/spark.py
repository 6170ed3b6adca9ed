"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "guardlake", cores: str = "*", **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", "8g"))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: the one the cluster names, else one made for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if "GUARDLAKE_SHARED" not in os.environ:
        os.environ["GUARDLAKE_SHARED"] = tempfile.mkdtemp(prefix="guardlake-")
    return os.environ["GUARDLAKE_SHARED"]


def kept(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate result once and read it back.

    For results that one plan uses several times: the text scans behind them then
    run once, and a lost executor re-reads the table instead of scanning again.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
