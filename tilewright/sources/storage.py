"""Where tables that cut lineage are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where a session has none and runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tilewright-"))


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write as Parquet in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/tilewright/{uuid.uuid4().hex}/{label}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tilewright_path = path
    return back


def _folder(df: DataFrame):
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tilewright_path)
    return path, path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def stored_bytes(df: DataFrame) -> int:
    """What a table made by `written` takes."""
    path, files = _folder(df)
    return files.getContentSummary(path).getLength()


def delete(df: DataFrame) -> None:
    """Remove a table made by `written`."""
    path, files = _folder(df)
    files.delete(path.getParent(), True)
