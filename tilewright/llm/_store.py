"""Tables that cut lineage, in the folder the cluster shares; joins whose small side is measured first."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_tilewright_root", None)
        if not root:
            root = spark._tilewright_root = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tilewright/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tilewright_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by `materialize` that nothing needs any longer."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._tilewright_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows, measured, take `limit` bytes at most; else as it is, for a shuffled join."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _bytes(field)
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit else df


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(text)


def without(documents: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`documents` less the rows whose id (null equals null) and text key are in `gone`."""
    gone = small(gone.toDF("_gone_id", "_gone_text"))
    return documents.join(gone, documents[id_col].eqNullSafe(gone["_gone_id"]) & (text_key(documents[text_col]) == gone["_gone_text"]), "left_anti")


def only(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `documents` whose id (null equals null) and text key are in `wanted`."""
    wanted = small(wanted.toDF("_wanted_id", "_wanted_text"))
    return documents.join(wanted, documents[id_col].eqNullSafe(wanted["_wanted_id"]) & (text_key(documents[text_col]) == wanted["_wanted_text"]), "left_semi")
