"""Session helpers: the shared folder, tables written there to cut lineage, and input preparation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or, only where that is unset, a folder of our own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Deletes the tables that ``materialize`` wrote. Call it when no result that was built on them is needed any more; it also runs at the end of the process, if Spark still does."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # Spark has ended: what is left is the shared folder's to clean
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and the files outlive a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """A table of a data directory, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_delivery(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row for each key: the last by ``order``. Rows whose order is equal are told apart by all their columns, so the choice is the same in every run."""
    if order is None:
        return df.dropDuplicates(keys)
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order, digest))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
