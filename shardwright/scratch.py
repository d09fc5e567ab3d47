"""Intermediate tables in the folder that all nodes share: they cut lineage, so that an iteration's plan stays short and a
lost executor costs the step at hand, and they fix what a plan would work out anew (partition numbers, row numbers)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset (tests, one machine) a temporary one;
    on a cluster without the setting, a folder in the warehouse, which executors share too."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="shardwright-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again. The JVM deletes the files when it ends, forget() does
    so before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = weakref.finalize(out, _paths.pop, id(out), None), path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more; other frames are left alone."""
    if found := _paths.pop(id(df), None):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
