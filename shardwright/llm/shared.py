"""What several operators here need: the shared folder, written tables, words in native SQL."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word definition of this package has it: space and \x09 to \x0D.
WHITE = "[\\x20\\x09-\\x0D]+"

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
    """df, written as Parquet to the shared folder and read again. Cuts the lineage: a lost executor costs no
    rerun of what made df. The JVM deletes the files when it ends, forget() does so before."""
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


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished queries now: it looks for them when the driver's JVM
    collects garbage, which may be hours away. What the first round sets free is found by the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text as long; null: 0."""
    t = F.coalesce(text, F.lit(""))
    edge = F.when(t.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0) + F.when(t.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WHITE)) - edge).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
