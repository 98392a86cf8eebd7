"""What the corpus operators share: reading tables, cutting lineage, sizing a job, salted joins."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2_000
#: A key is hot that holds more than this share of a partition's fair part of the rows (1 / HOT_SHARE), and HOT_LEAST rows.
HOT_SHARE, HOT_LEAST = 4, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, but only if
    driver and executors are one process: elsewhere each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tapeloom-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that a lost executor costs
    no recomputation of what lies before; the files go when the driver ends, or by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.parquet(path)
    out._tapeloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote and nothing will read again."""
    if df is not None and (path := getattr(df, "_tapeloom_path", None)):
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so when references are collected."""
    gc.collect()
    tidy()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """The driver's JVM, too, gives freed memory outside its heap back, if it has the command: after hundreds of plans
    that is some 100 MB. The server's class isn't public, so its interface's method is called by reflection."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, k in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(k)
    given[0], given[1], given[2], given[3] = name, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    try:
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:  # a JVM without the command
        pass


def _fs(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bounded(spark: SparkSession) -> None:
    """Rows of an Arrow batch at most: with long texts, the default of 10,000 can be more than a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


@functools.lru_cache(maxsize=1)
def _lean() -> None:
    """In a Python worker, Arrow allocates from the system's pool on one thread, so that freed memory can go back."""
    if TaskContext.get() is not None:
        pa.set_memory_pool(pa.system_memory_pool())
        pa.set_cpu_count(1)


def tidy() -> None:
    """Gives freed memory back to the system: Spark keeps Python workers between tasks, several for each core."""
    _lean()
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Size of the input: the optimizer's figure where it has one, else the texts' bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, how: str = "left") -> DataFrame:
    """Join where one key may hold a third of ``left``; ``right`` is unique by ``key``. A key with more than a
    share of 1 in HOT_SHARE x partitions of the rows is hot: its rows are spread over as many salts as it has such
    shares, and only its row of ``right`` is repeated as often. There are fewer hot keys than HOT_SHARE x
    partitions at any size of the data, so their table is broadcast."""
    most = HOT_SHARE * shuffle_partitions(left.sparkSession)
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = left.agg(F.count("*").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * most > F.col("_all") + HOT_LEAST * most)
    hot = hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") * most / F.col("_all")).cast("int").alias("_salts"))
    a = left.join(F.broadcast(hot), left[key].eqNullSafe(F.col("_hot")), "left")
    a = a.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_salts")).cast("int"), F.lit(0))).drop("_hot", "_salts")
    b = right.join(F.broadcast(hot), right[key] == F.col("_hot"), "left")
    b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")
