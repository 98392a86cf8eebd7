"""Replace chains: the references that replacements connect, each with one name for its chain."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task connects, and whose roots are broadcast (16 MB); more go by rounds of joins, to the same result.
FEW = 1 << 20


def _cut(df: DataFrame) -> DataFrame:
    """A written copy in the folder that all executors share, so that a lost executor costs no round again."""
    spark: SparkSession = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.gettempdir()
    path = f"{folder}/chains-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.parquet(path)


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    refs = np.fromiter(up, np.int64, len(up))
    yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array([root(x) for x in refs.tolist()], pa.int64())], ["ref", "root"])


def _rounds(edges: DataFrame) -> DataFrame:
    """Each round takes the smallest root of the neighbours and then that root's own root."""
    both = _cut(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    roots = _cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("ref"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(roots, both.b == roots.ref).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.ref == near.a).select("ref", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hop = roots.select(F.col("ref").alias("root"), F.col("root").alias("next"))
        step = _cut(step.join(hop, "root", "left").select("ref", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        roots = step.select("ref", "root")
        if step.filter("root != was").isEmpty():
            return roots


def roots(replaces: DataFrame, few: int | None = None) -> DataFrame | None:
    """replaces(order_ref, new_ref) -> (ref, root), the smallest reference of the chain, for every reference that
    a replacement names; None where there are none. Rejected replacements connect, too: what is in one chain
    may affect each other, what isn't can't."""
    few = FEW if few is None else few
    edges = replaces.filter("order_ref IS NOT NULL AND new_ref IS NOT NULL AND order_ref != new_ref").select(F.col("order_ref").cast("long").alias("a"), F.col("new_ref").cast("long").alias("b"))
    n = edges.limit(few + 1).count()
    if not n:
        return None
    if n > few:
        return _rounds(edges)
    return F.broadcast(edges.coalesce(1).mapInArrow(_connect, "ref long, root long"))
