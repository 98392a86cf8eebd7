"""A cleaning pipeline over documents. STAGES are (name, function) pairs; each function takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, decontaminate, jaccard, ordinal, pii
from tapeloom.llm.common import cut, table
from tapeloom.llm.queries import VOCABULARY
from tapeloom.llm.spans import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are likelier of the lowest grade than not; without labels none. Null texts are empty."""
    return ordinal.select_documents(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links reach: that of the smallest id, and of equal ids one by its text.
    Groups are of rows, so an id that stands on several texts loses none of them. A row without words links
    nothing: only rows with its id and its text are its copies. A null id is kept where its group has no other."""
    rows = cut(docs.withColumn("_kept", F.monotonically_increasing_id()))  # the row numbers hold from here on
    classes = jaccard.similarity_classes(rows, "_kept").withColumnRenamed("doc_id", "_kept")
    each = classes.join(rows.select("_kept", "doc_id", F.xxhash64("text").alias("hash")), "_kept")
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~alone, F.col("component_id")).alias("comp"), F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("hash")).alias("same")]
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "hash", "_kept")).alias("first")
    kept = each.groupBy(*group).agg(first).select("first._kept")
    return rows.join(kept, "_kept", "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item; null and empty texts hold none, repeated rows go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each span's kind in its place. Null and empty texts stay; repeated rows and rows of null ids are kept."""
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = pii.scan(docs, carry=True).select("doc", F.size("spans").alias("n"), F.when(F.size("spans") > 0, redacted(F.col("doc.text"), by_start)).otherwise(F.col("doc.text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded; a row for every row, no ids for null and empty texts."""
    return bpe.encode_decode(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("byte-level BPE", encode),
]

#: The stages are learned, iterative or byte-exact: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
