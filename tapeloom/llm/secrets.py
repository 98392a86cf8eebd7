"""Secret scans with corpus-wide ownership frequency, by SQL functions alone.

Every candidate (assignments, access keys, long hex, and mixed tokens that look random) is hashed; hashes
are counted by distinct owners and distinct repositories. What many owners or many repositories hold is an
example that was copied widely, be it by one owner alone; what few hold looks live. Base spans stay as they
are; a mixed token becomes a span only where its hash is owner-specific.

Defined results: null or empty texts have no spans; a null owner or repository counts as one of its own (all
null owners are one owner, whose repositories count each); a repository of two owners counts for either;
repeated rows count once per repository; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, salted_join
from tapeloom.llm.spans import found

KINDS = ("assign", "access", "hex", "mixed")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MAY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]++", 20
HEX, HEX_LEAST = r"[0-9a-f]{24,}+", 24
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ASSIGN_LEAST = 6
#: A mixed token has at least so many distinct characters; a hash of so many owners, or of so many
#: repositories, is an example.
DISTINCT, WIDE, WIDE_REPOS = 10, 3, 10


def _mixed_ok(s):
    v = s["value"]
    return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base (spans by start, then kind), spans (base and added ones), and of how
    many spans the value is owner-specific (n_live) or widely copied (n_copied); owners and repos are those of the
    most widely held value among its spans (0 without spans)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    parts = [
        F.filter(found(text, "assign", 0, ASSIGN, text.rlike(ASSIGN_MAY), 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST),
        F.filter(found(text, "access", 1, ACCESS, text.contains("AKIA")), lambda s: F.length(s["value"]) >= ACCESS_LEAST),
        F.filter(found(text, "hex", 2, HEX, text.rlike("[0-9a-f]{%d}" % HEX_LEAST)), lambda s: F.length(s["value"]) >= HEX_LEAST),
        F.filter(found(text, "mixed", 3, MIXED, digit & text.rlike("[A-Za-z0-9+/_=-]{20}")), _mixed_ok),
    ]
    hashed = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), hashed.alias("spans"))
    rows = cut(rows)  # the row numbers hold from here on
    each = rows.filter(F.size("spans") > 0).select("_row", "doc_id", "owner", "repo", F.explode("spans").alias("s")).select("*", F.col("s.hash").alias("hash"))
    by_repo = each.select("hash", "owner", "repo").distinct()
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    wide = (F.col("owners") >= WIDE) | (F.col("repos") >= WIDE_REPOS)
    told = salted_join(each, owned, "hash", F.col("_row")).filter((F.col("s.kind") != "mixed") | ~wide)
    told = told.select("_row", "owners", "repos", F.struct("s.start", "s.rank", "s.end", "s.kind", wide.alias("wide")).alias("s"))
    per = told.groupBy("_row").agg(F.sort_array(F.collect_list("s")).alias("all"), F.max("owners").alias("owners"), F.max("repos").alias("repos"))
    shape = "array<struct<start:bigint,rank:int,end:bigint,kind:string,wide:boolean>>"
    out = rows.filter(F.size("spans") > 0).select("_row", "doc_id").join(per, "_row", "left").select("doc_id", F.coalesce("all", F.expr(f"cast(array() as {shape})")).alias("all"), "owners", "repos")
    out = out.union(rows.filter(F.size("spans") == 0).select("doc_id", F.expr(f"cast(array() as {shape})"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    return out.select(
        "doc_id",
        F.filter("all", lambda s: s["kind"] != "mixed").alias("base"),
        F.col("all").alias("spans"),
        F.size(F.filter("all", lambda s: ~s["wide"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: s["wide"])).cast("long").alias("n_copied"),
        F.coalesce("owners", F.lit(0)).alias("owners"),
        F.coalesce("repos", F.lit(0)).alias("repos"),
    )
