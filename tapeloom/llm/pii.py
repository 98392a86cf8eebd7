"""Personal data by patterns and by bootstrapped contexts, by SQL functions alone.

Base entities (email, ip, card, phone) are the seeds. They and all identifier-like tokens are instances; an
instance's patterns are the word before it, the word behind it, and both words together. Turns over the graph
of patterns and instances: a pattern is trusted where it stands around SEEDS_LEAST different trusted values and
these are at least PATTERN_LEAST of all its occurrences (of a single word, all places of the corpus where it
stands; of two words, all instances between them); a value is trusted where at least INSTANCE_LEAST of its
occurrences have a trusted pattern. Trust only grows, values that it discovers count for further patterns, and
the turns end when no pattern is added. Tokens of trusted values in trusted patterns are spans of kind "id".

A candidate is a whole run of letters, digits and . _ - in ASCII, of any length, without the . _ - at its end. It
has six characters at least and a digit anywhere, begins with a letter or digit that no @ or + stands before,
and overlaps no base entity. Shorter ones (A1234) and those without digits (john_doe) are no candidates. A
context is the nearest word of any length on either side, unless only blanks and another token lie between.

Defined results: null or empty texts have no spans; repeated rows give repeated results and count as often as
they stand there; a null id stays null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, drop, salted_join, sweep
from tapeloom.llm.spans import bound, found

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSTANCE = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._-]*+[0-9])(?=[A-Za-z0-9][A-Za-z0-9._-]{4,}?[A-Za-z0-9])[A-Za-z0-9]++(?:[._-]++[A-Za-z0-9]++)*+"
PATTERN_LEAST, SEEDS_LEAST, INSTANCE_LEAST = 0.5, 5, 0.4


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(s: Column) -> Column:
    d = _digits(s["value"])
    return F.length(d).between(16, 19) & luhn(d)


def _ip(s: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(short) <= 3, F.concat(F.lit("0"), short).cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(s["value"], r"\."), small)


def base_spans(text: Column) -> Column:
    """With the words around them."""
    digit = text.rlike("[0-9]")
    return F.concat(
        found(text, "email", 0, EMAIL, text.contains("@"), around=True),
        F.filter(found(text, "ip", 1, IP, digit & text.rlike(r"[0-9]\.[0-9]"), around=True), _ip),
        F.filter(found(text, "card", 2, CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), around=True), _card),
        F.filter(found(text, "phone", 3, PHONE, text.rlike(r"\+[0-9]"), around=True), lambda s: F.length(_digits(s["value"])).between(8, 15)),
    )


def _instances(text: Column, base: Column) -> Column:
    """Base entities (seed 1) and identifier-like tokens (seed 0), which may lie inside those."""
    node = lambda seed: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value"), s["left"].alias("left"), s["right"].alias("right"), F.lit(seed).alias("seed"))
    tokens = found(text, "id", 4, INSTANCE, text.rlike("[0-9]"), around=True)
    return F.concat(F.transform(base, node(1)), F.transform(tokens, node(0)))


def _outside(each: DataFrame) -> DataFrame:
    """The seeds, and the tokens that overlap none of their text. Two running figures in the order of a text."""
    seed = F.col("seed") == 1
    up = W.partitionBy("_row").orderBy("start", F.desc("seed")).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_row").orderBy(F.desc("start"), "seed").rowsBetween(W.unboundedPreceding, 0)
    both = each.withColumn("_before", F.max(F.when(seed, F.col("end"))).over(up)).withColumn("_behind", F.min(F.when(seed, F.col("start"))).over(down))
    apart = (F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.col("_behind").isNull() | (F.col("_behind") >= F.col("end")))
    return both.filter(seed | apart).drop("_before", "_behind")


def patterns_of(left: Column, right: Column) -> Column:
    """The patterns of an instance between two words; blanks aren't in words, so the kinds don't meet."""
    one = [F.when(left != "", F.concat(left, F.lit(" _"))), F.when(right != "", F.concat(F.lit("_ "), right)), F.when((left != "") & (right != ""), F.concat(left, F.lit(" _ "), right))]
    return F.array_compact(F.array(*one))


def trusted(contexts: DataFrame, occurs: DataFrame) -> DataFrame:
    """contexts(context, value, left, right, seed, n), occurs(word, occurs) -> the contexts (context) of trusted values with a trusted pattern."""
    graph = cut(contexts.select("context", "value", "seed", "n", F.explode(patterns_of(F.col("left"), F.col("right"))).alias("pattern")))
    held = graph.groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    sweep(contexts.sparkSession)  # the plans of the spans
    single = occurs.select(F.explode(F.array(F.concat("word", F.lit(" _")), F.concat(F.lit("_ "), F.col("word")))).alias("pattern"), "occurs")
    every = held.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("values")).filter(F.col("values") >= SEEDS_LEAST)
    places = cut(every.join(single, "pattern", "left").select("pattern", F.greatest("n", F.coalesce("occurs", F.lit(0))).alias("places")))
    held = cut(salted_join(held, places, "pattern", F.col("value"), "inner"))
    values, known, found_ = held.filter("seed = 1").select("value").distinct(), 0, None
    while True:
        told = salted_join(held, values.withColumn("_told", F.lit(1)), "value", F.col("pattern"), "inner") if found_ is not None else held.filter("seed = 1")
        score = told.groupBy("pattern", "places").agg(F.sum("n").alias("trust"), F.count("*").alias("values"))
        patterns = cut(score.filter((F.col("values") >= SEEDS_LEAST) & (F.col("trust") >= PATTERN_LEAST * F.col("places"))).select("pattern"))
        now = patterns.count()
        if now == known:  # trust only grows: as many patterns are the same ones
            break
        known = now
        marked = salted_join(graph, patterns.withColumn("_ok", F.lit(1)), "pattern", F.col("context"))
        per = marked.groupBy("context", "value").agg(F.max("seed").alias("seed"), F.max("n").alias("n"), F.max(F.coalesce("_ok", F.lit(0))).alias("ok"))
        drop(found_)
        found_ = cut(per)
        share = found_.groupBy("value").agg(F.max("seed").alias("seed"), (F.sum(F.col("n") * F.col("ok")) / F.sum("n")).alias("r"))
        values = cut(share.filter((F.col("seed") == 1) | (F.col("r") >= INSTANCE_LEAST)).select("value"))
    if found_ is None:
        return contexts.select("context").limit(0)
    return salted_join(found_.filter("seed = 0 AND ok = 1"), values, "value", F.col("context"), "inner").select("context")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, base and spans (both by kind, then start); with ``carry`` also doc, a
    struct of all the input's columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ["doc"] if carry else []
    both = bound(base_spans(text), lambda b: F.struct(b.alias("base"), _instances(text, b).alias("instances")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), *([F.struct(*docs.columns).alias("doc")] if carry else []), both.alias("s"))
    slim = F.transform("s.base", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = cut(rows.select("_row", "doc_id", *own, F.sort_array(slim).alias("base"), F.col("s.instances").alias("instances")))
    each = rows.filter(F.size("instances") > 0).select("_row", F.explode("instances").alias("i")).select("_row", "i.*")
    each = cut(_outside(each).withColumn("context", F.concat_ws(" ", "value", "left", "right")))
    contexts = each.groupBy("context", "value", "left", "right").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    words = docs.select(F.explode(F.split(F.lower(text), r"[\x20\x09-\x0D]+")).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("occurs"))
    new = salted_join(each.filter("seed = 0"), trusted(cut(contexts), words), "context", F.col("_row"), "inner")
    new = new.groupBy("_row").agg(F.collect_list(F.struct(F.lit(4).alias("rank"), "start", "end", F.lit("id").alias("kind"))).alias("new"))
    # only rows with instances can have new spans: the others, with all they carry, stay where they are
    none = F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint,kind:string>>)")
    some = rows.filter(F.size("instances") > 0).join(new, "_row", "left").select("doc_id", *own, "base", F.sort_array(F.concat("base", F.coalesce("new", none))).alias("spans"))
    return some.union(rows.filter(F.size("instances") == 0).select("doc_id", *own, "base", F.col("base").alias("spans")))
