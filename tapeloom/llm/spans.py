"""Spans of regular expressions in texts by SQL functions alone: kind, start and end in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions are summed in two levels, so that a text with very many matches costs no square.
_GROUP = 128
#: Code points of a chunk at least.
_CHUNK = 4096


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def found(text: Column, kind: str, rank: int, pattern: str, may: Column, group: int = 0, around: bool = False) -> Column:
    """array<struct<start, rank, end, kind, value>> of the leftmost non-overlapping matches; ``group`` is the
    value's group. ``may`` is a cheap test that every text with a match passes. With ``around`` also left and
    right: the words before and behind, in small letters, '' where only blanks lie between two matches."""
    words = ",left:string,right:string" if around else ""
    none = F.expr(f"cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string{words}>>)")

    def spans(v: Column) -> Column:
        n = F.size(v["hits"])
        lengths = F.transform(v["hits"], lambda h, i: F.struct(F.length(F.get(v["rest"], i)).cast("long").alias("gap"), F.length(h).cast("long").alias("own")))

        def sums(ls: Column) -> Column:
            add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["own"])
            groups = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _GROUP).cast("int")), lambda g: add(F.slice(ls, g * _GROUP + 1, F.lit(_GROUP))))

            def starts(gs: Column) -> Column:
                before = F.transform(gs, lambda _, i: F.aggregate(F.slice(gs, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))

                def one(bs: Column) -> Column:
                    def span(x: Column, i: Column) -> Column:
                        g = F.floor(i / _GROUP).cast("int")
                        start = F.get(bs, g) + add(F.slice(ls, g * _GROUP + 1, i % _GROUP)) + x["gap"]
                        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["own"]).alias("end"), F.lit(kind).alias("kind"), F.get(v["values"], i).alias("value"), *(_words(v["rest"], i) if around else ()))

                    return F.transform(ls, span)

                return bound(before, one)

            return bound(groups, starts)

        return F.when(n > 0, bound(lengths, sums)).otherwise(none)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    all_ = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("rest"), value.alias("values"))
    return F.when(may, bound(all_, spans)).otherwise(none)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(rest: Column, i: Column) -> tuple[Column, Column]:
    """The last word of the text before match i, and the first of the text behind it."""
    flat = lambda c: F.translate(c, "\t\n\x0b\x0c\r", "     ")
    left = F.substring_index(F.rtrim(flat(F.get(rest, i))), " ", -1)
    right = F.substring_index(F.ltrim(flat(F.get(rest, i + 1))), " ", 1)
    return F.lower(left).alias("left"), F.lower(right).alias("right")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans are sorted by start, and one that begins
    inside another before it goes with that. The largest end so far is kept for groups of spans and the text is cut
    into chunks, so that a text with very many spans costs no square."""
    none = F.lit(-1).cast("long")

    def merged(ss: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(ss) - 1) / _GROUP).cast("int")), lambda g: F.array_max(F.transform(F.slice(ss, g * _GROUP + 1, F.lit(_GROUP)), lambda s: s["end"])))

        def heads(ts: Column) -> Column:
            before = F.transform(ts, lambda _, i: F.coalesce(F.array_max(F.slice(ts, F.lit(1), i)), none))

            def marked(bs: Column) -> Column:
                def one(s: Column, i: Column) -> Column:
                    g = F.floor(i / _GROUP).cast("int")
                    own = F.coalesce(F.array_max(F.transform(F.slice(ss, g * _GROUP + 1, i % _GROUP), lambda x: x["end"])), none)
                    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.greatest(F.get(bs, g), own).alias("before"))

                return F.filter(F.transform(ss, one), lambda h: h["start"] >= h["before"])

            return bound(F.struct(bound(before, marked).alias("heads"), F.array_max(ts).alias("last")), ended)

        def ended(x: Column) -> Column:
            return F.transform(x["heads"], lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(x["heads"], i + 1)["before"], x["last"]).alias("end"), h["kind"].alias("kind")))

        return bound(tops, heads)

    def build(c: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / c["step"]).cast("int"), F.floor(b / c["step"]).cast("int")
            head = F.substring(F.get(c["chunks"], first), (a % c["step"] + 1).cast("int"), F.when(first == last, b - a).otherwise(c["step"]).cast("int"))
            middle = F.array_join(F.slice(c["chunks"], first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.coalesce(F.substring(F.get(c["chunks"], last), F.lit(1), (b % c["step"]).cast("int")), F.lit(""))
            return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, middle, tail))

        def put(ms: Column) -> Column:
            pieces = F.transform(ms, lambda m, i: F.concat(piece(F.when(i > 0, F.get(ms, i - 1)["end"]).otherwise(F.lit(0).cast("long")), m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
            return F.concat(F.array_join(pieces, ""), piece(F.element_at(ms, -1)["end"], F.length(text).cast("long")))

        return bound(c["spans"], put)

    step = F.greatest(F.lit(_CHUNK), F.floor(F.length(text) / 512) + 1).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.length(text) / step)), lambda k: F.substring(text, (k * step + 1).cast("int"), step.cast("int")))
    return F.when(F.size(spans) > 0, bound(F.struct(bound(spans, merged).alias("spans"), cut.alias("chunks"), step.alias("step")), build)).otherwise(text)
