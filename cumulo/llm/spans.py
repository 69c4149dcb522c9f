"""Regex matches as spans in code points, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Items that an array gathers one by one, and characters of a strip of text.
BLOCK, STRIP = 128, 256
_FAR = 2**31 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _sooner(a: Column, b: Column) -> Column:
    return F.least(a, b)


def none() -> Column:
    return F.array().cast(SPAN)


def bound(value: Column, made) -> Column:
    """``made(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), made)[0]


def running(items: Column, zero: Column, combine) -> Column:
    """For each item what ``combine(so_far, item)`` has made of all items before it, ``zero`` for the first.

    Items are whole numbers, ``combine`` a sum or an extreme, so that a block's result can stand for its items: an array
    grows within a block of ``BLOCK`` items and by one item a block, and time stays near the number of items.
    """

    def scan(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def of(all_items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_items) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(all_items, b + 1, BLOCK))

        def joined_blocks(cut: Column) -> Column:
            totals = F.transform(cut, lambda block: F.aggregate(block, zero, combine))
            return F.flatten(F.transform(F.arrays_zip(cut.alias("block"), scan(totals, zero).alias("first")), lambda z: scan(z["block"], z["first"])))

        return bound(blocks, joined_blocks)

    return bound(items, of)


def spans(text: Column, kind: str, rank: int, pattern: str | Column) -> Column:
    """All leftmost non-overlapping matches of a Java regex, none of them empty, in order.

    What lies between the matches (``split``) and the matches themselves alternate, so running lengths give the places;
    ``length`` counts code points.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
        hits = F.arrays_zip(pairs.alias("pair"), running(sizes, F.lit(0), lambda a, n: a + n).alias("at"))

        def span(z: Column) -> Column:
            start = z["at"] + F.length(z["pair"]["gap"])
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(z["pair"]["hit"])).alias("end"), F.lit(kind).alias("kind"), z["pair"]["hit"].alias("value"))

        return F.transform(hits, span)

    return bound(F.filter(both, lambda x: x["hit"].isNotNull()), placed)


def where_present(found: Column, present: Column) -> Column:
    """``found`` where a cheap test says that a match is possible."""
    return F.when(present, found).otherwise(none())


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(found: Column, others: Column) -> Column:
    """Spans of ``found`` that overlap none of ``others``, by start; each is held against the furthest end before it and the nearest start after it."""

    def free(pair: Column) -> Column:
        own = F.transform(pair["found"], lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s.alias("span")))
        theirs = F.transform(pair["others"], lambda o: F.struct(o["start"].alias("start"), F.lit(0).alias("own"), o["end"].alias("end"), F.get(pair["found"], F.lit(0)).alias("span")))

        def judged(items: Column) -> Column:
            ends = running(F.transform(items, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), F.lit(0), _later)
            starts = running(F.reverse(F.transform(items, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(_FAR))), F.lit(_FAR), _sooner)
            every = F.arrays_zip(items.alias("x"), ends.alias("before"), F.reverse(starts).alias("after"))
            return F.transform(F.filter(every, lambda z: (z["x"]["own"] == 1) & (z["before"] <= z["x"]["start"]) & (z["after"] >= z["x"]["end"])), lambda z: z["x"]["span"])

        return bound(F.sort_array(F.concat(own, theirs)), judged)

    both = bound(F.struct(found.alias("found"), others.alias("others")), lambda pair: F.when((F.size(pair["found"]) == 0) | (F.size(pair["others"]) == 0), pair["found"]).otherwise(free(pair)))
    return both


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, found: Column, label) -> Column:
    """``text`` with spans, sorted by start, replaced by ``label(span)``; of overlapping spans the first gives the label.

    The text is cut once into strips of ``STRIP`` characters; what lies between two spans is taken from its own strips.
    """

    def made(x: Column) -> Column:
        at = running(F.transform(x["spans"], lambda s: s["end"]), F.lit(0), _later)

        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / STRIP).cast("int")
            strips = F.slice(x["strips"], first + 1, F.floor((b - 1) / STRIP).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(strips, ""), a - first * STRIP + 1, b - a)).otherwise("")

        def piece(z: Column) -> Column:
            return F.when(z["s"]["start"] >= z["at"], F.concat(between(z["at"], z["s"]["start"]), label(z["s"]))).otherwise("")

        pieces = F.transform(F.arrays_zip(x["spans"].alias("s"), at.alias("at")), piece)
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(last, x["size"]))

    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    whole = F.struct(found.alias("spans"), strips.alias("strips"), F.length(text).alias("size"))
    return F.when(F.size(found) == 0, text).otherwise(bound(whole, made))
