"""Spans of a text as arrays of structs, inside the row: where patterns match, what spans cover, texts with spans replaced.

Offsets are in code points, ends exclusive. Nothing here shuffles, explodes or joins by a key, so rows with the same key,
or none, don't meet. Sums and maxima that run along an array go by blocks, so that n entries take n * BLOCK steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array, all up to and with it folded together. step has to be associative, and zero neutral."""
    block = lambda v, b, n: F.slice(v, b * BLOCK + 1, n)

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int"))
        each = F.transform(blocks, lambda b: F.aggregate(block(v, b, F.lit(BLOCK)), zero, step))
        before = F.aggregate(each, F.array(zero), lambda s, x: F.array_append(s, step(F.element_at(s, -1), x)))

        def one(b: Column, i: Column, starts: Column) -> Column:
            return F.aggregate(block(v, b, i % BLOCK + 1), F.get(starts, b), step)

        return let(before, lambda starts: F.transform(v, lambda _, i: one(F.floor(i / BLOCK).cast("int"), i, starts)))

    return let(values, whole)


PLACES = "array<struct<start:int,end:int,tested:int>>"


def places(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Array of start, end, tested: leftmost non-overlapping matches, and the length of a group in each. Empty matches are left out; null texts have null."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def of(t: Column) -> Column:
        match = F.regexp_extract_all(t, pattern, F.lit(0))
        tested = F.regexp_extract_all(t, pattern, F.lit(group)) if group else match
        each = F.arrays_zip(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(match)).alias("gap"), match.alias("m"), tested.alias("t"))
        sized = F.transform(each, lambda x: F.struct((F.length(x["gap"]) + F.length(x["m"])).alias("step"), F.length(x["m"]).alias("n"), F.length(x["t"]).alias("t")))
        ends = lambda s: running(F.transform(s, lambda x: x["step"]), F.lit(0), lambda a, b: a + b)
        placed = let(sized, lambda s: F.zip_with(s, ends(s), lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["t"].alias("tested"))))
        return F.filter(placed, lambda x: x["end"] > x["start"])

    return F.when(text.isNotNull(), F.when(F.rlike(text, pattern), let(text, of)).otherwise(F.array().cast(PLACES)))


def in_order(spans: Column) -> Column:
    """Just start and end of spans, sorted."""
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))))


def islands(spans: Column) -> Column:
    """Overlapping spans drawn together, in order; spans that only touch stay apart."""

    def of(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def cut(r: Column) -> Column:
            fresh = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1)))
            last = lambda f, j: F.coalesce(F.get(f, j + 1) - 1, F.size(s) - 1)
            return let(fresh, lambda f: F.transform(f, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.get(r, last(f, j)).alias("end"))))

        return F.when(F.size(s) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(let(reach, cut))

    return let(in_order(spans), of)


def covered(spans: Column) -> Column:
    """How many characters lie in some span."""
    return F.aggregate(islands(spans), F.lit(0), lambda n, x: n + x["end"] - x["start"])


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with spans, in order and apart, replaced by by(span, its number from 0)."""
    piece = lambda t, lo, hi: F.substring(t, lo + 1, hi - lo)

    def of(s: Column) -> Column:
        end = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
        parts = F.transform(s, lambda x, i: F.concat(piece(text, end(i), x["start"]), by(x, i)))
        return F.when(F.size(s) == 0, text).otherwise(F.concat(F.array_join(parts, ""), piece(text, end(F.size(s)), F.length(text))))

    return let(spans, of)


def best_first(spans: Column) -> Column:
    """Of spans (struct with rank, start, end and more), those left when each in turn, by rank, start and length, is kept if it overlaps none kept; in order of start.

    Spans that overlap, one through another, are decided among themselves, so the work is in the square of such a group alone.
    """
    by_rank = lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int")
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]).cast("int")

    def of(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def decided(group: Column) -> Column:
            free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
            none = F.filter(group, lambda x: F.lit(False))
            return F.aggregate(F.array_sort(group, by_rank), none, lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))

        def cut(r: Column) -> Column:
            fresh = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(r, i - 1)))
            group = lambda f, i, j: F.slice(s, i + 1, F.coalesce(F.get(f, j + 1), F.size(s)) - i)
            return let(fresh, lambda f: F.flatten(F.transform(f, lambda i, j: F.array_sort(decided(group(f, i, j)), by_start))))

        return F.when(F.size(s) == 0, s).otherwise(let(reach, cut))

    return let(F.array_sort(spans, by_start), of)
