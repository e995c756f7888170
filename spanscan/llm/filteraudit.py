"""How filters interact, by inclusion and exclusion over their joint failures.

For each set of filters the documents that fail all of them are counted, as sums of products of the flags: 32 counts for
five filters. Everything else follows from these counts alone. Möbius inversion gives the documents that fail exactly a
set, with the survivors (no filter) and the unique failures (one filter). Alternating sums over the filters before a
step give what that step removes in any order, and so what is redundant there. The counts with alternating signs are
the Harsanyi dividends of the game whose worth is what a set of filters removes; each is shared evenly by the filters
of its set, which gives the Shapley value without going through the orders.

Flags are found in the row. Rows are counted by part and flags before they meet, so a part with a third of all rows is
32 rows to each task. A text is told from others by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: All orders of the filters are reported, so there may be so many filters: 720 orders.
MOST_FILTERS = 6


def quality_filters(text: Column) -> dict[str, Column]:
    """Conditions of failing that the text alone decides. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    size = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]  # the text is split once
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": size["n"] < 50,
        "B": 100 * size["distinct"].cast("long") < 65 * size["n"].cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _flags(failures: Mapping[str, Column], first_bit: int = 0) -> Column:
    """The filters that a row fails, as bits. A condition that is null isn't a failure."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << (first_bit + i)) for i, c in enumerate(failures.values())), F.lit(0))


def flagged(docs: DataFrame, failures: Mapping[str, Column], part: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, key, fails (bits, the last for a text that a row with a smaller key has too), for each row of docs.

    Keys are compared where they aren't null: a row without a key is no copy, and makes none. Rows that share key and
    text are copies only of smaller keys, so both stay. The smallest key of each text comes from an aggregate, and is
    joined back by text and key together, so a text that a third of all rows share doesn't meet in one task.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = written(docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(key).alias("key"), _flags(failures).alias("fails"), digest.alias("digest")), "flags")
    firsts = rows.groupBy("digest").agg(F.min("key").alias("key")).filter("key is not null").withColumn("is_first", F.lit(True))
    copy = F.col("key").isNotNull() & F.col("is_first").isNull()
    return rows.join(firsts, ["digest", "key"], "left").select("part", "key", (F.col("fails") + F.when(copy, 1 << len(failures)).otherwise(0)).alias("fails"))


def joint_failures(rows: DataFrame, n: int, sums: tuple[str, ...] = ("n",)) -> DataFrame:
    """part and, for each of `sums`, an array with an entry for each set of the n filters (as bits): the sum over the rows that fail all of the set.

    rows: part, fails, and the columns to sum. Each entry is a sum of products of flags: 1 where a row fails all of the set.
    """
    counted = rows.groupBy("part", "fails").agg(*[F.sum(c).cast("long").alias(c) for c in sums])  # 2^n rows a part from each task
    both = lambda s: F.when(F.col("fails").bitwiseAND(F.lit(s)) == s, 1).otherwise(0)
    return counted.groupBy("part").agg(*[F.array(*[F.sum(both(s) * F.col(c)) for s in range(1 << n)]).alias(c) for c in sums])


def _signed(joint: str, among: Column, fixed: Column, n: int) -> Column:
    """The documents that fail all of `fixed` and none of `among`: joint counts over the subsets of `among`, with alternating signs."""

    def add(total: Column, s: Column) -> Column:
        sign = F.lit(1) - F.lit(2) * (F.bit_count(s) % 2)
        return total + F.when(s.bitwiseAND(among) == s, sign * F.get(F.col(joint), s.bitwiseOR(fixed))).otherwise(F.lit(0)).cast("long")

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), add)


def _shapley(joint: str, own: Column, n: int) -> Column:
    """The filter's Shapley value times the number of orders: its even share of each Harsanyi dividend, which is a joint count with a sign."""
    shares = F.array(*[F.lit(0)] + [F.lit(factorial(n) // k) for k in range(1, n + 1)])

    def add(total: Column, s: Column) -> Column:
        dividend = (F.lit(2) * (F.bit_count(s) % 2) - F.lit(1)) * F.get(F.col(joint), s)
        return total + F.when(s.bitwiseAND(own) == own, dividend * F.get(shares, F.bit_count(s))).otherwise(F.lit(0)).cast("long")

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), add)


def exactly(joint: DataFrame, n: int, sums: tuple[str, ...] = ("n",)) -> DataFrame:
    """part, fails, and sums over the rows that fail exactly that set: the Möbius inversion of joint counts. fails = 0 are the survivors, single bits the unique failures."""
    rest = F.lit((1 << n) - 1).bitwiseXOR(F.col("fails"))
    return joint.withColumn("fails", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).select("part", "fails", *[_signed(c, rest, F.col("fails"), n).alias(c) for c in sums])


def by_order(joint: DataFrame, names: str) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter does there. names: a letter for each filter; joint has n, good and toxic.

    part, filter_order, step (from 1), kept (after the step), removed (by it), redundant (fails its filter, removed
    earlier), unique_fails (fails its filter alone), good_lost, toxic_lost (removed here), shapley (removed by its
    filter, summed over all orders).
    """
    n, bit = len(names), {c: 1 << i for i, c in enumerate(names)}
    steps = [("".join(o), i + 1, bit[f], sum(bit[x] for x in o[:i])) for o in permutations(names) for i, f in enumerate(o)]
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, i, own, before in steps])
    own, before = F.col("own"), F.col("before")
    each = joint.select("part", "n", "good", "toxic", F.inline(plan)).withColumn("removed", _signed("n", before, own, n))
    return each.select(
        "part", "filter_order", "step",
        _signed("n", before.bitwiseOR(own), F.lit(0), n).alias("kept"), "removed",
        (F.get("n", own) - F.col("removed")).alias("redundant"),
        _signed("n", F.lit((1 << n) - 1).bitwiseXOR(own), own, n).alias("unique_fails"),
        _signed("good", before, own, n).alias("good_lost"), _signed("toxic", before, own, n).alias("toxic_lost"),
        _shapley("n", own, n).alias("shapley"),
    )


def joint_of(docs: DataFrame, labels: DataFrame | None, failures: Mapping[str, Column], part: Column, copies: str = "E", key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Joint counts (n, good, toxic) of the given filters and the one of copies, and the filters' letters.

    labels: key, quality, toxic; 1 marks a good or a toxic document. A key that is labelled more than once is good or
    toxic if one of its labels says so. Labels of no document, or of a null key, count nowhere.
    """
    if len(failures) + 1 > MOST_FILTERS:
        raise ValueError(f"{len(failures) + 1} filters have too many orders; {MOST_FILTERS} are the most")
    rows = flagged(docs, failures, part, key, text)
    if labels is None:
        rows = rows.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
        said = labels.select(F.col(key).alias("key"), F.col("quality").alias("good"), "toxic").filter("key is not null").groupBy("key").agg(one("good"), one("toxic"))
        rows = rows.join(said, "key", "left").fillna(0, ["good", "toxic"])
    return joint_failures(rows.withColumn("n", F.lit(1)), len(failures) + 1, ("n", "good", "toxic")), "".join(failures) + copies


def audit(docs: DataFrame, labels: DataFrame | None = None, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """`by_order` for the five filters A to E over whole texts, by the values of `part` (null: empty string).

    Null texts are empty ones, and copies of each other. Repeated rows count as they come. An empty table has no parts
    and gives no rows. Only the columns named are read, so others may have any names.
    """
    return by_order(*joint_of(docs, labels, quality_filters(F.col(text)), F.col(part), key=key, text=text))
