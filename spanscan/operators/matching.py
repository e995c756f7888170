"""Rule catalogs over texts: matches with offsets, scores and redaction, all inside the row.

Texts are read as they are, normalised, and with digits and signs read as letters; matches of each reading are traced
back to the text. Everything but the readings runs in the JVM, and nothing shuffles.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import triggers
from ..functions.spans import covered, islands, let, places, replaced
from ..functions.variants import readings

#: The weight of each severity, and of each part of the heuristic score; the bars to block and to warn; how near a dampener acts, in characters; what stands for what was cut out.
SEVERITY = {"low": 0.15, "medium": 0.35, "high": 0.60, "critical": 1.0}
PARTS = {"severity": 0.6, "category": 0.2, "density": 0.15, "cluster": 0.05}
BLOCK, WARN = 0.60, 0.25
WITHIN = 200
NOTICE = "[content removed: possible prompt injection]"
#: The weights of rules, classifier and entropy in the fused score, and the score from which one of the first two decides alone.
FUSED, SURE = {"rules": 0.5, "classifier": 0.4, "entropy": 0.1}, 0.85


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    pattern: str  #: for Java and RE2 alike
    name: str = ""
    dampen: float = 1.0  #: of dampeners: what is left of the weight of matches near them


MATCH = "array<struct<rule:string,name:string,category:string,severity:string,start:int,end:int>>"


CATALOG = "array<struct<rule:string,name:string,category:string,severity:string,pattern:string,dampen:double,marks:array<array<string>>,literals:array<string>>>"


def catalog(rules: tuple[Rule, ...]) -> Column:
    """A catalog as one constant, so that a query is as large as it is whatever the number of its rules. marks, literals: see `triggers.needs`."""
    rows = [{"rule": r.id, "name": r.name or r.id, "category": r.category, "severity": r.severity, "pattern": r.pattern, "dampen": float(r.dampen), **dict(zip(("marks", "literals"), triggers.needs(r.pattern), strict=True))} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), CATALOG)


def hit(text: Column, low: Column, rules: tuple[Rule, ...]) -> Column:
    """The rules that match a text; low: the text in lower case. It is split once, its marks pick rules, these are tested for a literal, and only then are their patterns run."""
    marked = lambda has, r: F.forall(r["marks"], lambda g: F.arrays_overlap(g, has))
    holds = lambda r: (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda x: F.contains(low, x))
    return let(triggers.marks(low, tuple(r.pattern for r in rules)), lambda has: F.filter(catalog(rules), lambda r: marked(has, r) & holds(r) & F.rlike(text, r["pattern"])))


def found(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Array of MATCH: leftmost non-overlapping matches of each rule, in the rules' order. Null and empty texts have none."""
    one = lambda r, p: F.struct(*[r[c].alias(c) for c in ("rule", "name", "category", "severity")], p["start"].alias("start"), p["end"].alias("end"))
    each = lambda low: F.flatten(F.transform(hit(text, low, rules), lambda r: F.transform(places(text, r["pattern"]), lambda p: one(r, p))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(MATCH)).otherwise(let(F.lower(text), each)) if rules else F.array().cast(MATCH)


def _traced(matches: Column, reading: Column) -> Column:
    """Matches of a reading as matches of its source."""
    part = lambda of, m: F.slice(reading[of], m["start"] + 1, m["end"] - m["start"])
    return F.transform(matches, lambda m: m.withField("start", F.array_min(part("starts", m))).withField("end", F.array_max(part("ends", m))))


def by_start(matches: Column) -> Column:
    """Sorted by where they start; those that start together stay in their order."""
    placed = F.transform(matches, lambda m, i: F.struct(m["start"].alias("at"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(placed), lambda x: x["m"])


def dampening(matches: Column, dampeners: Column, within: int = WITHIN) -> Column:
    """For each match the least `dampen` of the dampeners within so many characters, 1.0 where there is none."""
    gap = lambda m, d: F.greatest(F.lit(0), d["start"] - m["end"], m["start"] - d["end"])
    near = lambda m: F.transform(F.filter(dampeners, lambda d: gap(m, d) <= within), lambda d: d["dampen"])
    return F.transform(matches, lambda m: F.least(F.lit(1.0), F.coalesce(F.array_min(near(m)), F.lit(1.0))))


def dampeners_in(text: Column, dampeners: tuple[Rule, ...]) -> Column:
    """Array of start, end, dampen."""
    none = F.array().cast("array<struct<start:int,end:int,dampen:double>>")
    each = lambda low: F.flatten(F.transform(hit(text, low, dampeners), lambda d: F.transform(places(text, d["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), d["dampen"].alias("dampen")))))
    return F.coalesce(let(F.lower(text), each), none) if dampeners else none


def weight_of(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[severity]


def heuristic(matches: Column, dampen: Column, length: Column) -> Column:
    """The score before rounding, of matches in order of start: weights of severities (dampened), categories, density and clustering."""
    one = F.lit(1.0)
    severity = F.least(one, F.aggregate(F.zip_with(matches, dampen, lambda m, d: weight_of(m["severity"]) * d), F.lit(0.0), lambda s, x: s + x))
    category = F.least(one, F.size(F.array_distinct(F.transform(matches, lambda m: m["category"]))) / F.lit(3.0))
    density = F.least(one, covered(matches) / length * F.lit(10.0))
    gaps = F.transform(F.slice(matches, F.lit(2), F.size(matches)), lambda m, i: F.greatest(F.lit(0), m["start"] - F.get(matches, i)["end"]))
    mean = F.aggregate(gaps, F.lit(0), lambda s, x: s + x) / (F.size(matches) - 1)
    cluster = F.when(F.size(matches) > 1, F.greatest(F.lit(0.0), one - F.lit(5.0) * mean / length)).otherwise(0.0)
    parts = zip(PARTS.values(), (severity, category, density, cluster), strict=True)
    return F.when(F.size(matches) == 0, 0.0).otherwise(F.least(one, reduce(Column.__add__, [F.lit(w) * p for w, p in parts])))


def bar(value: float, otherwise: float) -> float:
    """A threshold within 0 and 1; the usual one where it is no number."""
    return min(1.0, max(0.0, value)) if value == value and abs(value) != float("inf") else otherwise


def fused(rules: Column, classifier: Column, entropy: Column) -> Column:
    """Rules, classifier and entropy weighed together; where rules or classifier are sure, the surer of them alone. A null classifier counts as 0."""
    top = F.greatest(rules, classifier)
    return F.when(top >= SURE, top).otherwise(rules * FUSED["rules"] + F.coalesce(classifier, F.lit(0.0)) * FUSED["classifier"] + entropy * FUSED["entropy"])


def scan(df: DataFrame, rules: tuple[Rule, ...], dampeners: tuple[Rule, ...] = (), text: str = "text", block: float = BLOCK, warn: float = WARN, leet: bool = True, variants: bool = True) -> DataFrame:
    """df with matches (MATCH, by start, each rule and stretch once), detected, sanitized, and score: total, should_block, should_warn, category_count, highest_severity.

    Flags are of the total before rounding. Null and empty texts have no matches. Rows don't meet, so keys may repeat.
    """
    block, warn, t = bar(block, BLOCK), bar(warn, WARN), F.col(text)
    df = df.withColumn("_read", readings(t, leet) if variants else F.lit(None))
    if variants:
        traced = [F.when(F.col(f"_read.{v}").isNotNull(), _traced(found(F.col(f"_read.{v}.text"), rules), F.col(f"_read.{v}"))) for v in ("normal", "leet")]
        every = F.array_distinct(F.flatten(F.array_compact(F.array(found(t, rules), *traced))))
    else:
        every = F.array_distinct(found(t, rules))
    df = df.withColumn("matches", every).withColumn("matches", by_start(F.col("matches"))).drop("_read")
    m, n = F.col("matches"), F.length(t)
    any_ = F.size(m) > 0
    df = df.withColumn("_dampeners", F.when(any_, dampeners_in(t, dampeners)))
    df = df.withColumn("_raw", F.when(any_, heuristic(m, dampening(m, F.col("_dampeners")), n)).otherwise(0.0))
    highest = F.array_max(F.transform(m, lambda x: F.struct(weight_of(x["severity"]).alias("w"), x["severity"].alias("s"))))["s"]
    raw = F.col("_raw")
    score = F.struct(
        F.round(raw, 3).alias("total"), (any_ & (raw >= block)).alias("should_block"), (any_ & (raw >= warn) & (raw < block)).alias("should_warn"),
        F.size(F.array_distinct(F.transform(m, lambda x: x["category"]))).alias("category_count"), highest.alias("highest_severity"),
    )
    return df.withColumns({"detected": any_, "sanitized": F.when(any_, replaced(t, islands(m), lambda x, i: F.lit(NOTICE))).otherwise(t), "score": score}).drop("_dampeners", "_raw")


def find_all(df: DataFrame, rules: tuple[Rule, ...], key: str, text: str = "text") -> DataFrame:
    """key, rule, category, severity, start, end, matched: a row for each match, without a shuffle. Repeated and null keys are rows of their own."""
    hits = df.select(key, text, F.explode(found(F.col(text), rules)).alias("m"))
    return hits.select(key, "m.rule", "m.category", "m.severity", "m.start", "m.end", F.substring(F.col(text), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("matched"))


def merged(spans: DataFrame, key: str) -> DataFrame:
    """key, start, end, n of overlapping spans drawn together; spans that only touch stay apart. For spans that are rows; inside a row, `islands`."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    drawn = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return drawn.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def component_best(matches: Column) -> Column:
    """Of matches that overlap, one through another, the heaviest, then the longest, then the last by name, category and severity."""
    rank = lambda m: F.struct(weight_of(m["severity"]).alias("w"), (m["end"] - m["start"]).alias("n"), m["name"].alias("name"), m["category"].alias("c"), m["severity"].alias("s"), m.alias("m"))
    inside = lambda i: F.filter(matches, lambda m: (m["start"] >= i["start"]) & (m["end"] <= i["end"]))
    return F.transform(islands(matches), lambda i: F.array_max(F.transform(inside(i), rank))["m"])


def rules_only(df: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """df with n_matches, names and categories (distinct, sorted): the best of each group of overlapping matches, without scores."""
    df = df.withColumn("_m", found(F.col(text), rules)).withColumn("_m", component_best(F.col("_m")))
    of = lambda c: F.array_sort(F.array_distinct(F.transform("_m", lambda m: m[c])))
    return df.withColumns({"n_matches": F.size("_m"), "names": of("name"), "categories": of("category")}).drop("_m")
