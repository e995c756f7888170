"""Personal data and credentials: detectors with validators and context, the best by priority, and redaction. All inside the row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import triggers
from ..functions.spans import best_first, let, places, replaced

#: Fixed value: how many characters before a match tell what it is.
LOOKBACK = 48
#: Validators by the names that catalogs use.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": T.luhn, "iban": T.iban, "ssn": T.ssn, "ipv4": T.ipv4, "ipv6": T.ipv6, "siren": T.siren, "siret": T.siret, "nir": T.nir, "nhs": T.nhs, "nino": T.nino,
    "postcode": T.postcode, "npi": T.npi, "jwt": T.jwt, "generic": T.generic_secret, "entropy4": T.bits_of_entropy(4.0), "entropy35": T.bits_of_entropy(3.5),
}


@dataclass(frozen=True)
class Detector:
    type: str
    category: str
    pattern: str
    validate: str | None = None  #: a name in VALIDATORS
    require: str | None = None  #: what has to stand before a match, as a pattern that ends at the match
    suppress: str | None = None  #: what may not stand there


DETECTORS = "array<struct<rank:int,type:string,category:string,pattern:string,validate:string,require:string,suppress:string,literals:array<string>,asks:array<string>>>"
FOUND = "array<struct<rank:int,start:int,end:int,type:string,category:string>>"


def candidates(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """Array of FOUND: matches that their validator and their context let through. rank is the detector's place."""
    if not detectors:
        return F.array().cast(FOUND)
    rows = [{"rank": i, **{k: getattr(d, k) or "" for k in ("type", "category", "pattern", "validate", "require", "suppress")}, "literals": triggers.needs(d.pattern)[1], "asks": triggers.asks(d.pattern)} for i, d in enumerate(detectors)]
    named = lambda low, d: (F.size(d["literals"]) == 0) | F.exists(d["literals"], lambda x: F.contains(low, x))
    can = lambda low, has: F.filter(F.from_json(F.lit(json.dumps(rows)), DETECTORS), lambda d: (F.size(F.array_except(d["asks"], has)) == 0) & named(low, d) & F.rlike(text, d["pattern"]))
    hit = let(triggers.held(text, tuple(d.pattern for d in detectors)), lambda has: let(F.lower(text), lambda low: can(low, has)))
    value = lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])
    before = lambda p: F.substring(text, F.greatest(F.lit(0), p["start"] - LOOKBACK) + 1, F.least(F.lit(LOOKBACK), p["start"]))

    def valid(name: Column, v: Column) -> Column:
        ok = F.lit(True)
        for k in sorted({d.validate for d in detectors if d.validate}):
            ok = F.when(name == k, VALIDATORS[k](v)).otherwise(ok)
        return ok

    def passes(d: Column, p: Column) -> Column:
        context = let(before(p), lambda b: ((d["require"] == "") | F.rlike(b, d["require"])) & ((d["suppress"] == "") | ~F.rlike(b, d["suppress"])))
        return context & let(value(p), lambda v: valid(d["validate"], v))

    one = lambda d, p: F.struct(d["rank"].alias("rank"), p["start"].alias("start"), p["end"].alias("end"), d["type"].alias("type"), d["category"].alias("category"))
    each = F.transform(hit, lambda d: F.transform(F.filter(places(text, d["pattern"]), lambda p: passes(d, p)), lambda p: one(d, p)))
    return F.coalesce(F.flatten(each), F.array().cast(FOUND))


def detect(df: DataFrame, detectors: tuple[Detector, ...], text: str = "text", into: str = "detections", more: Column | None = None) -> DataFrame:
    """df with detections: FOUND, in order and apart. Of overlapping candidates the one of the first detector stays, then the first, then the longest.

    more: candidates of another tier (a classifier's), an array of FOUND with ranks after the detectors'.
    """
    every = candidates(F.col(text), detectors)
    every = F.concat(every, F.coalesce(more, F.array().cast(FOUND))) if more is not None else every
    df = df.withColumn(into, every)
    return df.withColumn(into, best_first(F.col(into)))


def value_of(text: Column, d: Column) -> Column:
    return F.substring(text, d["start"] + 1, d["end"] - d["start"])


def minted(detections: Column, text: Column, by: str) -> Column:
    """A placeholder for each detection. by: `type` gives [redacted:EMAIL], `counter` {EMAIL_1} (equal values, one number), `hash` {EMAIL_<first bytes of its SHA-256>}."""
    if by == "type":
        return F.transform(detections, lambda d: F.concat(F.lit("[redacted:"), d["type"], F.lit("]")))
    if by == "hash":
        return F.transform(detections, lambda d: F.concat(F.lit("{"), d["type"], F.lit("_"), T.hash_prefix(value_of(text, d)), F.lit("}")))
    if by != "counter":
        raise ValueError(f"no way of minting {by!r}")
    named = F.transform(detections, lambda d: F.struct(d["type"].alias("type"), value_of(text, d).alias("value")))

    def numbered(n: Column) -> Column:
        return let(F.array_distinct(n), lambda u: F.transform(n, lambda x: F.concat(F.lit("{"), x["type"], F.lit("_"), F.array_position(F.filter(u, lambda y: y["type"] == x["type"]), x).cast("string"), F.lit("}"))))

    return let(named, numbered)


def redacted(text: Column, detections: Column, tokens: Column) -> Column:
    """The text with each detection replaced by its token. Detections have to be in order, apart and within the text; others are an error."""
    def of(d: Column) -> Column:
        end = lambda i: F.coalesce(F.get(d, i - 1)["end"], F.lit(0))
        sound = F.forall(F.transform(d, lambda x, i: (x["start"] >= end(i)) & (x["end"] > x["start"]) & (x["end"] <= F.length(text))), lambda ok: ok)
        return F.when(sound, replaced(text, d, lambda x, i: F.get(tokens, i))).otherwise(F.raise_error(F.lit("detections must be spans of the text, in order and apart")).cast("string"))

    return F.when(F.size(detections) == 0, text).otherwise(let(detections, of))


def restored(text: Column, tokens: Column, values: Column) -> Column:
    """A redacted text with its tokens replaced by their values again; for tokens that tell values apart."""
    pairs = F.array_distinct(F.arrays_zip(tokens.alias("token"), values.alias("value")))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["token"], p["value"]))


def clamped(text: Column, spans: Column) -> Column:
    """The text with [redacted:type] for spans that may overlap: each starts where the ones before it end, and what is wholly covered goes without a mark."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit("[redacted:"), x["type"], F.lit("]")).alias("out")))
    return F.aggregate(ordered, first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def audit_rows(df: DataFrame, key: str, text: str = "text", detections: str = "detections") -> DataFrame:
    """key, type, category, start, end, value_hash: a row for each detection, never with the value itself."""
    return df.select(key, text, F.explode(detections).alias("d")).select(key, "d.type", "d.category", "d.start", "d.end", T.hash_prefix(value_of(F.col(text), F.col("d"))).alias("value_hash"))
