"""Tables of a folder, catalogs of rules and detectors in JSON, and JSON lines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import SEVERITY, Rule
from ..operators.pii import VALIDATORS, Detector

CATALOG = "id string, name string, category string, severity string, pattern string, flags string, examples array<string>, enabled boolean"
#: The catalogs that come with the package.
OWN = Path(__file__).resolve().parent.parent / "catalogs"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _flagged(pattern: str, flags: str | None) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


def checked(spark: SparkSession, patterns: list[str]) -> None:
    """Each pattern is run by the engine that will use it. One that doesn't compile, or that matches the empty text, is an error."""
    for p in patterns:
        if spark.range(1).select(F.lit("").rlike(p).alias("empty")).first()["empty"]:
            raise ValueError(f"{p!r} matches the empty text")


def rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The enabled rules of a JSON catalog, with an explicit schema. A pattern that Spark can't run, or an unknown severity, is an error."""
    found = []
    for r in spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path).orderBy("id").collect():  # a catalog is small
        if r["enabled"] is not False:
            if r["severity"] not in SEVERITY:
                raise ValueError(f"severity {r['severity']!r} of {r['id']}")
            found.append(Rule(r["id"], r["category"], r["severity"], _flagged(r["pattern"], r["flags"]), r["name"] or ""))
    checked(spark, [r.pattern for r in found])
    return tuple(found)


def own_rules() -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """The package's injection rules and dampeners."""
    spec = json.loads((OWN / "injection.json").read_text(encoding="utf-8"))
    found = tuple(Rule(r["id"], r["category"], r["severity"], _flagged(r["pattern"], r["flags"]), r["name"]) for r in spec["rules"] if r["enabled"])
    return found, tuple(Rule(d["id"], "benign", "low", _flagged(d["pattern"], d["flags"]), d["label"], d["dampen"]) for d in spec["dampeners"])


def own_detectors() -> tuple[Detector, ...]:
    """The package's detectors of personal data and credentials, in order of priority."""
    spec = json.loads((OWN / "pii.json").read_text(encoding="utf-8"))
    return tuple(Detector(d["type"], d["category"], d["pattern"], d["validate"], d["require"], d["suppress"]) for d in spec["detectors"])


def detectors(path: str) -> tuple[Detector, ...]:
    """A catalog of detectors as a local JSON file; an unknown validator is an error."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))["detectors"]
    if unknown := {d["validate"] for d in spec if d.get("validate")} - VALIDATORS.keys():
        raise ValueError(f"validators {sorted(unknown)}")
    return tuple(Detector(*(d.get(k) for k in ("type", "category", "pattern", "validate", "require", "suppress"))) for d in spec)


def same_catalog(a: DataFrame, b: DataFrame, but: tuple[str, ...] = ("updated_at",)) -> Column | bool:
    """Whether two catalogs have the same rows, apart from some columns."""
    a, b = a.drop(*but), b.drop(*but).select(a.drop(*but).columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The objects of a column of JSON lines; lines that are broken, have something after the object, or are none are left out."""
    read = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>")
    return lines.select(read.alias("o")).filter("size(o) = 1 and o[0] is not null").select(F.col("o")[0].alias("o")).select("o.*")
