"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of a file is addressed by the SHA-256 of its content. A ledger holds the pairs of blob and
rule version that were scanned; a run scans the unseen pairs alone, each blob once however many paths or versions
hold it, and joins all findings back to the paths. A rule's version is a hash of its definition, so a changed rule is
scanned anew over old blobs, and an unchanged one is not.

`scan` is one run on a ledger in memory. `Ledger` keeps entries and findings as Parquet tables that each run adds to.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

#: Versions of one blob are dealt over so many tasks where findings are joined back to them.
SALTS = 16
#: Lengths that are added up at once where offsets are made; a text of n matches takes n / BLOCK such sums.
BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than `least` fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""  #: a literal that every match holds

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: In `access` and `hex` the length is part of the pattern: a match is a whole run of one class of characters from its
#: first possible start, so a run that is too short has no later start that would do.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules that came after: keys by the prefixes that their issuers document, private keys, web tokens, passwords in addresses.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=".eyJ"),
    Rule("code_host", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}", needs="g"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", needs="AIza"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}", needs="k_live_"),
    Rule("address_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]{1,64}:([^\s/@:]{3,128})@", 1, 3, "://"),
)
RULES = BASE + ADDED


def blob_id(text: str | Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _may_match(text: Column, rule: Rule) -> Column:
    return text.contains(rule.needs) & text.rlike(rule.pattern) if rule.needs else text.rlike(rule.pattern)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, todo: of the blobs that some rule has to scan, the versions of those rules. blobs: distinct `blob`."""
    every = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    return blobs.join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)


def _spans(content: Column, rule: Rule) -> Column:
    """Array of structs start, end of a rule's matches, from the lengths of what stands before each match and of the matches."""
    match = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    each = F.arrays_zip(F.slice(F.split(content, rule.pattern, -1), F.lit(1), F.size(match)).alias("gap"), match.alias("m"), tested.alias("t"))
    sized = F.transform(each, lambda x: F.struct((F.length(x["gap"]) + F.length(x["m"])).alias("step"), F.length(x["m"]).alias("n"), (F.length(x["t"]) >= rule.least).alias("ok")))
    over = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a value that is made once and used often

    def placed(sizes: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda s, x: s + x["step"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))

        def end(x: Column, i: Column, starts: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.get(starts, b) + F.aggregate(F.slice(sizes, b * BLOCK + 1, i % BLOCK + 1), F.lit(0), lambda s, y: s + y["step"])

        ends = over(before, lambda starts: F.transform(sizes, lambda x, i: F.struct((end(x, i, starts) - x["n"]).alias("start"), end(x, i, starts).alias("end"), x["ok"].alias("ok"))))
        return F.transform(F.filter(ends, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["end"]))

    return over(sized, placed)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of the unseen pairs, and the ledger's new entries.

    versions: a row for each version of each path, with its whole text; null is the empty text.
    Findings: blob, rule_version, kind, start, end (code points, end exclusive), a row each. Ledger: blob,
    rule_version. Repeated and equal texts are one blob, scanned once. An empty table gives no rows in either. Only
    the text column is read, so other columns may have any names.

    Addresses are compared with the ledger first. Then the contents that a rule still has to see are brought together
    by address, one of each, and the rules run on these. Where each such rule has a literal, contents without any of
    the literals aren't brought together at all.
    """
    addressed = versions.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    todo = settled(unseen(addressed.select("blob").distinct(), ledger, rules))
    entries = todo.select("blob", F.explode("todo").alias("rule_version"))
    open_ = {r[0] for r in entries.select("rule_version").distinct().collect()}  # no more than there are rules
    rules = tuple(r for r in rules if r.version in open_)
    if rules and all(r.needs for r in rules):
        addressed = addressed.filter(reduce(Column.__or__, [F.col("content").contains(r.needs) for r in rules]))
    blobs = addressed.groupBy("blob").agg(F.any_value("content").alias("content")).join(todo, "blob")
    found = [
        F.when(F.array_contains("todo", r.version) & _may_match(F.col("content"), r), F.struct(F.lit(r.version).alias("rule_version"), F.lit(r.kind).alias("kind"), _spans(F.col("content"), r).alias("spans")))
        for r in rules
    ] or [F.lit(None).cast("struct<rule_version:string,kind:string,spans:array<struct<start:int,end:int>>>")]
    by_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return by_rule.select("blob", "f.rule_version", "f.kind", F.explode("f.spans").alias("s")).select("blob", "rule_version", "kind", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end")), entries


class Ledger:
    """Entries and findings of all finished runs, in this session and earlier ones, as Parquet tables under a folder that the driver and executors share.

    A run has a folder of a name of its own, and is marked as finished by a row that is written last. What a run left
    that stopped before isn't read, and is scanned again by the next one. Findings are read without repeats.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    @property
    def runs(self) -> list[str]:
        """The finished runs: one name for each."""
        try:
            return sorted({r["run"] for r in self.spark.read.schema("run string").parquet(f"{self.at}/finished").collect()})
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # no run has finished yet
                raise
            return []

    def _all(self, name: str, schema: str) -> DataFrame | None:
        runs = self.runs
        return self.spark.read.schema(schema).parquet(*[f"{self.at}/{run}/{name}" for run in runs]) if runs else None

    @property
    def entries(self) -> DataFrame | None:
        return self._all("entries", "blob string, rule_version string")

    @property
    def findings(self) -> DataFrame:
        """Findings of all finished runs; none where no run has finished."""
        schema = "blob string, rule_version string, kind string, start long, end long"
        found = self._all("findings", schema)
        return self.spark.createDataFrame([], schema) if found is None else found.distinct()

    def run(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Scans what the ledger hasn't seen, and adds it."""
        found, entries = scan(versions, self.entries, rules, text)
        name = f"run-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.at}/{name}/findings")
        entries.write.parquet(f"{self.at}/{name}/entries")
        self.spark.range(1).select(F.lit(name).alias("run")).write.mode("append").parquet(f"{self.at}/finished")


def spans_of(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, n (a struct with a count for each kind), spans: kind, start, end, by start and then by the order of the rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    each = F.struct("start", order[F.col("kind")].alias("o"), "kind", "end")
    return findings.groupBy("blob").agg(F.struct(*[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]).alias("n"), F.array_sort(F.collect_list(each)).alias("spans"))


def joined(spans: str | Column, kinds: tuple[str, ...] = ()) -> Column:
    """kind:start:end of spans, of some kinds or all, joined with commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    some = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda x: F.format_string("%s:%d:%d", x["kind"], x["start"], x["end"])), ",")


def located(versions: DataFrame, findings: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each version of each path, with the spans of its blob: version (a struct of the kept columns), blob, n_<kind>, spans.

    Versions without findings have counts of 0 and no spans. Null texts are the empty blob, repeated rows stay, an
    empty table gives no rows, and kept columns may have any names, as they are in a struct of their own.

    Copies of one blob may be a third of all versions: they are dealt over SALTS partitions by their kept columns, the
    findings, few beside the versions, go to each salt, and adaptive execution splits a partition that is still large.
    """
    per = spans_of(findings, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    version = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    salt = F.pmod(F.xxhash64("version"), F.lit(SALTS)).cast("int")
    of = versions.select(version.alias("version"), blob_id(text).alias("blob")).withColumn("salt", salt).join(per, ["blob", "salt"], "left")
    none = F.array().cast("array<struct<start:bigint,o:int,kind:string,end:bigint>>")
    return of.select("version", "blob", *[F.coalesce(F.col(f"n.n_{r.kind}"), F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules], F.coalesce("spans", none).alias("spans"))
