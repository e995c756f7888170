"""Patterns are only run on texts that hold what they need: with the same matches as when they are run on all."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanscan.functions import triggers
from spanscan.operators import matching
from spanscan.sources import tables

CATALOG = json.loads((tables.OWN / "injection.json").read_text())
RULES = sum(tables.own_rules(), ())
EXAMPLES = [e for x in CATALOG["rules"] + CATALOG["dampeners"] for e in x["examples"]]
GLUED = [f(e) for e in EXAMPLES for f in (str, str.upper, lambda e: f"x{e}y", lambda e: f"\u212a{e}\u017f", lambda e: f"\n{e}\t{e}", lambda e: f"[{e}]", lambda e: f"é{e}. Or  {e[::-1]}")] + ["", " ", "please" * 3]


def allowed(pattern: str, text: str) -> bool:
    """Whether the text has a mark of every group, and a literal, by a plain look."""
    groups, literals = triggers.needs(pattern)
    low, words = text.lower(), text.lower().split(" ")
    has = {f"={w}" for w in words} | {f"^{w[:4]}" for w in words} | {f"${w[-4:]}" for w in words}
    return all(any(m in has or m[0] == "!" and m[1:] in low for m in g) for g in groups) and (not literals or any(x in low for x in literals))


def test_no_match_is_lost_and_few_patterns_are_unbound(spark):
    rows = [(i, t) for i, t in enumerate(GLUED)]
    got = {tuple(r) for r in matching.find_all(spark.createDataFrame(rows, "id int, text string"), RULES, "id").select("id", "rule", "start", "end").collect()}
    want = {(i, r.id, m.start(), m.end()) for i, t in rows for r in RULES for m in re.finditer(r.pattern, t, re.A) if m.end() > m.start()}
    ascii_only = lambda found: {x for x in found if GLUED[x[0]].isascii()}  # noqa: E731  # elsewhere Python folds more letters than Java
    assert ascii_only(got) == ascii_only(want) and len(ascii_only(want)) > 400
    without = spark.createDataFrame(rows, "id int, text string").select("id", F.explode(F.array(*[F.when(F.rlike("text", F.lit(r.pattern)), F.lit(r.id)) for r in RULES])).alias("rule")).filter("rule is not null")
    assert {x[:2] for x in got} == {tuple(r) for r in without.collect()}
    assert all(any(triggers.needs(r.pattern)) for r in RULES) and sum(not triggers.needs(r.pattern)[0] for r in RULES) <= 12


def test_tables_have_the_same_matches(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("-1L as doc_id", "to_json(struct(*)) as text"))
    got = texts.select(matching.found(F.col("text"), RULES).alias("m")).select(F.explode("m.rule").alias("rule")).groupBy("rule").count().collect()
    want: dict[str, int] = {}
    for (t,) in texts.select("text").collect():
        for r in RULES:
            if n := sum(m.end() > m.start() for m in re.finditer(r.pattern, t or "", re.A)):
                want[r.id] = want.get(r.id, 0) + n
    assert {r["rule"]: r["count"] for r in got} == want


@pytest.mark.parametrize("pattern", ["(?iu)strasse now", r"\Qa.b\E", "[a-z&&[^x]]yes", "(?x) a b", "[a[bc]]d", "(", "a" * 20 + "|" + ".", r"(\p{L}+) now", "(a|b|c|d|e|f|g|h)" * 6])
def test_patterns_that_cannot_be_told_ask_for_nothing(pattern):
    assert triggers.needs(pattern)[0] == () and (triggers.needs(pattern)[1] == ())


def test_marks(spark):
    assert triggers.needs("(?i)keep (this|that) secret")[0][0] in ((("=that", "=this")), ("$keep",), ("^secr",))
    assert triggers.forms("(ab)?c+ {2}x{0,3}[-_]\\sé") is not None and triggers.forms("x(?=y)z") == ["x\0z"] and triggers.forms("a[bc]d") == ["abd", "acd"]
    df = spark.createDataFrame([("Please KEEP that secret now",), ("keepthat secret",), ("",), (None,)], "t string")
    got = df.select(triggers.marks(F.lower("t"), ("(?i)keep (this|that) secret",)).alias("m")).collect()
    assert len(got[0]["m"]) >= 3 and "=that" not in got[1]["m"] and got[2]["m"] == [] and got[3]["m"] is None


PARTS = ["ignore", "the ", " all", "(a|bc)?", "(no |the )*", "x{2,3}", "[-_]+", r"\s+", r"\b", "[^\n]{0,5}", " rules", "(yes|no) ", "$", "```", "[a-z]{2,4}", "(?:one|two) (?:three )?", ".", r"\.", "q+", " *"]
WORDS = ["ignore", "the", "all", "a", "bc", "no", "xxx", "rules", "yes", "one two", "three", "```", "-_", ".", "qq", "\n", "  ", "Ignore the all rules"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=5), st.lists(st.sampled_from(WORDS), max_size=8), st.sampled_from(["", " "]))
def test_needs_hold_wherever_a_pattern_matches(parts, words, between):
    pattern, text = "(?i)" + "".join(parts), between.join(words)
    if re.search(pattern, text):
        assert allowed(pattern, text)
