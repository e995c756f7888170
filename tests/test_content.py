"""Matching, scoring, redaction and personal data against plain versions."""

import hashlib
import json
import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from spanscan import plans
from spanscan.functions import spans as S
from spanscan.functions import variants
from spanscan.operators import matching, pii
from spanscan.sources.tables import own_detectors, own_rules

TABLES = "/root/testdata/sf0.001"
R = matching.Rule


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def scanned(spark, text, *rules, **options):
    return matching.scan(texts(spark, text), rules, **options).first()


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 400])
def test_running_and_islands(spark, n):
    rng = random.Random(n)
    spans = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(3 * n + 1) for _ in range(n))]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in spans],)], "s array<struct<start:int,end:int>>")
    r = df.select(S.islands(F.col("s")).alias("i"), S.covered(F.col("s")).alias("c"), S.running(F.transform("s", lambda x: x["end"]), F.lit(0), lambda a, b: a + b).alias("r")).first()
    merged = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    assert [[x["start"], x["end"]] for x in r["i"]] == merged and r["c"] == len({i for a, b in spans for i in range(a, b)})
    assert r["r"] == [sum(b for _, b in spans[: i + 1]) for i in range(n)]


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a a@b.com c@d.org"), (1, "zzzzzzz x@y.net"), (None, "q@r.com"), (None, None), (2, "")], "id int, text string")
    rule = (R("m", "personal", "low", r"[a-z]@[a-z]\.[a-z]{3}"),)
    found = matching.find_all(df, rule, "id")
    assert sorted((repr(r["id"]), r["start"], r["end"], r["matched"]) for r in found.collect()) == [("1", 2, 9, "a@b.com"), ("1", 8, 15, "x@y.net"), ("1", 10, 17, "c@d.org"), ("None", 0, 7, "q@r.com")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in matching.scan(df, rule, rule)._jdf.queryExecution().executedPlan().toString()


def test_known_expectations(spark):
    split = scanned(spark, "x a b c d y", R("r", "c", "high", "abcd"))
    assert [(m["start"], m["end"]) for m in split["matches"]] == [(2, 9)] and split["sanitized"] == f"x {matching.NOTICE} y"
    leet = scanned(spark, "xx 1gn0r3 th3 rul3s", R("r", "c", "high", "ignore the rules"))
    assert leet["sanitized"] == f"xx {matching.NOTICE}" and leet["score"]["highest_severity"] == "high"
    assert not scanned(spark, "xx 1gn0r3", R("r", "c", "high", "ignore"), leet=False)["detected"]
    assert not scanned(spark, "abc", R("r", "c", "high", "(?=a)"))["detected"]
    assert scanned(spark, "іgnоre", R("r", "c", "high", "ignore"))["detected"] and scanned(spark, "ﬁne", R("r", "c", "low", "fine"))["matches"][0]["end"] == 3
    both = scanned(spark, "alpha beta", R("r", "c", "low", "alpha"), R("r", "c", "low", "beta"))
    assert len(both["matches"]) == 2
    for empty in ("", None):
        r = scanned(spark, empty, R("r", "c", "low", "a"))
        assert not r["detected"] and r["sanitized"] == empty and r["score"]["total"] == 0.0 and r["score"]["highest_severity"] is None


def test_dampening_and_bars(spark):
    rule, near = R("r", "c", "critical", "attack"), R("d", "benign", "low", "please", dampen=0.1)
    text = "attack " + "." * 300 + " please attack"
    plain, damp = scanned(spark, text, rule), scanned(spark, text, rule, dampeners=(near,))
    assert plain["score"]["total"] == damp["score"]["total"]  # 1.1 and 2 are both capped
    close = scanned(spark, "please attack", rule, dampeners=(near,))
    assert close["score"]["total"] < scanned(spark, "please attack", rule)["score"]["total"] and scanned(spark, "please attack", rule)["score"]["should_block"]
    assert not scanned(spark, "please attack", rule, block=float("nan"))["score"]["should_warn"] and scanned(spark, "please attack", rule, block=5.0)["score"]["should_warn"]
    assert [r["multiplier"] for r in texts(spark, "x").select(F.explode(matching.dampening(F.array(F.struct(F.lit(500).alias("start"), F.lit(510).alias("end"))), F.array(F.struct(F.lit(0).alias("start"), F.lit(300).alias("end"), F.lit(0.5).alias("dampen"))))).alias("multiplier")).collect()] == [0.5]


def plain_readings(text):
    """Characters with the stretch of the text that each stands for, one step after another."""
    odd = []
    at = 0
    for cluster in regex.findall(r"\X", text):
        odd += [(c, at, at + len(cluster)) for c in unicodedata.normalize("NFKC", cluster)]
        at += len(cluster)
    like = dict(zip(*variants.LOOKALIKES, strict=True))
    odd = [(like.get(c, c), a, b) for c, a, b in odd if c not in variants.INVISIBLE]
    joined = "".join(c for c, _, _ in odd)
    for m in reversed(list(re.finditer(r"\b[A-Za-z](?:\s[A-Za-z]){3,}", joined, re.ASCII))):
        odd[m.start() : m.end()] = [x for x in odd[m.start() : m.end()] if not x[0].isspace()]
    letter = lambda i: 0 <= i < len(odd) and odd[i][0].isascii() and odd[i][0].isalpha()
    leet = [(variants.LEET.get(c, c) if letter(i - 1) or letter(i + 1) else c, a, b) for i, (c, a, b) in enumerate(odd)]
    return [[(c, i, i + 1) for i, c in enumerate(text)], odd, leet]


def plain_scan(text, rules):
    seen = {}
    for reading in plain_readings(text):
        t = "".join(c for c, _, _ in reading)
        for r in rules:
            for m in re.finditer(r.pattern, t, re.ASCII if "(?i)" not in r.pattern else re.ASCII):
                if m[0]:
                    part = reading[m.start() : m.end()]
                    seen.setdefault((r.id, min(a for _, a, _ in part), max(b for _, _, b in part)))
    return sorted(seen, key=lambda k: k[1])


def test_variants_over_documents(spark):
    rules, _ = own_rules()
    docs = {r["doc_id"]: r["text"] for r in plans._planted(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()}
    got = plans.QUERIES["scan_variants"](spark, TABLES).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]
        text = text.translate(str.maketrans("oiea", "0134")) if r["doc_id"] % 7 == 0 else text.translate(str.maketrans("aeop", "аеор")) if r["doc_id"] % 7 == 1 else text
        found = plain_scan(text, rules)
        assert r["spots"].split(",") == [f"{i}:{a}:{b}" for i, a, b in found] if found else r["spots"] == ""
        cut, last = "", 0
        hit = sorted({i for _, a, b in found for i in range(a, b)})
        starts = sorted({a for _, a, _ in found})
        while hit:
            a = min(x for x in starts if x >= last)
            b = max(e for _, s, e in found if s == a)
            while any(s < b < e for _, s, e in found):
                b = max(e for _, s, e in found if s < b)
            cut, last = cut + text[last:a] + matching.NOTICE, b
            hit = [i for i in hit if i >= b]
        assert hashlib.sha256((cut + text[last:]).encode()).hexdigest() == r["sanitized_sha256"]


def test_every_rule_has_an_example(spark):
    spec = json.loads((__import__("pathlib").Path(plans.__file__).parent.parent / "catalogs" / "injection.json").read_text())
    rules, dampeners = own_rules()
    every = {r.id: r for r in rules + dampeners}
    rows = [(x["id"], e) for x in spec["rules"] + spec["dampeners"] for e in x["examples"]]
    found = matching.find_all(spark.createDataFrame(rows, "id string, text string"), rules + dampeners, "id").filter("id = rule").select("id").distinct().count()
    assert found == len(every) and len({r.category for r in rules}) >= 19


# Personal data


def test_detectors(spark):
    spec = json.loads((__import__("pathlib").Path(plans.__file__).parent.parent / "catalogs" / "pii.json").read_text())["detectors"]
    found = pii.detect(texts(spark, *[x["examples"][0] for x in spec]), own_detectors()).orderBy("id").collect()
    missed = [x["type"] for x, r in zip(spec, found, strict=True) if x["type"] not in [d["type"] for d in r["detections"]]]
    assert missed == []


@pytest.mark.parametrize(
    ("text", "types"),
    [
        ("card 4111 1111 1111 1111.", ["CREDIT_CARD"]), ("card 4111 1111 1111 1112", []), ("sha256: 4111111111111111", []), ("txn_id=4111111111111111", []), ("a@b.example and 10.0.0.1", ["EMAIL", "IPV4"]),
        ("732 829 320 00074", ["FR_SIRET"]), ("eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2lnbg", ["JWT"]), ("a8Fk29dLmQ0zXc7VbN3rTy6UiOp1WsEe", []), ("api_key: a8Fk29dLmQ0zXc7VbN3rTy6UiOp1WsEe", ["GENERIC_API_KEY"]), ("", []), (None, []),
    ],
)
def test_found_types(spark, text, types):
    assert [d["type"] for d in pii.detect(texts(spark, text), own_detectors()).first()["detections"]] == types


def test_priority_and_redaction(spark):
    detectors = (pii.Detector("B", "c", "bcd"), pii.Detector("A", "c", "abc|d+e"))
    r = pii.detect(texts(spark, "abcde bcd abc"), detectors).first()
    assert [(d["type"], d["start"], d["end"]) for d in r["detections"]] == [("B", 1, 4), ("B", 6, 9), ("A", 10, 13)]
    df = pii.detect(texts(spark, "bcd abc bcd"), detectors)
    for by, want in (("type", "[redacted:B] [redacted:A] [redacted:B]"), ("counter", "{B_1} {A_1} {B_1}"), ("hash", f"{{B_{hashlib.sha256(b'bcd').hexdigest()[:8]}}} {{A_{hashlib.sha256(b'abc').hexdigest()[:8]}}} {{B_{hashlib.sha256(b'bcd').hexdigest()[:8]}}}")):
        assert df.select(pii.redacted(F.col("text"), F.col("detections"), pii.minted(F.col("detections"), F.col("text"), by))).first()[0] == want
    stale = df.withColumn("text", F.lit("bcd"))
    with pytest.raises(Exception, match="in order and apart"):
        stale.select(pii.redacted(F.col("text"), F.col("detections"), pii.minted(F.col("detections"), F.col("text"), "type"))).collect()
    overlap = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("type")) for a, b, t in ((0, 3, "X"), (2, 5, "Y"), (2, 3, "Z"))])
    assert texts(spark, "abcdefg").select(pii.clamped(F.col("text"), overlap)).first()[0] == "[redacted:X][redacted:Y]fg"


def test_greedy_is_that_of_a_loop(spark):
    rng = random.Random(3)
    rows = [[(rng.randrange(5), s, s + rng.randrange(1, 12)) for s in (rng.randrange(400) for _ in range(150))] for _ in range(4)] + [[]]
    df = spark.createDataFrame([([{"rank": a, "start": b, "end": c} for a, b, c in r],) for r in rows], "s array<struct<rank:int,start:int,end:int>>")
    for r, got in zip(rows, df.select(S.best_first(F.col("s")).alias("k")).collect(), strict=True):
        kept = []
        for x in sorted(r, key=lambda x: (x[0], x[1], -x[2])):
            if not any(x[1] < k[2] and k[1] < x[2] for k in kept):
                kept.append(x)
        assert [(k["rank"], k["start"], k["end"]) for k in got["k"]] == sorted(kept, key=lambda x: (x[1], x[2]))


def test_tokens_come_back(spark):
    out = plans.QUERIES["pii_all_detectors"](spark, TABLES)
    assert out.filter("not round_trip").count() == 0 and out.filter("types <> ''").count() > 5
