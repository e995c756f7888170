"""Queries over request logs, reports and validators, with the same in DuckDB SQL.

Logs, reports and numbers are made from the driver's tables by expressions that both engines share; what is done with
them is not shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _quoted
from ..functions import text as T
from ..functions import wire
from ..operators import attachments, audit, matching, provenance
from ..sources.tables import json_lines, table
from ..sources.versions import Versions, shared_folder

NOW = "2024-07-01 00:00:00"
#: A request log of events: name and expression, in SQL that Spark and DuckDB share; lists are made from the second half on.
LOG = {
    "event_id": "event_id", "ts": "ts", "target_host": "CASE user_id % 4 WHEN 0 THEN 'api.a.example' WHEN 1 THEN 'b.example' WHEN 2 THEN 'c.example' END", "detected": "event_id % 5 = 0", "match_count": "CAST(CASE WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INT)",
    "body_size": "CAST(event_id % 1000 AS BIGINT)", "scan_duration_s": "value / 1000", "ml_score": "CASE WHEN event_id % 3 = 0 THEN value / 1000 END", "fused_score": "value / 2000", "entropy_anomaly": "value / 3000", "inspection_performed": "event_id % 4 <> 1",
    "skip_reason": "CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'unsupportedContentEncoding' WHEN event_id % 3 = 0 THEN 'oversized' END END", "media_findings": "CAST(event_id % 6 - 4 AS INT)",
}
_LOG = "l AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in LOG.items()) + ", event_type FROM events)"
_VERDICT = "(detected AND skip_reason IS DISTINCT FROM 'unsupportedContentEncoding')"


def _logs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {n}" for n, x in LOG.items()], "event_type")
    return e.withColumns({"pattern_names": F.when(F.col("match_count") > 0, F.array(F.lit("z"), "event_type")).otherwise(F.array().cast("array<string>")), "categories": F.array("event_type", F.lit("all")), "severities": F.array(F.lit("high"))})


def scan_log(spark, sf_dir):
    rows = audit.scan_log_rows(_logs(spark, sf_dir))
    return rows.groupBy("source", "severity").agg(F.count("*").alias("n"), F.sum("detected").alias("detected"), F.sum("request_size").alias("bytes"), F.count_if(F.col("pattern_ids") != "[]").alias("named"))


def metric_counters(spark, sf_dir):
    return audit.counters(audit.metric_samples(_logs(spark, sf_dir)))


def hits_by_category(spark, sf_dir):
    return audit.hits_by(audit.metric_samples(_logs(spark, sf_dir)), "categories")


def blocks_by_host(spark, sf_dir):
    return audit.blocks_by_host(audit.metric_samples(_logs(spark, sf_dir)))


def activity_counters(spark, sf_dir):
    return audit.activity(_logs(spark, sf_dir))


def attachment_counts(spark, sf_dir):
    return audit.attachments(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("path")), "l_orderkey", "path")


def recent_by_type(spark, sf_dir):
    return audit.by_group(table(spark, sf_dir, "events"), "event_type", "ts", NOW, 3000)


def audit_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.totals(e.filter("value > 100"), e)


def redaction_report(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return audit.redaction_report(logs.filter("detected"), logs, "event_type").select("redactions", "prompts", "integrity_sha256", F.size("by_type").alias("n_types"), F.size("by_host").alias("n_hosts"))


def audit_events(spark, sf_dir):
    """Blocks as JSON lines, read again."""
    lines = _logs(spark, sf_dir).filter("detected").select("event_id", audit.audit_event("injection_blocked", "1.0").alias("j"))
    keys = F.array_join(F.json_object_keys("j"), ",")
    return lines.select("event_id", F.get_json_object("j", "$.host").alias("host"), F.get_json_object("j", "$.bodySize").cast("long").alias("bytes"), F.get_json_object("j", "$.timestamp").alias("at"), (keys == "appVersion,bodySize,event,host,matchCount,patterns,severity,timestamp").alias("whole"))


def diagnostics_bundle(spark, sf_dir):
    """A bundle of counters, days and events, whose hosts are shown only if allowed."""
    logs = _logs(spark, sf_dir)
    daily = logs.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("scanned"), F.count_if("detected").alias("blocked"))
    events = audit.diagnostic_events(audit.scan_log_rows(logs), ["b.example"])
    b = audit.diagnostics(audit.counters(audit.metric_samples(logs)), daily, events, {"app": "1.0"})
    return b.select(F.get_json_object("bundle", "$.metrics.blocked").cast("long").alias("blocked"), F.json_array_length(F.get_json_object("bundle", "$.dailyStats")).cast("long").alias("days"), F.json_array_length(F.get_json_object("bundle", "$.recentEvents")).cast("long").alias("events"), F.get_json_object("bundle", "$.dailyStats[0].day").alias("newest"))


def diagnostic_events(spark, sf_dir):
    rows = audit.scan_log_rows(_logs(spark, sf_dir)).withColumn("pattern_ids", F.when(F.col("request_size") % 9 == 0, "{broken").otherwise(F.col("pattern_ids")))
    return audit.diagnostic_events(rows, ["b.example"]).groupBy("target_host", "detector").agg(F.count("*").alias("n"), F.sum(F.size("pattern_ids")).alias("ids"))


def merged_scans(spark, sf_dir):
    """Scans of a request's address and of its body as one."""
    side = lambda shift: F.struct(
        ((F.col("event_id") + shift) % 5 == 0).alias("detected"), ((F.col("event_id") + shift) % 3).alias("match_count"), F.array(F.lit("n"), F.col("event_type")).alias("names"), F.array(F.lit(f"c{shift}")).alias("categories"), F.array(F.lit("high")).alias("severities"),
        F.when((F.col("event_id") + shift) % 3 > 0, F.col("value") + shift).alias("ml_score"), (F.col("value") * (1 + shift)).alias("entropy_anomaly"), (F.col("value") - shift).alias("fused_score"),
    )
    m = table(spark, sf_dir, "events").select("event_id", audit.merged_scans(side(0), side(1)).alias("m")).select("event_id", "m.*")
    return m.select("event_id", "detected", "match_count", F.array_join("names", ",").alias("names"), F.array_join("categories", ",").alias("categories"), "ml_score", "entropy_anomaly", "fused_score")


def benchmark_tally(spark, sf_dir):
    return audit.tally(table(spark, sf_dir, "events").select("event_type", (F.col("value") / 200).alias("score")), "event_type", "score", matching.BLOCK, matching.WARN)


def detection_quality(spark, sf_dir):
    """Gold and predicted sets of (order, flag), with the macro row."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return audit.set_quality(l.filter("l_linenumber <= 3"), l.filter("l_quantity > 10"), "l_orderkey", "l_returnflag")


def label_entities(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, ("B-GIVENNAME", "I-CITY", "O", "B-PASSPORT", "EMAIL"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select(audit.entity_of(label).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def download_maps(spark, sf_dir):
    m = audit.count_maps(table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", (F.col("user_id") % 3).alias("channel")), "day", ["event_type", "channel"])
    return m.select("day", "total", F.size("by_event_type").alias("types"), F.element_at("by_channel", F.lit("1")).alias("channel_1"))


def surviving_rows(spark, sf_dir):
    """Lines of orders that are still kept."""
    kept = audit.retained(table(spark, sf_dir, "events"), "ts", NOW, 3000).select(F.col("event_id").alias("l_orderkey"))
    return audit.surviving(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey")


REPORT = {
    "event_id": "event_id", "app_version": "CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '  2.0  ' ELSE '1.0' END", "target_host": "CASE event_id % 13 WHEN 0 THEN 'a/b' WHEN 1 THEN 'me@x' ELSE ' host.example ' END", "locator": "repeat('x', CAST(event_id % 400 AS INT))",
    "fingerprint": "CASE event_id % 7 WHEN 0 THEN 'abc' ELSE repeat('0a', 32) END", "excerpt": "CASE event_id % 17 WHEN 0 THEN '  ' ELSE repeat('é', CAST(event_id % 5000 AS INT) + 1) END", "fused_score": "value / 400", "entropy_anomaly": "0.5", "benign_multiplier": "1.0",
    "ml_score": "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0.5 END", "top_window_score": "0.1", "match_count": "event_id - 3", "top_window": "CAST(NULL AS VARCHAR(10))", "note": "CASE event_id % 2 WHEN 0 THEN '   ' ELSE ' n ' END",
}


def sound_reports(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {n}" for n, x in REPORT.items()]).withColumn("pattern_names", F.transform(F.sequence(F.lit(0), F.col("event_id") % 30), lambda i: F.concat(F.lit(" p"), i.cast("string"))))
    return audit.sound_reports(r).select("event_id", "app_version", "target_host", F.length("locator").alias("locator"), F.length("excerpt").alias("excerpt"), "note", F.array_join("pattern_names", ",").alias("names"))


def quota_from_first(spark, sf_dir):
    q = audit.quota_from_first(table(spark, sf_dir, "events"), "event_type", "ts", 1, 3600)
    return q.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), "n", "accepted", "refused")


def claimed_once(spark, sf_dir):
    q = audit.claimed_once(table(spark, sf_dir, "events").withColumn("nonce", F.col("user_id") % 50), "nonce", "ts", 7200)
    return q.select("nonce", F.date_format("claimed", "yyyy-MM-dd HH:mm:ss.SSS").alias("claimed"), "replays")


def burst_notices(spark, sf_dir):
    return audit.notified(table(spark, sf_dir, "events"), "event_type", "event_id", "ts", 3, 3600)


def retained_events(spark, sf_dir):
    return audit.retained(table(spark, sf_dir, "events"), "ts", NOW, 3000).select("event_id")


def stats_history(spark, sf_dir):
    """The newest 30 days that have a row, and which of them is the newest: a top-k report and a point lookup."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("scanned"))
    last = daily.agg(F.max("day").alias("last"))
    return daily.orderBy(F.desc("day")).limit(30).join(F.broadcast(last)).select("day", "scanned", (F.col("day") == F.col("last")).alias("newest"))


def top_findings(spark, sf_dir):
    """The finding with the highest fused score of each user, and what all of its names are."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


def fused_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") % 1).alias("rules"), F.when(F.col("event_id") % 4 > 0, F.col("value") * 7 % 1).alias("ml"), (F.col("value") * 3 % 1).alias("entropy"))
    e = e.withColumn("fused", matching.fused(F.col("rules"), F.col("ml"), F.col("entropy")))
    notice = provenance.whole_notice(F.lit("body"), (F.col("event_id") % 2).cast("int"), F.col("fused") >= matching.BLOCK)
    return e.select("event_id", F.round("fused", 6).alias("fused"), notice.isNotNull().alias("whole"))


def jsonl_samples(spark, sf_dir):
    """Samples in JSON lines, of which some are broken."""
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}x"))).when(F.col("event_id") % 5 == 1, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("line"))
    return json_lines(lines, "line", "k long").groupBy("k").agg(F.count("*").alias("n"))


def base64_media(spark, sf_dir):
    """Data URLs and base64 texts, with white space and broken ones among them."""
    data = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    url = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("data:image/gif;base64,"), F.regexp_replace(data, "(.{10})", "$1\n"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("data:,"), data)).otherwise(F.concat(F.lit("data:;base64,*"), data))
    m = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", attachments.from_data_url(url).alias("m"))
    return m.select("conv_id", "turn", "m.media_type", F.sha2("m.data", 256).alias("data_sha256"))


def proofs_of_work(spark, sf_dir):
    ok = wire.proof_of_work(F.col("event_type"), F.col("event_id").cast("string"), 4, F.col("user_id") % 200 - 40)
    return table(spark, sf_dir, "events").select("event_id", ok.alias("ok"))


def safe_headers(spark, sf_dir):
    of = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("event_id") % len(v)).cast("int"))
    name, value = of("X-A", "Connection", "bad name", "keep-alive", ""), of("v", "v\r\nw", "")
    files = wire.file_name(of("a b.txt", "../x", "/", "ok_1"))
    head = F.unhex(of("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "474946383961", "52494646000000005745425000", "49443304", "FFFB90", "0000001866747970" + "68656963", "0000001866747970" + "4D344120", "00"))
    return table(spark, sf_dir, "events").select("event_id", wire.safe_header(name, value).alias("safe"), wire.hop_by_hop(name).alias("hop"), files.alias("file"), wire.sniff(head).alias("kind"))


#: Numbers for the validators, in SQL that both engines share, from n.
NUMBERS = {
    "card": "'4' || lpad(CAST(n AS VARCHAR(20)), 15, '7')", "siren": "CASE n % 9 WHEN 0 THEN '000000000' ELSE lpad(CAST(n AS VARCHAR(20)), 9, '1') END", "ssn": "lpad(CAST(n % 1000 AS VARCHAR(20)), 3, '0') || '-' || lpad(CAST(n % 100 AS VARCHAR(20)), 2, '0') || '-' || lpad(CAST(n % 10000 AS VARCHAR(20)), 4, '0')",
    "nhs": "CASE n % 9 WHEN 0 THEN '0000000000' ELSE lpad(CAST(n AS VARCHAR(20)), 10, '9') END", "siret": "CASE n % 3 WHEN 0 THEN '356000000' || lpad(CAST(n % 100000 AS VARCHAR(20)), 5, '0') ELSE lpad(CAST(n AS VARCHAR(20)), 14, '2') END",
    "nir": "CAST(1 + n % 3 AS VARCHAR(20)) || '85' || lpad(CAST(n % 25 AS VARCHAR(20)), 2, '0') || CASE n % 4 WHEN 0 THEN '2A' WHEN 1 THEN '2B' ELSE '75' END || lpad(CAST(n % 1000000 AS VARCHAR(20)), 6, '0') || lpad(CAST(n % 97 + 1 AS VARCHAR(20)), 2, '0')",
    "nino": "substr('ABGDKZTN', CAST(n % 8 AS INT) + 1, 1) || substr('BGNKTZAO', CAST(n % 7 AS INT) + 1, 1) || lpad(CAST(n % 1000000 AS VARCHAR(20)), 6, '0') || substr('ABCDE', CAST(n % 5 AS INT) + 1, 1)",
    "postcode": "substr('ABQSWJ', CAST(n % 6 AS INT) + 1, 1) || substr('0123456789AIKZ', CAST(n % 14 AS INT) + 1, 1) || CASE n % 5 WHEN 0 THEN '' ELSE substr('19WXA', CAST(n % 5 AS INT) + 1, 1) END || ' ' || substr('0A9', CAST(n % 3 AS INT) + 1, 1) || substr('ACMZ', CAST(n % 4 AS INT) + 1, 1) || 'B'",
    "npi": "CASE n % 9 WHEN 0 THEN '1111111111' ELSE lpad(CAST(n AS VARCHAR(20)), 10, '1') END", "ipv6": "CASE n % 8 WHEN 0 THEN '::' WHEN 1 THEN 'fe80::' || CAST(n AS VARCHAR(20)) WHEN 2 THEN '1:2:3:4:5:6:7:8' WHEN 3 THEN '1:2:3:4:5:6:7:a' WHEN 4 THEN '1::2::3' WHEN 5 THEN 'ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff' WHEN 6 THEN '1:2:3' ELSE '2001:db8::1' END",
    "token": "CASE n % 4 WHEN 0 THEN 'eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln' WHEN 1 THEN 'eyJhIjoxfQ.b.c' WHEN 2 THEN 'eyJhbGciOjF9.b.c' ELSE 'a.b' END",
    "secret": "CASE n % 3 WHEN 0 THEN 'a8Fk29dLmQ0zXc7VbN3rTy6UiOp1WsEe' WHEN 1 THEN repeat('a1', 20) ELSE 'a8Fk29dLm' END",
}
_N = "SELECT doc_id, doc_id * 7919 + 12345 AS n FROM documents"


def validators(spark, sf_dir):
    """All validators on numbers made from ids, right and wrong ones."""
    made = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id * 7919 + 12345 AS n").selectExpr("doc_id", *[f"{x} AS {n}" for n, x in NUMBERS.items()])
    check = {"card": T.luhn, "siren": T.siren, "ssn": T.ssn, "nhs": T.nhs, "siret": T.siret, "nir": T.nir, "nino": T.nino, "postcode": T.postcode, "npi": T.npi, "ipv6": T.ipv6, "token": T.jwt, "secret": T.generic_secret}
    return made.select("doc_id", *[f(F.col(n)).alias(n) for n, f in check.items()])


def split_letters(spark, sf_dir):
    """Single letters with blanks between them drawn together, and what document elements hold."""
    t = table(spark, sf_dir, "conversations").filter("text is not null").selectExpr("conv_id", "turn", "'so i g n o r e <document>' || text || '</document> a b c' AS text")
    return t.select("conv_id", "turn", F.sha2(T.joined_letters(F.col("text")), 256).alias("joined_sha256"), F.sha2(F.array_join(T.wrapped(F.col("text")), "|"), 256).alias("wrapped_sha256"))


def _halves(spark, sf_dir, *columns):
    e = table(spark, sf_dir, "events").select(*columns)
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


def stored_daily(spark, sf_dir):
    """Counters by day in a table that two batches change, the second of which is sent twice."""
    stats = Versions(spark, shared_folder(spark), "day date, scanned long, blocked long")
    daily = lambda e: e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("scanned"), F.count_if(F.col("value") > 100).alias("blocked"))
    even, odd = map(daily, _halves(spark, sf_dir, "event_id", "ts", "value"))
    for batch, delta in (("even", even), ("odd", odd), ("odd", odd)):
        stats.add_up(batch, delta, "day")
    return stats.rows.withColumn("day", F.col("day").cast("string"))


def stored_newest(spark, sf_dir):
    """The hundred newest events of two batches, from a store that holds no more."""
    store = Versions(spark, shared_folder(spark), "event_id long, ts timestamp_ntz, event_type string")
    for i, half in enumerate(_halves(spark, sf_dir, "event_id", "ts", "event_type")):
        store.keep_newest(f"half-{i}", half, [F.desc("ts"), F.desc("event_id")], 100)
    return store.rows.select("event_id", "event_type")


def stored_within_quota(spark, sf_dir):
    """Two batches of writes, of which a table takes two for each type and hour; then those that have expired go."""
    store = Versions(spark, shared_folder(spark), "event_id long, ts timestamp_ntz, event_type string")
    for i, half in enumerate(_halves(spark, sf_dir, "event_id", "ts", "event_type")):
        store.insert_within(f"half-{i}", half, "event_type", "ts", "event_id", 2, "hour")
    store.drop_expired("clean", "ts", "2024-01-20 00:00:00", 10)
    return store.rows.select("event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        scan_log, metric_counters, hits_by_category, blocks_by_host, activity_counters, attachment_counts, recent_by_type, audit_totals, redaction_report, audit_events, diagnostics_bundle, diagnostic_events, merged_scans, benchmark_tally, detection_quality,
        label_entities, download_maps, surviving_rows, sound_reports, quota_from_first, claimed_once, burst_notices, retained_events, stats_history, top_findings, fused_scores, jsonl_samples, base64_media, proofs_of_work, safe_headers, validators, split_letters, stored_daily, stored_newest, stored_within_quota,
    )
}

_WINDOWS = "RECURSIVE e AS (SELECT {k} AS k, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM {t} GROUP BY ALL), w AS (SELECT k, min(ms) AS start FROM e GROUP BY k UNION ALL SELECT e.k, min(e.ms) FROM w JOIN e ON e.k = w.k AND e.ms >= w.start + {ms} GROUP BY e.k, w.start), f AS (SELECT w.k, w.start, sum(n)::BIGINT AS n FROM w JOIN e ON e.k = w.k AND e.ms >= w.start AND e.ms < w.start + {ms} GROUP BY ALL)"
_OF = lambda *v: f"(CASE event_id % {len(v)} " + " ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(v)) + " END)"
_SUM = lambda d, n: f"list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN ({n} - i) % 2 = 0 THEN substr({d}, i, 1)::INT WHEN substr({d}, i, 1)::INT > 4 THEN 2 * substr({d}, i, 1)::INT - 9 ELSE 2 * substr({d}, i, 1)::INT END)) % 10 = 0"
SQL = {
    "stored_daily": "SELECT ts::DATE::VARCHAR AS day, count(*) AS scanned, count(*) FILTER (value > 100) AS blocked FROM events GROUP BY 1",
    "stored_newest": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "stored_within_quota": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id % 2, ts, event_id) AS nth FROM events) SELECT event_id, event_type FROM r WHERE nth <= 2 AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY",
    "scan_log": f"""WITH {_LOG} SELECT CASE WHEN inspection_performed THEN 'gateway' ELSE 'gateway-uninspected-' || coalesce(skip_reason, 'unknown') END AS source, CASE WHEN {_VERDICT} THEN 'high' END AS severity, count(*) AS n, count(*) FILTER ({_VERDICT}) AS detected, sum(body_size)::BIGINT AS bytes, count(*) FILTER (match_count > 0) AS named FROM l GROUP BY 1, 2""",
    "metric_counters": f"WITH {_LOG} SELECT count(*) AS requests, count(*) FILTER (detected) AS blocked, count(*) FILTER (media_findings > 0) AS rewritten, count(*) FILTER (skip_reason = 'oversized') AS oversized, coalesce(sum(body_size) FILTER (inspection_performed), 0)::BIGINT AS bytes FROM l",
    "hits_by_category": "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events",
    "blocks_by_host": f"WITH {_LOG} SELECT target_host, count(*) AS n FROM l WHERE detected AND target_host IS NOT NULL GROUP BY 1",
    "activity_counters": f"WITH {_LOG} SELECT count(*) FILTER (inspection_performed) AS scanned, count(*) FILTER (NOT inspection_performed) AS skipped, count(*) FILTER ({_VERDICT}) AS blocked, count(*) FILTER (detected AND skip_reason = 'unsupportedContentEncoding') AS blocked_unread, count(*) FILTER (NOT detected AND match_count > 0) AS flagged FROM l",
    "attachment_counts": "SELECT l_orderkey, count(*) AS entities, count(DISTINCT l_partkey % 3) AS attachments FROM lineitem GROUP BY 1",
    "recent_by_type": f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3000 DAY GROUP BY 1",
    "audit_totals": "SELECT count(*) FILTER (value > 100) AS redactions, count(*) AS prompts FROM events",
    "redaction_report": f"""WITH {_LOG}, t AS (SELECT event_type AS k, count(*) AS n FROM l WHERE detected GROUP BY 1), h AS (SELECT target_host AS k, count(*) AS n FROM l WHERE detected AND target_host IS NOT NULL GROUP BY 1), s AS (SELECT count(*) FILTER (detected) AS r, count(*) AS p FROM l)
        SELECT r AS redactions, p AS prompts, sha256((SELECT string_agg('t:' || k || '=' || n || chr(10), '' ORDER BY k) FROM t) || (SELECT string_agg('h:' || k || '=' || n || chr(10), '' ORDER BY k) FROM h) || 'totals:r=' || r || ',p=' || p) AS integrity_sha256, (SELECT count(*) FROM t) AS n_types, (SELECT count(*) FROM h) AS n_hosts FROM s""",
    "audit_events": f"WITH {_LOG} SELECT event_id, target_host AS host, body_size AS bytes, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, target_host IS NOT NULL AS whole FROM l WHERE detected",
    "diagnostics_bundle": f"WITH {_LOG} SELECT count(*) FILTER (detected) AS blocked, least(30, count(DISTINCT ts::DATE)) AS days, least(200, count(*)) AS events, max(ts::DATE)::VARCHAR AS newest FROM l",
    "diagnostic_events": f"""WITH {_LOG} SELECT CASE WHEN target_host = 'b.example' THEN target_host END AS target_host, CASE WHEN match_count > 0 THEN 'regex' WHEN {_VERDICT} THEN 'ml' ELSE 'none' END AS detector, count(*) AS n, sum(CASE WHEN match_count > 0 AND body_size % 9 <> 0 THEN 2 ELSE 0 END)::BIGINT AS ids FROM l GROUP BY 1, 2""",
    "merged_scans": """SELECT event_id, event_id % 5 = 0 OR (event_id + 1) % 5 = 0 AS detected, event_id % 3 + (event_id + 1) % 3 AS match_count, array_to_string(list_sort(['n', event_type]), ',') AS names, 'c0,c1' AS categories,
        CASE event_id % 3 WHEN 0 THEN value + 1 WHEN 1 THEN greatest(value, value + 1) ELSE value END AS ml_score, greatest(value, value * 2) AS entropy_anomaly, value AS fused_score FROM events""",
    "benchmark_tally": f"WITH s AS (SELECT event_type, value / 200 AS s FROM events), n AS (SELECT event_type, count(*) AS n, count(*) FILTER (s >= {matching.BLOCK}) AS blocked, count(*) FILTER (s >= {matching.WARN} AND s < {matching.BLOCK}) AS flagged FROM s GROUP BY 1) SELECT *, round(blocked / n * 100, 1) AS block_pct, round(flagged / n * 100, 1) AS flag_pct FROM n",
    "detection_quality": """WITH g AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS f FROM lineitem WHERE l_linenumber <= 3), p AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS f FROM lineitem WHERE l_quantity > 10),
        tp AS (SELECT f, count(*) AS n FROM (SELECT * FROM g INTERSECT SELECT * FROM p) GROUP BY f), fp AS (SELECT f, count(*) AS n FROM (SELECT * FROM p EXCEPT SELECT * FROM g) GROUP BY f), fn AS (SELECT f, count(*) AS n FROM (SELECT * FROM g EXCEPT SELECT * FROM p) GROUP BY f),
        k AS (SELECT f AS l_returnflag, coalesce(tp.n, 0) AS tp, coalesce(fp.n, 0) AS fp, coalesce(fn.n, 0) AS fn FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) LEFT JOIN tp USING (f) LEFT JOIN fp USING (f) LEFT JOIN fn USING (f)),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM k)
        SELECT l_returnflag, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM q UNION ALL SELECT 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6) FROM q""",
    "label_entities": "SELECT CASE event_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ADDRESS' WHEN 3 THEN 'PASSPORT' WHEN 4 THEN 'EMAIL' END AS entity, count(*) AS n FROM events GROUP BY 1",
    "download_maps": "SELECT ts::DATE::VARCHAR AS day, count(*) AS total, count(DISTINCT event_type) AS types, nullif(count(*) FILTER (user_id % 3 = 1), 0) AS channel_1 FROM events GROUP BY 1",
    "surviving_rows": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3000 DAY)",
    "sound_reports": "WITH r AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in REPORT.items()) + """ FROM events) SELECT event_id, trim(app_version) AS app_version, trim(target_host) AS target_host, least(300, length(locator)) AS locator, least(4096, length(excerpt)) AS excerpt, nullif(trim(note), '') AS note,
        array_to_string(list_transform(range(least(20, event_id % 30 + 1)), lambda i: 'p' || i), ',') AS names FROM r
        WHERE event_id % 11 <> 0 AND event_id % 13 > 1 AND event_id % 400 > 0 AND event_id % 7 <> 0 AND event_id % 17 <> 0 AND fused_score BETWEEN 0 AND 1 AND event_id % 3 <> 1 AND match_count BETWEEN 0 AND 100000""",
    "quota_from_first": f"WITH {_WINDOWS.format(k='event_type', t='events', ms=3600000)} SELECT k AS event_type, strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M:%S.%g') AS start, n, least(n, 1) AS accepted, greatest(n - 1, 0) AS refused FROM f",
    "claimed_once": f"WITH {_WINDOWS.format(k='user_id % 50', t='events', ms=7200000)} SELECT k AS nonce, strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M:%S.%g') AS claimed, n - 1 AS replays FROM f",
    "burst_notices": f"""WITH RECURSIVE c AS (SELECT event_id, event_type, ts, epoch_us(ts) // 1000 AS ms, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY event_type, epoch_us(ts) // 1000 ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM events),
        b AS (SELECT * FROM c WHERE n > 3), {_WINDOWS.format(k="event_type", t="b", ms=3600000).removeprefix("RECURSIVE ")}, s AS (SELECT min(event_id) AS event_id FROM b JOIN f ON f.k = b.event_type AND f.start = b.ms GROUP BY k, start)
        SELECT event_id, CASE WHEN n <= 3 THEN 'individual' WHEN event_id IN (SELECT event_id FROM s) THEN 'summary' ELSE 'suppress' END AS decision, n FROM c""",
    "retained_events": f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3000 DAY",
    "stats_history": "SELECT day, scanned, day = max(day) OVER () AS newest FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS scanned FROM events GROUP BY 1) ORDER BY day DESC LIMIT 30",
    "top_findings": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS p FROM events) SELECT user_id, min(event_id) FILTER (p = 1) AS event_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names FROM r GROUP BY user_id",
    "fused_scores": f"""WITH e AS (SELECT event_id, value % 1 AS r, CASE WHEN event_id % 4 > 0 THEN value * 7 % 1 END AS m, value * 3 % 1 AS h FROM events), f AS (SELECT event_id, CASE WHEN greatest(r, coalesce(m, 0)) >= 0.85 THEN greatest(r, coalesce(m, 0)) ELSE 0.5 * r + 0.4 * coalesce(m, 0) + 0.1 * h END AS f FROM e)
        SELECT event_id, round(f, 6) AS fused, f >= {matching.BLOCK} AND event_id % 2 = 0 AS whole FROM f""",
    "jsonl_samples": "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events WHERE event_id % 5 > 1 GROUP BY 1",
    "base64_media": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'image/gif' WHEN 2 THEN 'image/png' END AS media_type, CASE turn % 3 WHEN 0 THEN sha256(text) END AS data_sha256 FROM conversations WHERE text IS NOT NULL",
    "proofs_of_work": "SELECT event_id, left(sha256(event_type || event_id), 1) = '0' AND user_id % 200 - 40 BETWEEN -30 AND 120 AS ok FROM events",
    "safe_headers": f"""SELECT event_id, event_id % 5 IN (0, 1, 3) AND event_id % 3 <> 1 AS safe, event_id % 5 IN (1, 3) AS hop, {_OF("ab.txt", "..x", "file", "ok_1")} AS file, {_OF("pdf", "image", "image", "image", "image", "audio", "audio", "image", "audio", "none")} AS kind FROM events""".replace("THEN 'none'", "THEN NULL"),
    "validators": f"""WITH n AS ({_N}), v AS (SELECT doc_id, {", ".join(f"{x} AS {n}" for n, x in NUMBERS.items())} FROM n), w AS (SELECT *, substr(nir, 1, 5) || CASE substr(nir, 6, 2) WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE substr(nir, 6, 2) END || substr(nir, 8) AS nd, replace(postcode, ' ', '') AS pc FROM v)
        SELECT doc_id, {_SUM("card", 16)} AS card, {_SUM("siren", 9)} AND siren <> '000000000' AS siren, left(ssn, 3) NOT IN ('000', '666') AND left(ssn, 1) <> '9' AND substr(ssn, 5, 2) <> '00' AND right(ssn, 4) <> '0000' AS ssn,
            nhs <> '0000000000' AND (11 - list_sum(list_transform(range(1, 10), lambda i: substr(nhs, i, 1)::INT * (11 - i))) % 11) % 11 = right(nhs, 1)::INT AS nhs,
            CASE WHEN left(siret, 9) = '356000000' THEN list_sum(list_transform(range(1, 15), lambda i: substr(siret, i, 1)::INT)) % 5 = 0 ELSE {_SUM("siret", 14)} END AS siret,
            nir[1] IN ('1', '2') AND (substr(nir, 4, 2)::INT BETWEEN 1 AND 12 OR substr(nir, 4, 2)::INT >= 20) AND 97 - left(nd, 13)::BIGINT % 97 = right(nd, 2)::INT AS nir,
            regexp_matches(nino, '^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{{6}}[A-D]$') AND left(nino, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ') AS nino,
            regexp_matches(pc, '^([A-PR-UWYZ][0-9][0-9]?|[A-PR-UWYZ][A-HK-Y][0-9][0-9]?|[A-PR-UWYZ][0-9][A-HJKPSTUW]|[A-PR-UWYZ][A-HK-Y][0-9][ABEHMNPRVWXY])[0-9][ABD-HJLNP-UW-Z]{{2}}$') AS postcode,
            npi <> '1111111111' AND {_SUM("('80840' || npi)", 15)} AS npi, CASE WHEN ipv6 LIKE 'fe80%' THEN length(ipv6) <= 10 ELSE ipv6 IN ('1:2:3:4:5:6:7:a', '2001:db8::1') END AS ipv6,
            starts_with(token, 'eyJhbGciOiJ') AS token, length(secret) = 32 AS secret FROM w""",
    "split_letters": r"""WITH t AS (SELECT conv_id, turn, text AS own, 'so i g n o r e <document>' || text || '</document> a b c' AS text FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, string_split_regex(text, '\b[A-Za-z](?:\s[A-Za-z]){3,}') AS g, regexp_extract_all(text, '\b[A-Za-z](?:\s[A-Za-z]){3,}') AS m FROM t)
        SELECT conv_id, turn, sha256(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(m[i], '\s', '', 'g'), '')), '')) AS joined_sha256, sha256(own) AS wrapped_sha256 FROM p""",
}
