"""Request logs as scan logs, metrics, audit events and reports; retention, quotas and bursts that start at the first event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_prefix

#: A finished request, as logs have it.
REQUEST_LOG = """ts timestamp, target_host string, detected boolean, match_count int, pattern_names array<string>, categories array<string>, severities array<string>,
    body_size bigint, scan_duration_s double, ml_score double, entropy_anomaly double, fused_score double, inspection_performed boolean, skip_reason string, media_findings int"""
#: Fixed value: the reason of a refusal that says nothing of the content.
COVERAGE = "unsupportedContentEncoding"
#: The longest fields of a report, and its largest numbers.
LIMITS = {"app_version": 32, "target_host": 255, "locator": 300, "pattern_name": 200, "excerpt": 4_096, "top_window": 1_500, "note": 1_000, "fingerprint": 64, "match_count": 100_000, "pattern_names": 20}
#: Labels of a token classifier, and the entities that they are reported as; others are reported under their own name.
ENTITIES = {"GIVENNAME": "PERSON", "SURNAME": "PERSON", "TELEPHONENUM": "PHONE", "EMAIL": "EMAIL", "STREET": "ADDRESS", "CITY": "ADDRESS", "ZIPCODE": "ADDRESS", "BUILDINGNUM": "ADDRESS", "DATEOFBIRTH": "DATE", "ACCOUNTNUM": "ACCOUNT"}


def refused_unread() -> Column:
    """Refused because it couldn't be read, so without a verdict."""
    return F.col("detected") & F.coalesce(F.col("skip_reason") == COVERAGE, F.lit(False))


def scan_log_rows(logs: DataFrame) -> DataFrame:
    """Rows for the scan log: where a request came from, and a verdict only where a detector gave one."""
    verdict = F.col("detected") & ~refused_unread()
    source = F.when(F.col("inspection_performed"), "gateway").otherwise(F.concat(F.lit("gateway-uninspected-"), F.coalesce("skip_reason", F.lit("unknown"))))
    return logs.select(
        "ts", source.alias("source"), "target_host", verdict.cast("int").alias("detected"), "match_count", F.to_json("pattern_names").alias("pattern_ids"), F.when(verdict, "high").alias("severity"),
        F.col("body_size").alias("request_size"), "ml_score", "entropy_anomaly", "fused_score",
    )


def metric_samples(logs: DataFrame) -> DataFrame:
    """What a request adds to the metrics: no bytes where nothing was inspected, rewritten where media were replaced, oversized by the reason of skipping."""
    return logs.select(
        "ts", "target_host", "detected", F.when(F.col("inspection_performed"), F.col("body_size")).otherwise(0).alias("bytes"), (F.col("media_findings") > 0).alias("rewritten"),
        F.coalesce(F.col("skip_reason") == "oversized", F.lit(False)).alias("oversized"), (F.col("scan_duration_s") * 1000).alias("ms"), "categories", "severities",
    )


def counters(samples: DataFrame) -> DataFrame:
    """One row: requests, blocked, rewritten, oversized, bytes."""
    return samples.agg(F.count("*").alias("requests"), *[F.count_if(c).alias(n) for n, c in (("blocked", "detected"), ("rewritten", "rewritten"), ("oversized", "oversized"))], F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def hits_by(samples: DataFrame, names: str) -> DataFrame:
    """name, n: how many requests name each entry of a list."""
    return samples.select(F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def blocks_by_host(samples: DataFrame) -> DataFrame:
    return samples.filter("detected and target_host is not null").groupBy("target_host").agg(F.count("*").alias("n"))


def activity(logs: DataFrame) -> DataFrame:
    """One row: scanned, skipped, blocked, blocked_unread, flagged."""
    flagged = ~F.col("detected") & (F.col("match_count") > 0)
    return logs.agg(
        F.count_if("inspection_performed").alias("scanned"), F.count_if(~F.col("inspection_performed")).alias("skipped"), F.count_if(F.col("detected") & ~refused_unread()).alias("blocked"),
        F.count_if(refused_unread()).alias("blocked_unread"), F.count_if(flagged).alias("flagged"),
    )


def attachments(findings: DataFrame, key: str, path: str) -> DataFrame:
    """key, entities, attachments: findings, and the distinct attachments that they are in."""
    return findings.groupBy(key).agg(F.count("*").alias("entities"), F.countDistinct(path).alias("attachments"))


def by_group(df: DataFrame, by: str, ts: str, now: str, days: int) -> DataFrame:
    """by, n: rows of the last days."""
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))).groupBy(by).agg(F.count("*").alias("n"))


def totals(redactions: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row: redactions, prompts."""
    return redactions.agg(F.count("*").alias("redactions")).join(prompts.agg(F.count("*").alias("prompts")))  # a row each


def integrity(by_type: Column, by_host: Column, redactions: Column, prompts: Column) -> Column:
    """SHA-256 of a report's figures in a fixed order, so that who gets it can work it out again. by_type, by_host: maps of counts."""
    lines = lambda mark, m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit(f"{mark}:"), e["key"], F.lit("="), e["value"].cast("string"), F.lit("\n")))
    end = F.concat(F.lit("totals:r="), redactions.cast("string"), F.lit(",p="), prompts.cast("string"))
    return F.sha2(F.concat(F.array_join(lines("t", by_type), ""), F.array_join(lines("h", by_host), ""), end), 256)


def _counted(df: DataFrame, by: str, name: str) -> DataFrame:
    """One row with a map of counts; as many entries as there are types or hosts."""
    return df.groupBy(F.col(by).alias("k")).agg(F.count("*").alias("n")).filter("k is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def redaction_report(redactions: DataFrame, prompts: DataFrame, kind: str = "type", host: str = "target_host") -> DataFrame:
    """One row: by_type, by_host, redactions, prompts, integrity_sha256."""
    row = _counted(redactions, kind, "by_type").join(_counted(redactions, host, "by_host")).join(totals(redactions, prompts))
    return row.withColumn("integrity_sha256", integrity(F.col("by_type"), F.col("by_host"), F.col("redactions"), F.col("prompts")))


def audit_event(event: str, app_version: str) -> Column:
    """A block as JSON with its keys in order, for an audit sink."""
    fields = {"appVersion": F.lit(app_version), "bodySize": F.col("body_size"), "event": F.lit(event), "host": F.col("target_host"), "matchCount": F.col("match_count"), "patterns": F.array_sort("pattern_names"), "severity": F.lit("high"), "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def pattern_ids(text: Column) -> Column:
    """The ids of a JSON list of strings; null where it is something else."""
    return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})


def diagnostic_events(scan_logs: DataFrame, allowed_hosts: list[str]) -> DataFrame:
    """Recent rows of the scan log for a bundle that leaves the machine: hosts only if allowed, and which kind of detector spoke."""
    detector = F.when(F.col("match_count") > 0, "regex").when(F.col("detected") != 0, "ml").otherwise("none")
    ids = F.coalesce(pattern_ids(F.col("pattern_ids")), F.array().cast("array<string>"))
    return scan_logs.select("ts", "source", F.when(F.col("target_host").isin(allowed_hosts), F.col("target_host")).alias("target_host"), (F.col("detected") != 0).alias("detected"), "match_count", ids.alias("pattern_ids"), "severity", detector.alias("detector"), "ml_score", "fused_score")


def diagnostics(metrics: DataFrame, daily: DataFrame, events: DataFrame, meta: dict[str, str], days: int = 30, most: int = 200) -> DataFrame:
    """One row, bundle: JSON of the counters, the newest days and the newest events. metrics: one row. The lists are reports of a fixed length."""
    listed = lambda df, order, n, name: df.orderBy(F.desc(order)).limit(n).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])), asc=False).alias(name))
    row = metrics.select(F.struct(*metrics.columns).alias("metrics")).join(listed(daily, "day", days, "dailyStats")).join(listed(events, "ts", most, "recentEvents"))
    about = F.struct(*[F.lit(v).alias(k) for k, v in sorted(meta.items())])
    return row.select(F.to_json(F.struct("dailyStats", about.alias("meta"), "metrics", "recentEvents")).alias("bundle"))


def merged_scans(a: Column, b: Column) -> Column:
    """Two scans of one request (its address and its body) as one: counts added up, names united, the higher of each score; a score that one lacks is the other's."""
    united = lambda c: F.array_sort(F.array_union(F.coalesce(a[c], F.array().cast("array<string>")), F.coalesce(b[c], F.array().cast("array<string>"))))
    return F.struct(
        (a["detected"] | b["detected"]).alias("detected"), (a["match_count"] + b["match_count"]).alias("match_count"), *[united(c).alias(c) for c in ("names", "categories", "severities")],
        *[F.greatest(a[c], b[c]).alias(c) for c in ("ml_score", "entropy_anomaly", "fused_score")],
    )


def tally(df: DataFrame, by: str, score: str, block: float, warn: float) -> DataFrame:
    """by, n, blocked, flagged, block_pct, flag_pct of scored samples."""
    s = F.col(score)
    n = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(s >= block).alias("blocked"), F.count_if((s >= warn) & (s < block)).alias("flagged"))
    return n.select("*", F.round(F.col("blocked") / F.col("n") * 100, 1).alias("block_pct"), F.round(F.col("flagged") / F.col("n") * 100, 1).alias("flag_pct"))


def set_quality(gold: DataFrame, predicted: DataFrame, key: str, kind: str) -> DataFrame:
    """kind, tp, fp, fn, precision, recall, f1 over the sets of (key, kind); a last row `macro` with the means."""
    g, p = (df.select(key, kind).distinct().withColumn(side, F.lit(1)) for df, side in ((gold, "g"), (predicted, "p")))
    both = g.join(p, [key, kind], "full_outer")
    n = both.groupBy(kind).agg(F.count("*").alias("all"), F.count("g").alias("gold"), F.count("p").alias("said"))
    n = n.select(kind, (F.col("gold") + F.col("said") - F.col("all")).alias("tp"), (F.col("all") - F.col("gold")).alias("fp"), (F.col("all") - F.col("said")).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    each = n.select(kind, "tp", "fp", "fn", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))
    macro = each.agg(F.lit("macro").alias(kind), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return each.unionByName(macro).select(kind, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def entity_of(label: Column) -> Column:
    """The entity that a classifier's label is reported as, without its begin or inside mark; null for what is outside."""
    plain = F.regexp_replace(label, "^[BI]-", "")
    return F.when(plain != "O", F.coalesce(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])[plain], plain))


def count_maps(events: DataFrame, day: str, by: list[str]) -> DataFrame:
    """day, total, and for each of `by` a map of its counts. Each map has as many entries as there are values that day."""
    out = events.groupBy(day).agg(F.count("*").alias("total"))
    for c in by:
        n = events.groupBy(day, c).agg(F.count("*").alias("n"))
        out = out.join(n.groupBy(day).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("k"), "n")))).alias(f"by_{c}")), day)
    return out


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is still there: a cascading delete."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def _clamped(c: str, most: int) -> Column:
    return F.left(F.trim(c), F.lit(most))


def sound_reports(reports: DataFrame) -> DataFrame:
    """Reports that are fit to be stored, with their fields cut to size; others are left out.

    Needed: excerpt, app_version, locator and target_host that say something and have no control characters, a
    fingerprint of 64 lower-case hex digits, scores within 0 and 1, a count that isn't negative, pattern names.
    """
    said = lambda c: F.coalesce((F.trim(c) != "") & ~F.col(c).rlike(r"[\x00-\x1f\x7f]"), F.lit(False))
    whole = lambda c: F.coalesce(~F.col(c).contains("\0"), F.lit(True))
    share = lambda c: F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False))
    maybe = lambda c: F.col(c).isNull() | share(c)
    names = F.transform("pattern_names", lambda n: F.trim(n))
    good = (
        F.coalesce(F.trim("excerpt") != "", F.lit(False)) & whole("excerpt") & said("app_version") & said("locator") & said("target_host") & ~F.trim("target_host").rlike(r"[\s/@?#]") & F.coalesce(F.col("fingerprint").rlike("^[a-f0-9]{64}$"), F.lit(False))
        & share("fused_score") & share("entropy_anomaly") & share("benign_multiplier") & maybe("ml_score") & maybe("top_window_score") & F.coalesce(F.col("match_count").between(0, LIMITS["match_count"]), F.lit(False))
        & whole("top_window") & whole("note") & F.coalesce(F.forall(names, lambda n: F.coalesce((n != "") & ~n.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))), F.lit(False))
    )
    cut = {c: _clamped(c, LIMITS[c]) for c in ("app_version", "target_host", "locator")} | {"excerpt": F.left("excerpt", F.lit(LIMITS["excerpt"])), "top_window": F.left("top_window", F.lit(LIMITS["top_window"])), "note": F.nullif(_clamped("note", LIMITS["note"]), F.lit(""))}
    return reports.filter(good).withColumns(cut | {"pattern_names": F.transform(F.slice(names, 1, LIMITS["pattern_names"]), lambda n: F.left(n, F.lit(LIMITS["pattern_name"])))})


#: How many windows' time a slice of a key's events has.
SLICE = 64


def _after(ms: np.ndarray, width: int) -> np.ndarray:
    """For each event the place of the one where the next window would start."""
    return np.searchsorted(ms, ms + width)


def windows_from_first(events: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """by, start, n: windows of so many seconds, each of which starts at the first event after the one before has run out.

    A key's time is cut into slices of SLICE windows, which are worked through apart, so a busy key is many tasks. Where
    the first window of a slice starts depends on the slice before, but it starts within a window's time or at the next
    event: for each such event a slice says where its last window would start. Only these few events meet by key, where
    one slice after another gets its first window. Events of the same millisecond are counted up first, so a slice has
    a row a millisecond at most. Rows without a time are in no window; a null key is a key.
    """
    width, stretch = seconds * 1000, SLICE * seconds * 1000
    kind = events.schema[by].dataType.simpleString()
    each = events.select(F.col(by).alias("k"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).filter("ms IS NOT NULL").groupBy("k", "ms").agg(F.count("*").alias("n"))
    each = each.withColumn("slice", F.floor(F.col("ms") / stretch).cast("bigint"))

    def through(t: pa.Table) -> pa.Table:
        t = t.sort_by("ms")
        ms = t["ms"].to_numpy()
        after, last = _after(ms, width), np.arange(len(ms))
        last = np.where(after < len(ms), after, last)
        while not np.array_equal(further := last[last], last):
            last = further
        first = min(len(ms), int(np.searchsorted(ms, t["slice"][0].as_py() * stretch + width)) + 1)
        return pa.table({"k": t["k"].slice(0, first), "slice": t["slice"].slice(0, first), "ms": t["ms"].slice(0, first), "last": pa.array(ms[last[:first]], pa.int64())})

    def chained(t: pa.Table) -> pa.Table:
        t = t.sort_by([("slice", "ascending"), ("ms", "ascending")])
        slices, ms, last = (t[c].to_numpy() for c in ("slice", "ms", "last"))
        heads = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
        before, entry, open_since = [], [], None
        for lo, hi in zip(heads, [*heads[1:], len(ms)], strict=True):
            i = lo if open_since is None else lo + int(np.searchsorted(ms[lo:hi], open_since + width))
            before.append(open_since)
            entry.append(int(ms[i]) if i < hi else None)
            open_since = int(last[i]) if i < hi else open_since
        return pa.table({"k": t["k"].take(pa.array(heads)), "slice": t["slice"].take(pa.array(heads)), "before": pa.array(before, pa.int64()), "entry": pa.array(entry, pa.int64())})

    def counted(t: pa.Table) -> pa.Table:
        t = t.sort_by("ms")
        ms, n, before, entry = t["ms"].to_numpy(), t["n"].to_numpy(), t["before"][0].as_py(), t["entry"][0].as_py()
        after, at = _after(ms, width), []
        i = len(ms) if entry is None else int(np.searchsorted(ms, entry))
        head = int(n[:i].sum())  # events of a window that started in an earlier slice
        while i < len(ms):
            at.append(i)
            i = int(after[i])
        start = [int(ms[i]) for i in at] + [before] * (head > 0)
        sums = [int(x) for x in np.add.reduceat(n, at)] if at else []
        return pa.table({"k": t["k"].take(pa.array([0] * len(start), pa.int64())), "start": pa.array(start, pa.int64()), "n": pa.array(sums + [head] * (head > 0), pa.int64())})

    ends = each.groupBy("k", "slice").applyInArrow(through, f"k {kind}, slice bigint, ms bigint, last bigint")
    chain = ends.groupBy("k").applyInArrow(chained, f"k {kind}, slice bigint, before bigint, entry bigint").alias("c")
    placed = each.alias("e").join(chain, F.col("e.k").eqNullSafe(F.col("c.k")) & (F.col("e.slice") == F.col("c.slice"))).select("e.*", "before", "entry")
    parts = placed.groupBy("k", "slice").applyInArrow(counted, f"k {kind}, start bigint, n bigint")
    return parts.groupBy("k", "start").agg(F.sum("n").alias("n")).select(F.col("k").alias(by), F.timestamp_millis("start").cast("timestamp_ntz").alias("start"), "n")


def quota_from_first(events: DataFrame, by: str, ts: str, most: int, seconds: int = 60) -> DataFrame:
    """by, start, n, accepted, refused of the writes in each window that starts at a write."""
    return windows_from_first(events, by, ts, seconds).select(by, "start", "n", F.least("n", F.lit(most)).alias("accepted"), F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def claimed_once(events: DataFrame, by: str, ts: str, seconds: int = 180) -> DataFrame:
    """by, claimed, replays: a claim holds for so many seconds, in which others of the same are replays."""
    return windows_from_first(events, by, ts, seconds).select(by, F.col("start").alias("claimed"), (F.col("n") - 1).alias("replays"))


def notified(events: DataFrame, by: str, key: str, ts: str, most: int = 3, seconds: int = 60) -> DataFrame:
    """key, decision (individual, summary, suppress), n: up to `most` events within the trailing seconds are told one by one, beyond that a summary at most once in so many seconds. key: a column that tells events apart."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy("ms", key)
    within = F.count("*").over(Window.partitionBy(by).orderBy("ms").rangeBetween(-(seconds * 1000 - 1), 0))
    after = F.count("*").over(Window.partitionBy(by, "ms").orderBy(key).rowsBetween(1, Window.unboundedFollowing))  # of the same millisecond
    e = events.select(by, key, ts, ms.alias("ms")).withColumn("n", within - after).withColumn("nth", F.row_number().over(w))
    burst = e.filter(F.col("n") > most)
    told = windows_from_first(burst, by, ts, seconds).select(by, F.unix_millis(F.col("start").cast("timestamp")).alias("ms"), F.lit(True).alias("first"))
    first = burst.groupBy(by, "ms").agg(F.min("nth").alias("nth")).join(told, [by, "ms"]).select(by, "nth", "first")
    return e.join(first, [by, "nth"], "left").select(key, F.when(F.col("n") <= most, "individual").when(F.col("first"), "summary").otherwise("suppress").alias("decision"), "n")


def retained(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    """Rows no older than so many days."""
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a Parquet table; with `by`, in a folder for each day, so that retention drops folders."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def keep_newest(df: DataFrame, path: str, order: list[Column], most: int = 100) -> None:
    """Writes the newest rows anew, to a path that they aren't read from; a store that keeps its newest rows by itself is `Versions.keep_newest`."""
    df.orderBy(*order).limit(most).write.mode("overwrite").parquet(path)


def draft(samples: DataFrame, redact: Column) -> DataFrame:
    """What a report of a wrong block would say: the excerpt redacted and cut to size, with the signals. redact: the redacted excerpt."""
    return samples.select("*", F.left(redact, F.lit(LIMITS["excerpt"])).alias("report_excerpt"), hash_prefix(F.col("fingerprint")).alias("short_id"))
