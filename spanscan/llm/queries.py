"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filteraudit, langid, linededup, lm, media, packing, ranked, secrets, sharding, simhash, toxicity
from .common import remainder, shared_folder

SHARD_BYTES = 1 << 20
MIN_SITES = 10
BEST = 20
#: The tokenizer's vocabulary file, by its name in public_tokenizers.
VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a stored ledger: one with the base rules, and one with all, which scans for the added ones alone."""
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.run(docs, secrets.BASE)
    ledger.run(docs, secrets.RULES)
    found = secrets.located(docs, ledger.findings, ["doc_id"])
    base = secrets.joined("spans", tuple(r.kind for r in secrets.BASE))
    return found.select("version.doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), *[f"n_{r.kind}" for r in secrets.ADDED])


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", media.features("text").alias("m")).select("doc_id", "m.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, labels.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict("text", model).alias("p")).select("doc_id", "held_out", "p.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", _vocabulary()).alias("b")).select("doc_id", "b.*")


def op9_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"), MIN_SITES)
    return out.select("doc_id", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 7) == 2)
    return lm.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), BEST).drop("tier")


def op13_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(_table(spark, sf_dir, "documents"), _vocabulary(WORD_VOCABULARY)).drop("certified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_extendible_sharding, op2_secret_ledger, op3_iso_media, op4_toxicity, op5_simhash, op6_decontaminate, op7_language, op8_bpe, op9_boilerplate_lines, op10_brown_lm, op11_filter_audit, op12_tiered_search, op13_bound_packing)
}


def _secrets_sql() -> str:
    """The base rules as the contract has them, and the added ones by their patterns."""
    base = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ]
    rules = [*base, *((r.kind, r.pattern, r.group, r.least) for r in secrets.ADDED)]
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = lambda k, kind, p, g, least: f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {quoted(p)}, 0) AS ms, regexp_extract_all(t, {quoted(p)}, {g}) AS gs, string_split_regex(t, {quoted(p)}) AS ps FROM t"
    added = ", ".join(f"count(*) FILTER (k = {3 + i}) AS n_{r.kind}" for i, r in enumerate(secrets.ADDED))
    zero = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.ADDED)
    span = "kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(one(k, *r) for k, r in enumerate(rules))}),
        e AS (SELECT doc_id, k, kind, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS p FROM m WHERE len(ms) > 0),
        s AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM e),
        j AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, {added},
                     string_agg({span}, ',' ORDER BY stop - length(m), k) AS spans, string_agg({span}, ',' ORDER BY stop - length(m), k) FILTER (k < 3) AS base
              FROM s WHERE length(g) >= least GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {zero}
        FROM t LEFT JOIN j USING (doc_id)"""


SQL = {
    "op1_extendible_sharding": f"""
        WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
        node AS (SELECT d, h >> (32 - d) AS p, sum(n_bytes)::BIGINT AS s, count(*) AS n FROM r, (SELECT unnest(range(0, 33))::BIGINT AS d) GROUP BY ALL),
        leaf AS (SELECT c.* FROM node c LEFT JOIN node a ON a.d = c.d - 1 AND a.p = c.p >> 1
                 WHERE (c.s <= {SHARD_BYTES} OR c.n = 1) AND (c.d = 0 OR (a.s > {SHARD_BYTES} AND a.n > 1)))
        SELECT doc_id, n_bytes, substr(lpad(bin(h), 32, '0'), 1, d::INT) AS shard, d::INT AS depth, s AS shard_bytes, s > {SHARD_BYTES} AS oversized
        FROM r JOIN leaf ON h >> (32 - d) = p""",
    "op2_secret_ledger": _secrets_sql(),
    "op11_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
                     regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        r AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
        n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT [p.bit, q.bit, s.bit, u.bit, v.bit] AS bits, p.x || q.x || s.x || u.x || v.x AS filter_order FROM x p, x q, x s, x u, x v WHERE p.bit + q.bit + s.bit + u.bit + v.bit = 31 AND p.bit | q.bit | s.bit | u.bit | v.bit = 31),
        g AS (SELECT filter_order, k AS step, bits[k] AS own, list_sum(bits[1:k])::INT - bits[k] AS before FROM o, (SELECT unnest(range(1, 6))::INT AS k)),
        y AS (SELECT part, filter_order, step, own,
                     coalesce(sum(n) FILTER (fails & (before | own) = 0), 0)::BIGINT AS kept,
                     coalesce(sum(n) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (fails & own > 0 AND fails & before > 0), 0)::BIGINT AS redundant,
                     coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
                     coalesce(sum(toxic) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
              FROM n, g GROUP BY ALL)
        SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM y""",
    "op12_tiered_search": f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
        p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
        s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
        w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
        i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
        g AS (SELECT q, item_id, term, count(*) AS qf FROM i GROUP BY ALL),
        x AS (SELECT q, item_id, r, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
              FROM g JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {BEST}""",
    "op9_boilerplate_lines": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        b AS (SELECT line, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
        k AS (SELECT doc_id, count(*) FILTER (b.line IS NOT NULL AND doc_id IS DISTINCT FROM first)::BIGINT AS n_removed,
                     coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL OR doc_id IS NOT DISTINCT FROM first), '') AS text
              FROM l LEFT JOIN b USING (line) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, strlen(k.text)::BIGINT AS n_bytes, sha256(k.text) AS text_sha256 FROM documents d LEFT JOIN k USING (doc_id)""",
}
