"""Clashing names, nulls, repeats and empty tables for each operator; containers by another reader; dense shards."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_free import PATH, near_points, plain_components, same

from spanscan.llm import bpe, decontam, langid, lm, media, neardup, sharding, simhash, toxicity

NAMES = "doc_id string, text string, lang string, source string, row string, place string, `__place` string, _key string, _kept string, fp string, s string, key string, word string, segment string"
ROWS = [("k1", "the same words here again and again", "en"), ("k1", "the same words here again and again", "en"), ("k2", None, None), (None, "", "en"), (None, None, None), ("k3", "x" * 200_000, "fr")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], NAMES)


def test_columns_of_any_name(spark):
    df = table(spark)
    labels = spark.createDataFrame([("k1", 1), ("k2", 0), (None, 1)], "doc_id string, toxic int")
    items = spark.createDataFrame([(1, "same words here"), (None, None)], "item_id long, text string")
    scored = df.withColumn("score", toxicity.score("text", toxicity.fit(df, labels)))
    assert len({r["score"] for r in scored.filter("doc_id = 'k1'").collect()}) == 1 and scored.count() == 6
    assert df.select(langid.predict("text", langid.fit(df)).alias("p")).filter("p.lang_pred = 'und'").count() == 3
    assert df.select(bpe.round_trip("text", PATH).alias("b")).filter("b.n_tokens = 0").count() == 3
    assert df.select(media.features("text").alias("m")).filter("m.n_bytes = 0").count() == 3
    assert sharding.shard(df, 1000).count() == 6 and simhash.near_duplicates(df).count() == 6
    for kept, n in ((simhash.one_of_each(df), 3), (neardup.one_of_each(df), 3), (decontam.clean(df, items, window=3), 4)):
        assert kept.columns == df.columns and kept.count() == n and {r["__place"] for r in kept.collect()} == {"d"}
    assert lm.score(df, F.lit(True), keep=("doc_id", "row", "word")).count() == 6


def test_empty_tables(spark):
    df = table(spark, [])
    labels, items = spark.createDataFrame([], "doc_id string, toxic int"), spark.createDataFrame([], "item_id long, text string")
    outs = [df.select(toxicity.score("text", toxicity.fit(df, labels))), df.select(langid.predict("text", langid.fit(df))), df.select(bpe.round_trip("text", PATH)), df.select(media.features("text")), df.select(media.describe(F.encode("text", "UTF-8")))]
    outs += [simhash.one_of_each(df), neardup.one_of_each(df), decontam.clean(df, items), decontam.matches(df, items), lm.score(df, F.lit(True))]
    assert [o.count() for o in outs] == [0] * len(outs)


# Containers


def box(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind, flags, *parts):
    return box(kind, struct.pack(">I", flags), *parts)


def read_plainly(data):
    """Offsets and sizes of samples by looking for the tables of `store`'s kind: one track, fixed sizes, 32-bit offsets."""
    at = lambda kind, skip=4: data.index(kind) + len(kind) + skip
    ints = lambda pos, n: struct.unpack_from(f">{n}I", data, pos)
    size, count = ints(at(b"stsz"), 2)
    offsets = ints(at(b"stco") + 4, ints(at(b"stco"), 1)[0])
    runs = [ints(at(b"stsc") + 4 + 12 * i, 3) for i in range(ints(at(b"stsc"), 1)[0])]
    keys = ints(at(b"stss") + 4, ints(at(b"stss"), 1)[0])
    out, left = [], count
    for i, o in enumerate(offsets, 1):
        per = [n for first, n, _ in runs if first <= i][-1]
        out += [(o + size * j, size) for j in range(min(per, left))]
        left -= min(per, left)
    return out, [out[k - 1] for k in keys]


@pytest.mark.parametrize("n", [0, 1, 192, 6145, 100_000])
def test_containers_by_another_reader(spark, n):
    text = ("añ" * n)[:n]
    r = spark.createDataFrame([(text,)], "t string").select(media.features("t").alias("m"), media.as_media("t").alias("b")).first()
    data, raw = bytes(r["b"]), text.encode()
    samples, keys = read_plainly(data)
    back = b"".join(data[a : a + s] for a, s in samples)
    assert back == raw + b" " * (len(back) - len(raw)) and len(back) == max(192, -(-len(raw) // 192) * 192)
    assert r["m"]["media_sha256"] == hashlib.sha256(data).hexdigest() and r["m"]["payload_sha256"] == hashlib.sha256(back).hexdigest()
    said = dict(x.split("=") for x in r["m"]["feature"].split(";"))
    assert said["samples"] == str(len(samples)) and said["keyframes"] == str(len(keys)) and said["first"] == "{}+{}".format(*keys[0]) and said["last"] == "{}+{}".format(*keys[-1])


def track(stbl, number=1):
    tkhd = full(b"tkhd", 7, bytes(8), struct.pack(">I", number), bytes(68))
    mdhd = full(b"mdhd", 0, struct.pack(">4I", 0, 0, 1000, 0), bytes(4))
    edits = box(b"edts", full(b"elst", 0, struct.pack(">IIiHH", 1, 500, -1, 1, 0)))
    stsd = full(b"stsd", 0, struct.pack(">I", 2), box(b"avc1", bytes(8)), box(b"hvc1", bytes(8)))
    return box(b"trak", tkhd, edits, box(b"mdia", mdhd, full(b"hdlr", 0, bytes(4), b"vide", bytes(12)), box(b"minf", box(b"stbl", stsd, *stbl))))


def test_fragments_and_compact_sizes(spark):
    none = [full(b"stts", 0, bytes(4)), full(b"stsc", 0, bytes(4)), full(b"stsz", 0, bytes(8)), full(b"stco", 0, bytes(4))]
    moov = box(b"moov", track(none), box(b"mvex", full(b"trex", 0, struct.pack(">5I", 1, 1, 40, 5, 0x10000))))
    def fragment(offset):
        first = full(b"trun", 0x1 | 0x4, struct.pack(">IiI", 3, offset, 0))  # defaults; the first is a keyframe
        second = full(b"trun", 0x100 | 0x200 | 0x400, struct.pack(">I6I", 2, 10, 7, 0, 20, 9, 0x10000))
        return box(b"moof", full(b"mfhd", 0, bytes(4)), box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 1)), first, second))
    moof = fragment(len(fragment(0)) + 8)
    data = box(b"ftyp", b"iso5") + moov + moof + box(b"mdat", bytes(31))
    at = len(data) - 31
    t = media.tracks(data)[0]
    assert t.key_ranges() == [(at, 5), (at + 15, 7)] and t.n_samples == 5 and t.length == 150 and t.codecs == ["avc1", "hvc1"] and t.edits == [(500, -1)]
    def compact(bits, sizes, packed):
        return lambda first: box(b"moov", track([full(b"stts", 0, struct.pack(">3I", 1, len(sizes), 1)), full(b"stsc", 0, struct.pack(">4I", 1, 1, len(sizes), 1)), full(b"stz2", 0, struct.pack(">I", bits), struct.pack(">I", len(sizes)), packed), full(b"stco", 0, struct.pack(">2I", 1, first))]))
    for bits, packed in ((4, b"\x35\x20"), (8, b"\3\5\2"), (16, b"\0\3\0\5\0\2")):
        make = compact(bits, [3, 5, 2], packed)
        first = len(make(0)) + 8
        t = media.tracks(make(first) + box(b"mdat", bytes(10)))[0]
        assert t.key_ranges() == [(first, 3), (first + 3, 5), (first + 8, 2)]
    deep = b""
    for _ in range(80):
        deep = box(b"moov", deep)
    lost = box(b"ftyp", b"iso5") + moov + moof.replace(struct.pack(">I", 1) + full(b"trun", 0)[:0], struct.pack(">I", 1), 1) + box(b"mdat", bytes(3))
    got = spark.createDataFrame([(data,), (deep,), (lost,)], "b binary").select(media.describe("b").alias("d")).collect()
    assert [(len(r["d"]["tracks"]), r["d"]["error"] is None) for r in got] == [(1, True), (0, False), (0, False)] and "deeper" in got[1]["d"]["error"]
    assert got[0]["d"]["tracks"][0]["n_samples"] == 5 and got[0]["d"]["tracks"][0]["edits"][0]["media_time"] == -1


# Shards that distances don't part


def test_dense_shards_are_split_by_parts(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64) >> 20 << 20
    points = sorted({base | rng.getrandbits(20) for _ in range(400)} | set(near_points(10, 60)))  # 44 bits alike
    monkeypatch.setattr(simhash, "SHARD", 20)
    whole = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in points], "fp long")
    seeded = whole.select(F.lit("").alias("shard"), F.lit(-1).cast("long").alias("mask"), "fp")
    shards = simhash._split(simhash._by_parts(seeded, [2**64 - 1], 3), 3, 20)
    assert shards.groupBy("shard").count().agg(F.max("count")).first()[0] <= 20  # no task gathers more
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(whole).collect()]
    assert same(pairs, points, plain_components(points))
    assert np.all([sum(simhash._parts(m, 3)) == m for m in (2**64 - 1, 0b1011, 1 << 63)])
