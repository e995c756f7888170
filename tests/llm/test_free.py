"""The other operators against plain versions, round trips and held-out rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanscan.llm import bpe, decontam, langid, lm, media, queries, simhash, toxicity
from spanscan.llm.common import remainder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, fp string, `key` string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None)[:5] for r in rows], DOCS)


# BPE


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("abcdehi tno'sre<|endoftext|>é😀\u0085\x1c \n\t 12", max_size=200))
def test_ids_are_those_of_the_library(text):
    t, v = LIBRARY, bpe.vocabulary(PATH)
    ids = t.encode(text, add_special_tokens=False).ids
    packed = v.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert v.decode(packed).decode() == t.decode(ids, skip_special_tokens=False)


def test_long_pieces_and_columns(spark):
    v, rng = bpe.vocabulary(PATH), random.Random(5)
    for n in (49, 500, 3000):
        piece = "".join(rng.choice("abcdeinrst") for _ in range(n)).encode()
        assert v._heaped(piece) == v._scanned(piece)
    texts = [None, "", "a <|endoftext|> b", "aa" * 30000, "é😀 word", "same", "same"]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)]).select("doc_id", "text", bpe.encode("text", PATH).alias("ids"), bpe.round_trip("text", PATH).alias("r"))
    t = LIBRARY
    for r in df.withColumn("back", bpe.decode("ids", PATH)).collect():
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "")
        assert r["r"]["n_tokens"] == len(r["ids"]) and r["r"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert queries.op8_bpe(spark, "/root/testdata/sf0.001").count() == 200
    assert bpe.vocabulary(PATH).decode(struct.pack("<2I", v.of_byte[0xC3], v.of_byte[0x41])) == "�A".encode()


# Media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 16, 192 * 33 + 5, 300_000])
def test_media_round_trip(n):
    text = ("é" * n)[:n]
    want = media.padded(text)
    stored = media.store(want)
    t = media.tracks(stored)[0]
    assert media.payload(stored) == want and len(want) % 192 == 0 and want
    assert (t.codec, t.handler, t.duration, sum(c for c, _ in t.times)) == ("raw ", "soun", len(want), len(want) // 192)
    ranges = t.key_ranges()
    assert len(ranges) == -(-len(want) // 192 // 16) and all(stored[a : a + s] == want[i * 192 * 16 :][:192] for i, (a, s) in enumerate(ranges))
    assert [p[-1] for p, _, _ in media.boxes(stored)][:2] == [b"ftyp", b"moov"]


def test_media_columns(spark):
    texts = [None, "", "abc", "abc", "x" * 100_000]
    rows = docs(spark, [(i, t) for i, t in enumerate(texts)]).select("doc_id", "text", media.features("text").alias("m"), media.as_media("text").alias("b")).withColumn("d", media.describe("b")).orderBy("doc_id").collect()
    for r in rows:
        want = media.padded(r["text"])
        assert r["m"]["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["m"]["tail_crc32"] == zlib.crc32(want[-16:])
        assert r["m"]["media_bytes"] == len(r["b"]) and r["m"]["n_bytes"] == len((r["text"] or "").encode())
        assert r["d"]["error"] is None and r["d"]["tracks"][0]["seconds"] == len(want) / 8000
    assert rows[0]["m"] == rows[1]["m"] and rows[2]["m"] == rows[3]["m"]
    good = media.store(media.padded("x" * 1000))
    broken = spark.createDataFrame([(None,), (b"",), (good[:300],), (good[:-1],), (b"\0\0\0\2moov",), (random.Random(1).randbytes(99),)], "b binary").select(media.describe("b").alias("d")).collect()
    assert [r["d"]["error"] is None for r in broken] == [True, True, False, False, False, False] and not any(r["d"]["tracks"] for r in broken)


# SimHash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "é", "ÉA", "delta\u0085", "x y", "zeta"]
    texts = [None, "", " \n", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150))]
    texts += texts[:20] + [t + " tail" for t in texts[100:130]] + ["w " * 70_000]
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, [(i, t) for i, t in enumerate(texts)])).withColumn("hex", simhash.as_hex("fp")).collect()}
    assert [got[i]["hex"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    kept = simhash.one_of_each(docs(spark, [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in simhash.near_duplicates(docs(spark, [(None, "a"), (None, "a")])).collect()] == [None, None]


def near_points(seed, n):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        points.append(rng.choice(points) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    return sorted(set(points))


def same(pairs, points, want):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(p) for p in points] == [points[i] for i in want]


def test_trees_lose_no_link(spark, monkeypatch):
    points = near_points(7, 900)
    want = plain_components(points)
    monkeypatch.setattr(simhash, "LEAF", 40)
    assert same(simhash._linked(np.array(points, np.uint64), 3), points, want)
    dense = near_points(8, 40)
    assert same(simhash._linked(np.array(dense, np.uint64), 3), dense, plain_components(dense))
    monkeypatch.setattr(simhash, "SHARD", 15)  # shards are split in Spark, again and again
    low = [p & ~0xFFFF & (2**64 - 1) for p in points[:300]] + points[300:]
    low = sorted(set(low))
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in low], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()]
    assert same(pairs, low, plain_components(low))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (-5, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, -5: -5, 300: -5}


# Decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_matches(text, items, window=10):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        q = plain_words(t)
        for at in range(max(1, len(q) - window + 1) if q else 0):
            win = q[at : at + window]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_contaminated_words(spark, most):
    rng = random.Random(9)
    vocab = ["the", "of", "Éa", "x9", *(f"w{i}" for i in range(25))]
    items = [(i, ", ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([30, 12, 10, 3, 1, 0, 25, 40])] + [(20, None), (2, "the the the the the the the the the the the")]
    texts = [None, "", "of", "?!"]
    for _ in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(30)))]
        if rng.random() < 0.7:
            words = (rng.choice(items)[1] or "").upper().split(", ")
            parts.append("\n".join(words[rng.randrange(3) :]))
        texts.append(" ".join([*parts, *parts[:1]]))
    texts += [texts[10], texts[10], "the " * 5000]
    got = decontam.matches(docs(spark, [(i, t) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: plain_matches(t, items) for i, t in enumerate(texts)}
    digest = {r["doc_id"]: r for r in decontam.digest(decontam.matches(docs(spark, [(1, items[0][1])]), spark.createDataFrame(items, "item_id long, text string"))).collect()}[1]
    assert digest["items_sha256"] == hashlib.sha256(",".join(plain_matches(items[0][1], items)[2]).encode()).hexdigest() and digest["contaminated"]


def test_two_benchmarks_over_one_index(spark, monkeypatch):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(40)]
    texts = [None, "", *(" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(120))]
    one, two = ([(i, " ".join(rng.choice(texts[2:]).split()[:n])) for i in range(12)] for n in (12, 3))
    monkeypatch.setattr(decontam, "SEGMENT", 500)  # the lists of a frequent term are in many segments
    index = decontam.build_index(docs(spark, [(i, t) for i, t in enumerate(texts)]))
    assert index.postings.select("segment").distinct().count() > 4 and index.postings.agg(F.max("n_places")).first()[0] < 600
    for items in (one, two):
        got = decontam.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r["key"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: plain_matches(t, items) for i, t in enumerate(texts)}


def test_repeated_passages(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} {i}" for i in range(50)] + ["x " + passage * 2]
    items = [(i, passage) for i in range(40)]  # copies of one item are one set of windows
    monkeypatch.setattr(decontam, "CHUNK", 7)
    got = decontam.matches(docs(spark, [(i, t) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: plain_matches(t, items) for i, t in enumerate(texts)}


def test_proximity_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    loose = docs(spark, [(1, "one two three four x five six seven eight nine ten"), (2, "one two three four five x y z v w six seven eight nine ten")])
    of = lambda slop: sorted(r["doc_id"] for r in decontam.matches(loose, items, slop=slop).filter("n_hit > 0").collect())
    assert (of(0), of(1), of(5)) == ([], [1], [1, 2])
    assert [r["n_hit"] for r in decontam.matches(loose, items.limit(0)).collect()] == [0, 0] and decontam.matches(docs(spark, []), items).count() == 0
    assert [r["doc_id"] for r in decontam.clean(docs(spark, [(1, "ten"), (2, "One two, three four five six seven eight nine TEN!")]), items).collect()] == [1]


# Language identification


def test_languages_of_held_out_rows(spark):
    got = queries.op7_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] >= 0.97 and got[1] > 200


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "le chat et le chapeau", "fr"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    rows = {r["t"]: r["p"] for r in spark.createDataFrame([("the hat",), ("le chapeau",), (None,), ("12 %%",), ("",), ("the " * 9000,)], "t string").select("t", langid.predict("t", m).alias("p")).collect()}
    assert (rows["the hat"]["lang_pred"], rows["le chapeau"]["lang_pred"], rows[None]["lang_pred"], rows["12 %%"]["lang_pred"], rows[""]["score"]) == ("en", "fr", "und", "und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    for none in (train.filter("lang = 'en'"), train.limit(0)):
        assert spark.createDataFrame([("abc",)], "t string").select(langid.predict("t", langid.fit(none)).alias("p")).first()["p"]["lang_pred"] in ("en", "und")
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2)


# Toxicity


def test_restored_words():
    counts = toxicity._symbol_counts(("the cat sat on the mat and the dog was good to all of them in the hall seen too " * 50).encode())
    m = toxicity.char_model(counts, ("idiot", "moron", "clown"))
    for disguised, plain in (("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("cl0wn", "clown"), ("idiooooot", "idiot"), ("cl*own", "clown"), ("mat", "mat"), ("", "")):
        assert toxicity.decode(disguised, m) == plain
    model = toxicity.Model(m, {b"idiot": 0.9, b"^moro": 0.9})
    assert all(model.score(t) > 0.5 for t in ("you 1d10t", "an i d i o t here", "MORONS", "such a m0r0nic thing")) and max(map(model.score, (None, "", "a b c d", "idiots are", "x9 4 you", "z" * 100_000))) < 0.05


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    r = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in r}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(docs(spark, [(1, "a b"), (2, None)]), none)
    assert [r[0] < 0.3 for r in docs(spark, [(1, None), (2, ""), (3, "a" * 99999)]).select(toxicity.score("text", m)).collect()] == [True] * 3
    assert toxicity.fit(docs(spark, []), none).words == {}


# Language model


def test_language_model(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "ÉA", "X", "x"]
    rows = [(i, None if i == 3 else "" if i == 4 else " ".join(rng.choices(vocab, range(len(vocab), 0, -1), k=rng.randrange(50)))) for i in range(60)]
    rows += [rows[10], (99, "unseen words w1 here " * 3000)]
    df = docs(spark, rows)
    train = remainder("doc_id", 7) != 2
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in lm.tokens(t))
    n, v = sum(c.values()), len(c)
    many = lm.score(df, train, head=10, words=6).collect()
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(df, train, head=1000, words=6).collect()}
    assert len(many) == len(rows)
    by_id = dict(rows)
    for r in many:
        t = lm.tokens(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], whole[r["doc_id"], r["n_tokens"]], rel_tol=1e-9) and r["score"] < 0
    assert lm.score(df.limit(0), train).count() == 0
    assert all(r["n_known"] == 0 for r in lm.score(df, F.lit(False)).collect())


def plain_score(rows, learned, words, classes):
    """Classes by exchange and by neighbours, and the score of each text, from dictionaries of all bigrams."""
    texts = [lm.tokens(t) for t in learned]
    c = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip([b" ", *t], t, strict=False))
    least = 1 << 62
    steps = {}
    for w, n in c.items():
        steps.setdefault(math.floor(math.log2(n) * 16), []).append(n)
    held = 0
    for step in sorted(steps, reverse=True):
        if held + len(steps[step]) > words:
            break
        held, least = held + len(steps[step]), min(steps[step])
    seeds = sorted((w for w in c if c[w] >= least), key=lambda w: (-c[w], w)) or [b" "]
    number = {w: i for i, w in enumerate(seeds)}
    inner = [(number[a], number[b], n) for (a, b), n in pairs.items() if a in number and b in number]
    of = lm.exchange(*(np.array(x) for x in zip(*inner, strict=True)), len(seeds), classes)
    k = max(of) + 1
    between = np.zeros((k, k))
    for a, b, n in inner:
        between[of[a], of[b]] += n
    to, before = lm.transitions(between), np.log10((between + 1e-3) / (between.sum(axis=0) + k * 1e-3))
    place = {w: int(of[i]) for w, i in number.items()}
    for w in c:
        if w not in number and c[w] > 1:
            gains = np.zeros(k)
            for (a, b), n in pairs.items():
                if a == w and b in number:
                    gains += n * to[:, of[number[b]]]
                if b == w and a in number:
                    gains += n * before[of[number[a]]]
            if any(w in p and (p[0] in number or p[1] in number) for p in pairs):
                place[w] = int(gains.argmax())
    where = lambda w: place.get(w, k + lm.shape(w))
    total, kinds, moves = Counter(), Counter(), np.zeros((k + lm.SHAPES,) * 2)
    for w, n in c.items():
        total[where(w)] += n
        kinds[where(w)] += 1
    for (a, b), n in pairs.items():
        moves[where(a), where(b)] += n
    share = (moves.sum(axis=0) + 1) / (moves.sum() + len(moves))
    out = []
    for _, t in rows:
        s, last = 0.0, where(b" ")
        for w in lm.tokens(t):
            x = where(w)
            s += math.log10((moves[last, x] + 10 * share[x]) / (moves[last].sum() + 10)) + math.log10((c[w] + 0.5) / (total[x] + 0.5 * (kinds[x] + 1)))
            last = x
        out.append(s)
    return out


def test_scores_by_hand(spark):
    rng = random.Random(12)
    groups = [[f"{g}{i}" for i in range(30)] for g in "abc"]
    text = lambda: " ".join(groups[(i + rng.randrange(10) // 9) % 3][min(29, int(rng.expovariate(0.15)))] for i in range(rng.randrange(60)))
    rows = [(i, None if i == 3 else text() + (" unseen!" if i % 9 == 0 else "")) for i in range(150)]
    df, train = docs(spark, rows), remainder("doc_id", 7) != 2
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = plain_score(rows, learned, 25, 5)
    for head in (8, 1000):
        got = {r["doc_id"]: r["score"] for r in lm.score(df, train, head=head, words=25, classes=5).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-9)
    model = lm.fit(df.filter(train), words=25, classes=5)
    assigned = {bytes(r["word"]).decode(): r["class"] for r in model.words.filter("n > 3").collect()}
    main = [Counter(assigned[w] for w in g if w in assigned).most_common(1)[0][1] for g in groups]
    assert sum(main) >= 0.8 * (len(assigned) - 1)  # words beyond the clustered ones join the classes of their like


def test_scores_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, score int, row string")
    got = lm.score(df, F.lit(True), keep=("doc_id", "score", "row"))
    assert got.columns[:3] == ["doc_id", "score_kept", "row"] and {r["score_kept"] for r in got.collect()} == {5, 6}


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    groups = np.arange(12) % 3  # words of a group follow those of the group before
    pairs = Counter()
    for _ in range(6000):
        a = rng.integers(12)
        pairs[11 - a, 11 - rng.choice(np.flatnonzero(groups == (groups[a] + 1) % 3))] += 1
    before, after, n = (np.array(x) for x in zip(*((a, b, m) for (a, b), m in pairs.items()), strict=True))
    of = lm.exchange(before, after, n, 12, classes=3, rounds=10)

    def likelihood(of):
        b = np.zeros((3, 3))
        np.add.at(b, (of[before], of[after]), n)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(b) - f(b.sum(0)) - f(b.sum(1))

    assert likelihood(of) == pytest.approx(likelihood(groups[::-1]))


def test_shapes_agree(spark):
    words = [b"a", b"abc!", b"abcdef", b"\xc3\xa9", b"0123456789012345", b"abcdefg***", b" ", b"x-", b"ABCDEFGHIJ"]
    got = spark.createDataFrame([(w,) for w in words], "w binary").select("w", lm.shape_of(F.col("w")).alias("s")).collect()
    assert all(r["s"] == lm.shape(bytes(r["w"])) for r in got)
