"""Near copies by shingles against all pairs, and edited copies in the pipeline's stage."""

import random
import re

from test_free import docs, near_points, plain_components, same

import corpus_pipeline
from spanscan.llm import neardup, simhash


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def shingles(text):
    w = re.findall("[^ \\t-\\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_edited_copies_go(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 300))] for _ in range(60)]
    texts = [None, "", " \n", "few words", "Few  words", "few words more", *(" ".join(b) for b in bases)]
    for i, b in enumerate(bases):  # each word changed is in five shingles of either text
        texts += [" ".join(edited(rng, b, n)) for n in (1, 2, 3)[: i % 4]] + [" ".join(edited(rng, b, len(b) // 5))]
    chain = bases[0]
    for _ in range(20):
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(edited(rng, range(40), 40))}" for _ in range(40)]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    assert len(want) < len(texts) - 80 and len(want) > 150
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, [*rows, (8, texts[8])]), "")
    assert got.columns == docs(spark, rows).columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, []), "").count() == 0
    assert len(corpus_pipeline.drop_near_copies(spark, docs(spark, [(None, "a"), (None, "a")]), "").collect()) == 1


def test_copies_by_fingerprints_alone(spark, monkeypatch):
    """Without a band, SimHash and its trees find what lies within the radius, and the check takes what shares less than 0.8 out again."""
    def bits(s):
        h = [neardup.xxhash.xxh64_intdigest(x.encode()) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    monkeypatch.setattr(neardup, "bands", lambda hashes: [])
    rng = random.Random(9)
    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(rng, base, (1, 2, 4, 14)[i % 4]))]
    sets = [shingles(t) for t in texts]
    fps = [bits(s) for s in sets]
    for radius in (neardup.RADIUS, 16):
        near = [(i, i + 1) for i in range(0, len(texts), 2) if (fps[i] ^ fps[i + 1]).bit_count() <= radius]
        gone = {j for i, j in near if jaccard(sets[i], sets[j]) >= 0.8}
        assert len(gone) > 10 and (radius == neardup.RADIUS or len(near) > len(gone))
        got = neardup.one_of_each(docs(spark, list(enumerate(texts))), radius=radius).collect()
        assert {r["doc_id"] for r in got} == set(range(len(texts))) - gone


def test_links_of_trees_are_within_the_radius(spark, monkeypatch):
    points = near_points(11, 400)
    points = sorted({p & ~0xFFFF & (2**64 - 1) for p in points[:300]} | set(points[300:]))  # one shard of hundreds
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, within=True).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs) and same(pairs, points, plain_components(points))
    chain = [(1 << i) - 1 for i in range(64)]
    monkeypatch.setattr(simhash, "LEAF", 20)
    pairs = list(simhash._linked(simhash.np.array(chain, simhash.np.uint64), 3, within=True))
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs) and same(pairs, chain, [0] * 64)
    assert simhash.of_hashes(simhash.np.array([0b110, 0b011, 0b010], simhash.np.uint64)) == 0b010 and simhash.of_hashes(simhash.np.empty(0, simhash.np.uint64)) == 0


def test_hashes_are_of_the_shingles():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aB é\t\n\r\x0b\x0c  \x1c\xa0") for _ in range(rng.randrange(60)))
        assert len(neardup.hashed(t)) == len(shingles(t))
        assert list(neardup.hashed(t)) == sorted(neardup.xxhash.xxh64_intdigest(x.encode()) for x in shingles(t))


def counted(monkeypatch):
    """The number of pairs that are compared, in all."""
    seen, linked = [], neardup._linked

    def of(pairs, *more):
        pairs = neardup.settled(pairs)
        seen.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(neardup, "_linked", of)
    return seen


def test_texts_of_a_band_that_dont_link(spark, monkeypatch):
    """A passage that is most of each text: they meet in bands, and share less than 0.8."""
    rng, pairs, n = random.Random(4), counted(monkeypatch), 3000
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {' '.join(f'x{rng.randrange(10**9)}' for _ in range(30))}" for _ in range(n)]
    assert neardup.one_of_each(docs(spark, list(enumerate(texts)))).count() == n
    assert pairs[0] > n / 2 and sum(pairs) < 40 * n


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    """A third of the links are missing between any two, and all are one group; a hot text is dealt out by salts."""
    monkeypatch.setattr(neardup, "HOT", 100)
    rng, pairs, n = random.Random(5), counted(monkeypatch), 1500
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4])))) for i in range(n)]
    got = neardup.one_of_each(docs(spark, rows)).collect()
    root = {i: i for i in range(n)}
    sets = [shingles(t) for _, t in rows]
    near = [i for i in range(n) if jaccard(sets[i], shingles(" ".join(base))) >= 0.8]
    alone = [i for i in range(n) if all(jaccard(sets[i], sets[j]) < 0.8 for j in root if j != i)]
    assert len(near) > n / 2 and len(got) == len(alone) + 1
    assert sum(pairs) < 40 * n


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(3_000_000))
    rows = [(1, long), (2, long.replace("w5 ", "v5 ")), (3, "x" * 5_000_000), (4, "short text")]
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs(spark, rows)).select("doc_id").collect()) == [1, 3, 4]
