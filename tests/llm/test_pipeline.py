"""The stages on a small table, each against what it has to do with its own input."""

from collections import defaultdict

from test_free import SMALL, plain_matches
from test_native import plain_lines

import corpus_pipeline


def plain_representatives(rows):
    """The smallest id of each component over all pairs that share 0.8 of their five-word shingles; pairs are met by the shingles that they share."""
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    sets, holders, root = [(i, shingles(t)) for i, t in sorted(rows)], defaultdict(list), {}
    for i, s in sets:
        for x in s:
            holders[x].append(i)
    of = dict(sets)

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for i, s in sets:
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(of[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i, _ in sets}


def test_stages_on_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, empty tables and other columns with the operators' own names."""
    for name, label in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], label).write.parquet(str(tmp_path / f"{name}.parquet"))
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string, place long, `__place` long, _id string"
    some = [(1, "a b c", "en", "s", 5, "r", 1, 2, "i"), (1, "a b c", "en", "s", 5, "r", 1, 2, "i"), (None, None, None, None, None, None, None, None, None), (None, "x " * 50_000, "en", "t", 1, "r", 3, 4, "j"), (2, "", "en", "s", 0, "q", 5, 6, "k")]
    want = {"toxicity": 5, "line dedup": 5, "near-dedup": 3, "decontamination": 5, "bpe": 5}
    for name, stage in corpus_pipeline.STAGES:
        for rows, n in ((some, want[name]), ([], 0)):
            df = spark.createDataFrame(rows, shape)
            out = stage(spark, df, str(tmp_path)).collect()
            assert len(out) == n and (name == "bpe" or stage(spark, df, str(tmp_path)).columns == df.columns), name
            if name == "near-dedup" and rows:
                assert sorted(repr((r["doc_id"], r["place"], r["__place"])) for r in out) == ["(1, 1, 2)", "(None, 3, 4)", "(None, None, None)"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = before, docs.collect()
        assert name == "bpe" or docs.columns == names
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 0").collect()}
    before, after = rows["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert len(toxic & kept) <= len(toxic) // 3 and len(clean - kept) <= len(clean) // 100
    before, after = rows["line dedup"]
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=repr) == plain_lines([(r["doc_id"], r["text"], r["source"]) for r in before], 10)
    before, after = rows["near-dedup"]
    assert {r["doc_id"] for r in after} == plain_representatives([(r["doc_id"], r["text"]) for r in before])
    before, after = rows["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not plain_matches(r["text"], items)[1]}
    before, after = rows["bpe"]
    assert len(before) == len(after) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in after)
    assert corpus_pipeline.run(spark, SMALL).count() == len(after)
