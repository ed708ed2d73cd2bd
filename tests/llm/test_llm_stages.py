"""Stages of the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lumiquery.llm import decontaminate, mixing, near_dedup, quality_crf

SCHEMA = "doc_id long, text string, lang string, source string"


def survivors(texts, percent):
    """Smallest id of each component of links at this similarity, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = near_dedup.words_of(t)
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False))
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return sorted(set(comp.values()))


def test_dedup_stage_links_from_080(spark):
    rnd = random.Random(11)
    texts = {}
    for k in range(40):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
        # one to five edits: similarities from about 0.97 to 0.71
        for n in (0, 1 + k % 5):
            words = list(base)
            for at in rnd.sample(range(10, 140), n):
                words[at] = f"x{rnd.randint(0, 99999)}"
            texts[len(texts) * 3 + 1] = " ".join(words)
    want = survivors(texts, 80)
    assert len(want) < len(survivors(texts, 85))
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    rnd.shuffle(rows)
    got = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_mix_stage_meets_budgets_without_ids(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        text = " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))) if k % 4 else "the same text"
        doc = None if k % 3 == 0 else 7 if k % 3 == 1 else k
        rows.append((doc, text, rnd.choice(["s1", "s1", "s2", None]), 1, "x", 2, "r"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _copies string, _copy int, row string")
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    got, target = Counter(), {r["source"]: r["target"] for r in mixing.mix(d).collect()}
    for r in mixed.collect():
        assert (r["_id"], r["_copies"], r["_copy"], r["row"]) == (1, "x", 2, "r")
        got[r["source"]] += len(r["text"].split())
    assert set(got) == set(target) and all(0 <= got[s] - int(t) < 30 for s, t in target.items())
    taken = Counter()
    for r in mixing.mix(d).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(t) for s, t in target.items())


def test_stages_keep_columns_with_internal_names(spark, tmp_path):
    names = ["_id", "_y", "_row", "_copies", "_copy", "_found", "_text", "score", "matches", "key", "src", "row", "copies", "extra", "id", "digest", "place", "_comp", "n", "rep"]
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for k, n in enumerate(names):
        d = d.withColumn(n, F.lit(k))
    again = d.filter("doc_id % 7 = 0")
    d = d.unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        path = str(tmp_path / name.split(" ")[0])
        out.write.parquet(path)
        d = spark.read.parquet(path)
        assert d.count() and all(d.select(n).distinct().collect() == [(k,)] for k, n in enumerate(names)), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count()


def words(rnd, n=60):
    return " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))


def test_dedup_stage_tells_texts_of_one_id_apart(spark):
    rnd = random.Random(4)
    one, two, other = words(rnd), words(rnd), words(rnd)
    near = two.replace(two.split()[30], "changed")
    rows = [(7, one), (7, two), (8, other), (9, near), (7, one), (None, one), (None, words(rnd)), (None, None), (None, None), (5, ""), (-3, other + "  ")]
    d = spark.createDataFrame([(i, t, "s", {"k": "v"}) for i, t in rows], "doc_id long, text string, source string, extra map<string,string>")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.dedup(spark, d, "").collect())
    # 7 holds two texts; 9 is a near copy of the second; rows without ids stay
    assert got == Counter([(7, one), (7, two), (-3, other + "  "), (None, one), rows[6], (None, None), (None, None), (5, "")])
    texts = spark.createDataFrame([(str(i), t) for i, t in rows[:4]], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup(spark, texts, "").collect()) == ["7", "7", "8"]


def test_rows_that_stages_lose_have_a_reason(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    # every third id is that of another document too, and every seventh row has none
    ids = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    d = spark.createDataFrame(d.withColumn("row", F.col("doc_id")).withColumn("doc_id", ids).collect(), d.withColumn("row", F.col("doc_id")).schema)
    seen = lambda x: Counter(r["row"] for r in x.select("row").collect())
    before = seen(d)
    scores = {r["row"]: r["score"] for r in plain_scores(spark, d, sf)}
    good = seen(out := corpus_pipeline.quality(spark, d, sf))
    assert good == Counter(r for r in before if scores[r] >= 0.5)
    texts = {r["row"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    unnamed = sum(r["doc_id"] is None for r in out.collect())
    once = seen(out := corpus_pipeline.dedup(spark, out, sf))
    short = {tuple(near_dedup.words_of(t)) for t in texts.values() if len(near_dedup.words_of(t)) < near_dedup.SHINGLE}
    long_ = {i: t for i, t in texts.items() if len(near_dedup.words_of(t)) >= near_dedup.SHINGLE}
    assert () not in short and len(once) == sum(once.values()) == len(survivors(long_, corpus_pipeline.NEAR_PERCENT)) + len(short) + unnamed
    clean = corpus_pipeline.decontamination(spark, out, sf)
    held = decontaminate.match_documents(out.select("row", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"), ("row",))
    assert seen(clean) == Counter(r["row"] for r in held.collect() if not r["matches"])
    mixed, size = seen(corpus_pipeline.mix(spark, clean, sf)), seen(clean)
    assert set(mixed) <= set(size) and all(n <= 2 for n in mixed.values())


def plain_scores(spark, d, sf):
    """Scores of the same classifier, row by row."""
    field = quality_crf.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    return quality_crf.score_documents(d.select("doc_id", "row", "text"), field, "row").collect()
