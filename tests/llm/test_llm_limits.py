"""Limits of the quality rules between clean texts and junk."""

from __future__ import annotations

import random

from lumiquery.llm import quality_rules


def test_word_distance_alone_rejects_joined_junk(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(4, 9)))
    # common words in a thousand, about as in the documents
    share = {"en": 130, "es": 125, "de": 118, "fr": 117}
    rows = []
    for lang, n in share.items():
        listed = quality_rules.COMMON_WORDS[lang]
        for _ in range(30):
            ws = [listed[k % len(listed)] for k in range(n)] + [word() for _ in range(1000 - n)]
            rnd.shuffle(ws)
            rows.append((len(rows), " ".join(ws), lang, True))
        rows.append((len(rows), " | ".join(word() for _ in range(300)), lang, False))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, clean boolean")
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs.drop("clean")).collect()}
    for i, _, _, clean in rows:
        r = got[i]
        assert not r["base_failed"] and r["js_classes"] < quality_rules.MAX_CLASS_DISTANCE
        assert r["kept"] == clean, (i, r["js_words"])


def test_spans_of_one_long_text(spark):
    """A list of 200,000 hashes: work is in proportion to them."""
    import time

    from pyspark.sql import functions as F

    from lumiquery.llm import secret_scan

    n = 200_000
    d = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.expr(f"array_join(transform(sequence(1, {n}), k -> concat('é', md5(cast(k as string)))), '\\n')").alias("text"))
    began = time.perf_counter()
    row = secret_scan.scan_secrets(d).select(F.size("spans").alias("n"), F.expr("spans[0].start").alias("first"), F.expr("element_at(spans, -1).end").alias("last")).first()
    assert tuple(row) == (n, 1, 34 * n - 1) and time.perf_counter() - began < 60


def test_running_sums_of_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumiquery.llm import secret_scan

    monkeypatch.setattr(secret_scan, "RUN", 4)
    for n in (0, 1, 3, 4, 5, 8, 9, 50):
        steps = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("long")) if n else F.array().cast("array<bigint>")
        assert spark.range(1).select(secret_scan.running_sums(steps).alias("s")).first()["s"] == [k * (k - 1) // 2 for k in range(1, n + 1)]


def test_mixed_documents_are_not_shuffled(spark):
    import re

    from lumiquery.llm import mixing

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mixed_documents(d)._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan parquet")
    # the one exchange of whole rows holds the row at each source's cut, after it was found
    assert scans == 2 and len(re.findall(r"Exchange hashpartitioning\((?!src)", plan)) == 0


def test_targets_of_many_sources(spark):
    from pyspark.sql import functions as F

    from lumiquery.llm import mixing
    from lumiquery.operators import ordering

    sizes = spark.range(3_000).select((F.col("id") % 700).cast("string").alias("source"), (F.col("id") % 97 + 1).alias("words"))
    whole = {r["source"]: tuple(r) for r in mixing.source_targets(sizes).collect()}
    before, ordering.running_sum.__defaults__ = ordering.running_sum.__defaults__, (*ordering.running_sum.__defaults__[:-1], 50)
    try:
        parts = {r["source"]: tuple(r) for r in mixing.source_targets(sizes).collect()}
    finally:
        ordering.running_sum.__defaults__ = before
    assert whole == parts and len(whole) == 700
    total = sum(r[2] for r in whole.values())
    assert abs(sum(r[4] for r in whole.values()) - 1.5 * total) < 1e-3 and all(r[4] <= 2 * r[2] for r in whole.values())


def test_a_shard_that_is_cut_off(spark, tmp_path):
    import pytest

    from lumiquery.llm import token_output

    path = str(tmp_path / "t")
    token_output.write_tokens(spark.createDataFrame([(k, "some words " * k) for k in range(50)], "doc_id long, text string"), path, length=16)
    part = next((tmp_path / "t" / "shard=0").glob("part-*"))
    data = part.read_bytes()
    part.write_bytes(data[: -token_output.stride(16)])
    with pytest.raises(ValueError, match="cut off"):
        token_output.read_tokens(spark, path)
