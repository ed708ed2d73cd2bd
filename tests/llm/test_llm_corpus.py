"""Deduplication, decontamination, mixing, archives, tokens and the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumiquery.llm import common, decontaminate, mixing, near_dedup, token_output, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r") for i, t, s in rows], SCHEMA)


def variants(rnd, n, base_words=120, edits=(0, 8)):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(*edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 99999)}"
        out.append(" ".join(w))
    return out


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = near_dedup.words_of(t)
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_against_brute_force(spark):
    rnd = random.Random(1)
    texts = variants(rnd, 120) + variants(rnd, 60, 200, (0, 3)) + [t.upper() for t in variants(rnd, 20, 30, (0, 1))]
    texts += ["one two", "ONE  two", "three", "", None, "  ", "five words in this text", "five words in this text"] + ["long " * 5000]
    rows = [(i * 3 + 1, t, "s") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_dedup_edges(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, None, "s")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", None, True)]
    assert near_dedup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_near_dedup_finds_every_pair_near_the_threshold(spark):
    rnd = random.Random(12)
    rows, pairs = [], 0
    for k in range(250):
        n = rnd.randint(60, 400)
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        # a copy that is cut or grown at its end, so that the sets differ in size, or edited inside
        j = rnd.uniform(0.85, 0.87)
        if k % 2:
            copy = base[: -(-int(j * 1000) * (n - 4) // 1000) + 4 + 1]
        else:
            copy = list(base)
            for at in rnd.sample(range(10, n - 10), max(1, int(n * (1 - j) / (1 + j) / 5))):
                copy[at] = f"x{rnd.randint(0, 10**6)}"
        rows += [(2 * k + 1, " ".join(base), "s"), (2 * k + 2, " ".join(copy), "s")]
    want = brute_components(rows)
    pairs = sum(c != i for i, (_, c) in want.items())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert pairs > 200 and got == want


@pytest.mark.parametrize("n", [300, 1200])
def test_pages_of_one_template_are_not_compared(spark, n):
    rnd = random.Random(n)
    template = " ".join(f"t{k}" for k in range(150))
    rows = [(k, k, f"{' '.join(f'u{rnd.randint(0, 10**7)}' for _ in range(40))} {template}") for k in range(n)]
    pages = spark.createDataFrame(rows, "rep long, comp long, text string")
    tokens = common.cut(near_dedup._prefixes(pages, near_dedup._frequencies(pages), 85))
    # the rarest 27 or so of 186 shingles, and none of the template's that two pages share
    assert tokens.count() < 30 * n and near_dedup._cells(tokens).count() == 0
    # members of one component under one shingle meet the few others only: rows in proportion, not squared
    family = tokens.select(F.lit(1).alias("token"), "rep", F.when(F.col("rep") > 3, F.lit(10**9)).otherwise(F.col("rep")).alias("comp"), "n_shingles", "place", F.lit(True).alias("indexed")).dropDuplicates(["rep"])
    assert near_dedup._cells(family).count() <= 3 * n


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[200:2200])
    ra, rb = near_dedup.sketch(a, near_dedup.FINE), near_dedup.sketch(b, near_dedup.FINE)
    assert (np.maximum(ra, rb) == near_dedup.sketch(np.union1d(a, b), near_dedup.FINE)).all()
    j = near_dedup.likely_jaccard(np.array([2000.0]), np.array([2000.0]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), near_dedup.FINE)[0]
    assert abs(j - 1800 / 2200) < 0.08


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r["rep"]: r["comp"] for r in near_dedup.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


ITEMS = [(k, f"what is the {a} of the {b} near {c} in the year {k} of kings. it is the {d} with {a} stones") for k, (a, b, c, d) in enumerate((f"al{k}", f"be{k}", f"ga{k}", f"de{k}") for k in range(120))]


def test_wand_finds_all_above_threshold():
    rnd = random.Random(2)
    index = decontaminate.Index(ITEMS)
    names = list(index.terms)
    for _ in range(150):
        terms = set(rnd.sample(range(len(names)), rnd.randint(1, 40))) | set(index.terms[w] for w in decontaminate.words_of(rnd.choice(ITEMS)[1]) if rnd.random() < 0.8)
        threshold = rnd.choice([0.1, 0.3, 0.6])
        scores = defaultdict(float)
        for t in terms:
            for j, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[j] += x
        want = {j: s for j, s in scores.items() if s >= threshold - 1e-9}
        got = dict(index.search(terms, threshold))
        assert got.keys() == want.keys() and all(abs(got[j] - s) < 1e-9 for j, s in want.items())


def test_decontamination(spark):
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice(["the", "of", "king", "stone", "is", "year", f"q{rnd.randint(0, 999)}"]) for _ in range(n))
    rows = [(k, f"{filler(rnd.randint(0, 90))} {ITEMS[k % 120][1].upper()} {filler(rnd.randint(0, 90))}" if k % 3 == 0 else filler(200), "s") for k in range(90)]
    half = ITEMS[5][1].split(". ")
    rows += [(200, half[0], "s"), (201, half[1], "s"), (202, None, "s"), (203, "", "s"), (204, filler(30_000), "s")]
    bench = spark.createDataFrame([*ITEMS, (500, None), (501, "yes"), (502, "")], "item_id long, text string")
    d = docs(spark, rows)
    want = sorted((k, k % 120) for k in range(90) if k % 3 == 0)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(d, bench).collect()) == want
    sharded = decontaminate.match_documents(d, bench, ("doc_id",), max_items=50)
    assert sorted((r["doc_id"], m["item_id"]) for r in sharded.collect() for m in r["matches"]) == want
    assert decontaminate.contaminations(d, bench.limit(0)).count() == 0 and decontaminate.contaminations(d.limit(0), bench).count() == 0


def fill(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        level = (budget - sum(2 * sizes[s] for s in order if s not in left)) / sum(w[s] for s in left)
        full = {s for s in left if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in left}
        target |= {s: 2 * sizes[s] for s in full}
        left -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "ä", "B", "", None, "z9"][: rnd.randint(1, 7)]
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 50))), rnd.choice([names[0], *names])) for i in range(300)] + [(900, None, names[0])]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = fill(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [(1, "a", "s")]).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs(spark, [(1, None, "s"), (2, "", None)])).collect()} == {0}
    rows = [(7, "a b c", "s")] * 3 + [(None, "x y", "t")]
    assert sum(r["taken"] for r in mixing.mix(docs(spark, rows)).collect()) == 16
    out = mixing.mixed_documents(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(120)]
    d = docs(spark, rows)
    copies = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(d).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(d).collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_prefix_of_hot_group(spark):
    n = 3000
    rows = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % 7).alias("size"), (F.pmod(F.xxhash64("id"), F.lit(2**32))).alias("h32"), "id", F.lit(n).alias("rows"))
    got = sorted(((r["h32"], r["id"]), r["size"], r["before"]) for r in common.hash_order_prefix(rows, ["g"], "size", "h32", ["id"], "rows").collect())
    at = 0
    for _, size, before in got:
        assert before == at
        at += size


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "http://a b\r\nX: y", fake), (6, "u", "é🙂\n\r\n\r\n"), (7, "u", "big " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(5))
    warc.write_warc(pages.repartition(2), str(tmp_path / "w"), archive_bytes=500)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {1: (4, "revisit", 9), 2: (4, "revisit", 9), 9: (4, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (len(fake), "response", None), 6: (11, "response", None), 7: (200_000, "response", None)}
    warc.write_warc(pages, str(tmp_path / "v"), least_bytes=5, compression="none")
    assert {r["record_type"] for r in warc.read_warc(spark, str(tmp_path / "v")).collect()} == {"response"}


def test_warc_edges(spark, tmp_path):
    rows = [(None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (None, "u", "only"), (None, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == {(3, "response", None): 2, (None, "revisit", 3): 1, (None, "response", None): 2}
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_members_and_ids(spark, tmp_path):
    rnd = random.Random(4)
    noise = "".join(chr(rnd.randint(32, 0x2FFF)) for _ in range(200_000))
    rows = [(k, "u", f"page {k % 7} {noise if k % 10 == 0 else ''}") for k in range(40)] + [(38, "u", "page 3 ")] * 3 + [(39, "u", "page 4 ")] * 2 + [(50, "u", "x" * (17 << 20))]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    path = tmp_path / "w"
    warc.write_warc(pages, str(path), archive_bytes=100_000, date="2025-02-03T04:05:06Z")
    heads = []
    for f in path.glob("archive=*/part-*"):
        found = [h for m in warc.members(memoryview(f.read_bytes())) for h, _ in warc.parse_warc(m)]
        assert f.stat().st_size <= 100_000 or len(found) == 1
        assert len([m for m in warc.members(memoryview(f.read_bytes())) if m]) == len(found)
        heads += found
    assert len(heads) == len(rows) and len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    again = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert again and {h["WARC-Date"] for h in heads} == {"2025-02-03T04:05:06Z"}
    for h in again:
        named = h.get("WARC-Refers-To")
        assert (named is None) == (h["X-Refers-To-Page-Id"] in ("38", "39"))
        assert named is None or (by_id[named]["X-Page-Id"], by_id[named]["WARC-Type"], by_id[named]["WARC-Payload-Digest"]) == (h["X-Refers-To-Page-Id"], "response", h["WARC-Payload-Digest"])
    assert warc.read_warc(spark, str(path), "int").filter("record_type = 'revisit'").count() == len(again)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_feistel_is_a_permutation(n):
    assert sorted(token_output.feistel(np.arange(n), n)) == list(range(n))
    if n > 200:
        assert list(token_output.feistel(np.arange(n), n)) != list(token_output.feistel(np.arange(n), n, key=7))


def test_tokens_round_trip(spark, tmp_path):
    rows = [(i, f"text number {i} " + "more words " * (i * 7 % 400), "s") for i in range(60)] + [(70, None, "s"), (71, "", "s"), (None, "no id <|endoftext|> é🙂", "s"), (5, "again", "s")]
    d = docs(spark, rows).repartition(5)
    n = token_output.write_tokens(d, str(tmp_path / "t"), length=64)
    got = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    assert all(r["slot"] == r["shard"] * token_output.per_shard(n) + r["offset"] // token_output.stride(64) for r in got)
    tokenizer = token_output.Tokenizer(open(token_output.VOCABULARY, "rb").read())
    texts = Counter()
    parts = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["seq_no"])):
        parts[r["doc_id"]].append(np.frombuffer(r["tokens"], "<u2"))
        assert r["n_tokens"] == len(parts[r["doc_id"]][-1])
    for i, t, _ in rows:
        if i != 5:
            texts[i] = tokenizer.decode(np.concatenate(parts[i]))
            assert texts[i] == (t or "")
    shard = min(r["shard"] for r in got)
    files = list((tmp_path / "t" / f"shard={shard}").glob("part-*"))
    assert len(files) == 1 and files[0].stat().st_size % token_output.stride(64) == 0
    assert token_output.materialise(d.limit(0), str(tmp_path / "e")).count() == 0


def test_tokens_resume_at_a_slot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "MIN_PER_SHARD", 16)
    monkeypatch.setattr(token_output, "SHARD_GROWTH", 2)
    low = -(2**63)
    rows = [(low if i == 3 else None if i % 11 == 0 else i, "some words of a text " * (i % 60), "s") for i in range(90)]
    d = docs(spark, rows).repartition(3)
    path = str(tmp_path / "t")
    n = token_output.write_tokens(d, path, length=32)
    slots = token_output.per_shard(n)
    whole = {r["slot"]: (r["doc_id"], r["seq_no"], bytes(r["tokens"])) for r in token_output.read_tokens(spark, path).collect()}
    assert len(whole) == n > 3 * slots and low in {v[0] for v in whole.values()} and None in {v[0] for v in whole.values()}
    for start in (0, slots + 5, 2 * slots, n - 1, n):
        want = {k: v for k, v in whole.items() if k >= start}
        assert {r["slot"]: (r["doc_id"], r["seq_no"], bytes(r["tokens"])) for r in token_output.read_tokens(spark, path, start).collect()} == want
        read = list(token_output.stream_records(spark, path, start))
        assert [r[0] for r in read] == list(range(start, n)) and {r[0]: (r[1], r[2], r[3].tobytes()) for r in read} == want


def test_tokens_with_text_ids(spark, tmp_path):
    d = spark.createDataFrame([(f"doc-{i}" if i else None, "words " * i) for i in range(40)], "doc_id string, text string")
    got = token_output.materialise(d, str(tmp_path / "t"))
    assert {r["doc_id"] for r in got.collect()} == {None, *(f"doc-{i}" for i in range(1, 40))}
    assert got.columns.count("doc_id") == 1 and got.count() == 40


@pytest.mark.parametrize("n", [1, 10_000, 10**6, 10**8, 10**11])
def test_shards_and_their_size_grow_alike(n):
    slots = token_output.per_shard(n)
    assert -(-n // slots) * 4 <= max(4, 8 * n**0.5) and slots * token_output.stride() < 1.2e9


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    extra = d.withColumn("score", F.lit(1)).withColumn("matches", F.lit("m")).withColumn("Size", F.lit(2))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    now, kept = extra, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == extra.columns, name
        path = str(tmp_path / name.split(" ")[0])
        out.write.parquet(path)
        now = spark.read.parquet(path)
        rows = now.select("doc_id", "text").collect()
        assert all(texts[r["doc_id"]] == r["text"] for r in rows) and {r["doc_id"] for r in rows} <= kept
        kept = {r["doc_id"] for r in rows}
        if name.startswith("MinHash"):
            comps = brute_components([(i, texts[i], "s") for i in kept])
            assert all(c == i for i, (_, c) in comps.items())
        if name.startswith("benchmark"):
            items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(x in " ".join(decontaminate.words_of(texts[i])) for i in kept for x in items)
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == kept
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_one_row_of_repeated_ids(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "other words in this text here", "s"), (None, "x", "s"), (None, "x", "s")]
    got = corpus_pipeline.dedup(spark, docs(spark, rows), "")
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "None", "None"]
