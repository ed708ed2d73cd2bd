"""Licence, URL, quality and secret operators against brute force, and their edge cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquery.llm import license_scan, quality_crf, quality_rules, secret_scan, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, score double, _text string, size int"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 0.5, "x", 1) for i, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", " ", "\n\n", "a", "é\x85ü word", "word " * 30_000, "same text here", "same text here", "퟿🙂 x\r\ny"]


def test_licences(spark):
    rnd = random.Random(1)
    words = ["MIT", "License", "apache", "LICENSE", "general", "public", "and,", "É", "licensed", "under"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + EDGES
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places = sorted((label, k) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        assert got[i]["n_words"] == len(ws)
        assert sorted((m["label"], m["start_word"]) for m in got[i]["matches"] if m["base"]) == places


def test_licence_templates(spark):
    text = "x " * 20 + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Licensed under CC BY-NC 4.0."
    r = license_scan.scan_licenses(docs(spark, [text, "plain", "with or without fee"])).collect()
    assert {m["label"] for m in r[0]["matches"]} == {"isc", "cc-by-nc"} and not r[1]["matches"] and not r[2]["matches"]
    assert license_scan.scan_licenses(docs(spark, ["a"]).limit(0)).count() == 0


def licence_text(label):
    return next(t.text for t in license_scan.TEMPLATES if t.label == label)


def edited(rnd, ws, n):
    """n words put in, left out or changed, none of them in the key phrases at either end."""
    ws = list(ws)
    for _ in range(n):
        k = rnd.randrange(len(ws))
        ws[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["entity"], ["or", "other"]])
    return ws


def test_licences_with_changed_words(spark):
    mit = licence_text("mit-text")
    changed = mit.replace("any person obtaining", "any person or entity obtaining").replace("publish ", "")
    lines = "\n * ".join(" ".join(changed.upper().split()[k : k + 9]) for k in range(0, 70, 9))
    half = " ".join(mit.split()[:30])
    texts = [changed, lines, half, mit + " filler " * 50 + mit, "no licence here " * 20]
    got = [sorted(m["label"] for m in r["matches"]) for r in license_scan.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["mit-text"], ["mit-text"], [], ["mit-text", "mit-text"], []]


def test_licence_index_against_every_position():
    rnd = random.Random(6)
    idf = {w: rnd.uniform(0.5, 9) for t in license_scan.TEMPLATES for w in license_scan.words_of(t.text)}
    index = license_scan.LicenseIndex(license_scan.TEMPLATES, idf)
    n_found = 0
    for _ in range(60):
        i = rnd.randrange(len(license_scan.TEMPLATES))
        body = edited(rnd, index.words[i], rnd.choice([0, 1, 2, 4, 9]))
        words = [rnd.choice(["the", "software", "license", "x", "y"]) for _ in range(rnd.randint(0, 30))] + body + ["end"] * rnd.randint(0, 9)
        want = set()
        for j, t in enumerate(license_scan.TEMPLATES):
            ws, x = index.words[j], index.weights[j]
            for o in range(-len(ws), len(words)):
                if t.coverage >= 1:
                    if o >= 0 and words[o : o + len(ws)] == ws:
                        want.add(t.label)
                    continue
                got, first, last = license_scan.align(words, ws, x, o)
                place = words[first : last + 1] if got else []
                holds = lambda key, place=place: any(place[a : a + len(key)] == key for a in range(len(place) - len(key) + 1))
                if got >= t.coverage * sum(x) - 1e-9 and all(holds(license_scan.words_of(k)) for k in t.key_phrases):
                    want.add(t.label)
        found = {license_scan.TEMPLATES[j].label for j, *_ in index.scan(words)}
        assert found == want, (found, want)
        n_found += len(want)
    assert n_found > 40


def test_licence_query_columns(spark):
    from lumiquery.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_license_scan(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ws = license_scan.words_of(texts[r["doc_id"]])
        places = [(k, label) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        base = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and (r["score"] == 1.0 if base else (0 < r["score"] <= 1) == bool(labels))


def test_urls_against_brute_force(spark):
    rnd = random.Random(2)
    labels, parts = ["a", "b", "com", "net", "x1"], ["/", "/en", "/en/", "/en/7", "/de/", ""]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    rules = {(host(), rnd.choice(parts)): rnd.choice(["allow", "block"]) for _ in range(60)}
    urls = [f"http{rnd.choice(['', 's'])}://{host().upper() if rnd.random() < 0.3 else host()}{rnd.choice(parts)}{rnd.choice(['', '1', '?q=/en/', '#f'])}" for _ in range(400)]
    urls += [None, "", "nothing", "://", "ftp://a.com", "http://a.com?x", "http://hot.com/en/1"] + ["http://hot.com/en/1"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] + [("hot.com", "/en/", "block")], url_filter.RULE_SCHEMA)
    rules[("hot.com", "/en/")] = "block"
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(a + b), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, key=lambda x: x[0])[0] if fits else None
        assert (got[i]["host"], got[i]["path"]) == (h, p)
        if best is None:
            assert (got[i]["rule"], got[i]["verdict"]) == (None, "allow")
        else:
            assert (got[i]["rule"], got[i]["verdict"]) in {(r, v) for n, r, v in fits if n == best}
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_url_query_takes_the_verdicts_of_its_rules(spark, tmp_path):
    import duckdb

    from lumiquery.llm import oracle, queries

    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.Example.com/en/77": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://x.example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"),
        "http://b.org/es/?q": ("org/es/", "block"), "http://b.org/en/": (None, "allow"),
    }
    spark.createDataFrame([(k, u, "") for k, u in enumerate(want)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["rule"], r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == list(want.values())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert con.sql(f"select rule, verdict from ({oracle.oracle_sql()['op2_url_filter']}) order by page_id").fetchall() == got


def test_quality_rules_counts(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a b", "c ", "\n", "x", "#", "$ ", "a b c ", "\t", "é "]) for _ in range(rnd.randint(0, 80))) for _ in range(60)] + EDGES
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = {k + j for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(again) > 50 * len(ws)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.apply_quality_rules(docs(spark, ["a"]).limit(0)).count() == 0


def test_quality_rules_divergence(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join(rnd.choice(["the", "of", "and", "river", "stone", "light", "cloud", "in", "that"]) + str(rnd.randint(0, 9)) * (rnd.random() < 0.02) + f"{chr(97 + rnd.randint(0, 25))}x" for _ in range(120))
    shout = " ".join(f"XY{chr(65 + rnd.randint(0, 25))}Q{k}!!" for k in range(120)).upper()
    texts = [prose() for _ in range(40)] + [shout]
    kept = [r["kept"] for r in quality_rules.apply_quality_rules(docs(spark, texts)).orderBy("doc_id").collect()]
    assert all(kept[:-1]) and not kept[-1]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    starts = np.array([0, 4, 5, 8])
    unary, move = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pair = quality_crf.forward_backward(unary, move, starts)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in itertools.pairwise(starts):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(unary[a + k] * v for k, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y)))
        z = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += w / z * np.array(y)
            for u, v in itertools.pairwise(y):
                pairs[u, v] += w / z
    assert np.allclose(p, want) and np.allclose(pair, pairs)


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_crf.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_classifier_edges(spark):
    d = docs(spark, EDGES)
    one = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_crf.classify(d, one).collect()} == {1.0}
    assert {r["score"] for r in quality_crf.classify(d, one.limit(0)).collect()} == {0.5}
    two = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_crf.classify(d.union(docs(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long"))), two).collect()
    assert len(got) == len(EDGES) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_crf.classify(d.limit(0), two).count() == 0


def brute_spans(t):
    found = []
    for name, p, group, least in (("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, m in ((("assign", "access", "hex").index(name), m) for m in re.finditer(p, t)) if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(found))


def test_secrets_against_brute_force(spark):
    rnd = random.Random(5)
    parts = ["password", "TOKEN", "Api_Key", "apikey", "secret", ":", "=", " ", "\"", "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0a1b2c3d", "deadbeef" * 4, "é🙂", "\n", "zz", "a", "-_=+"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + EDGES
    got = {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in ("assign", "access", "hex")) for r in secret_scan.scan_secrets(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute_spans(t or ""), t


def test_secret_ownership(spark):
    rows = [(i, "password = commonexample", f"owner{i % 7}") for i in range(30)] + [(100, "token: liveonlyhere1 token: liveonlyhere1", "owner1"), (101, None, None)]
    d = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(d).collect()}
    assert (got[3]["n_live"], got[3]["n_copied"], got[3]["most_owners"]) == (0, 1, 7)
    assert (got[100]["n_live"], got[100]["n_copied"]) == (1, 0) and len(got[100]["spans"]) == 2 and got[101]["spans"] == []
    assert secret_scan.scan_secrets(d.limit(0)).count() == 0


@pytest.mark.parametrize("scan", [license_scan.scan_licenses, quality_rules.apply_quality_rules, secret_scan.scan_secrets])
def test_null_id(spark, scan):
    d = docs(spark, ["some text"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert scan(d).first()["doc_id"] is None
