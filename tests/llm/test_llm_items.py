"""Decontamination by items of any number and length."""

from __future__ import annotations

import math
import random
from collections import Counter

from lumiquery.llm import decontaminate


def found(matched):
    return {(r["doc_id"], m["item_id"]): (round(m["score"], 9), m["question"], m["answer"]) for r in matched.collect() for m in r["matches"]}


def test_shards_score_like_one_index(spark):
    rnd = random.Random(5)
    some = lambda n: [rnd.choice(["stone", "river", "king"]) if rnd.random() < 0.4 else f"w{rnd.randint(0, 1500)}" for _ in range(n)]
    items = [(k, " ".join(some(rnd.randint(40, 60)))) for k in range(90)]
    rows = []
    for k, t in items:
        # the first word is lost, so that scores are under 1
        rows.append((k, " ".join([*some(rnd.randint(0, 80)), *t.split()[1:], *some(rnd.randint(0, 80))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = found(decontaminate.match_documents(docs, bench))
    assert len(whole) > 50 and any(v[0] < 1 for v in whole.values())
    assert found(decontaminate.match_documents(docs, bench, max_items=20)) == whole


def test_short_items_are_found_exactly(spark):
    items = [(1, "Who was Ada?"), (2, "yes"), (3, "中国的首都是哪里？"), (4, "GPT是什么"), (5, "日"), (6, "?!"), (7, None), (8, "首都 在 哪"), (9, " ".join(f"w{k}" for k in range(20)))]
    texts = {
        10: "he asked: who was  ada, and left", 11: "who is ada? who was adam", 12: "", 13: None, 14: "YES.", 15: "yesterday",
        16: "请问中国的首都是哪里？答案是北京", 17: "中国的首都", 18: "我问GPT是什么", 19: "xgpt是什么", 20: "今日は", 21: "首都在哪 首都 在 哪里", 22: "中国的首都是哪里。yes",
    }
    want = {(10, 1), (14, 2), (16, 3), (18, 4), (20, 5), (21, 8), (22, 3), (22, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_items in (decontaminate.MAX_ITEMS, 2):
        got = found(decontaminate.match_documents(docs, bench, max_items=max_items))
        assert got.keys() == want and set(got.values()) == {(1.0, 1.0, 1.0)}


def brute(docs, items):
    """Every passage against every item, by the formula: (doc, item) whose score and overlaps reach the thresholds."""
    d = decontaminate
    words = {i: d.words_of(t) for i, t in items if t}
    scored = {i: ws for i, ws in words.items() if len(ws) >= d.MIN_WORDS}
    n, mean, stride = len(scored), sum(map(len, scored.values())) / len(scored), max(map(len, scored.values()))
    df = Counter(w for ws in scored.values() for w in set(ws))
    found = set()
    for doc, text in docs:
        ws = d.words_of(text)
        for i, item in words.items():
            if i not in scored:
                if any(ws[k : k + len(item)] == item for k in range(len(ws))):
                    found.add((doc, i))
                continue
            tf = Counter(item)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (d.K1 + 1) / (f + d.K1 * (1 - d.B + d.B * len(item) / mean)) for w, f in tf.items()}
            q, a = d.split_item(dict(items)[i])
            for k in range(0, max(1, len(ws)), stride):
                share = sum(impact[w] for w in set(ws[k : k + 2 * stride]) & impact.keys()) / sum(impact.values())
                near = ws[max(0, k - stride) : k + 3 * stride]
                if share >= d.THRESHOLD - 1e-9 and d.overlap(q, near) >= d.QUESTION_OVERLAP and d.overlap(a, near) >= d.ANSWER_OVERLAP:
                    found.add((doc, i))
    return found


def test_every_passage_against_every_item(spark):
    rnd = random.Random(8)
    some = lambda n: [rnd.choice(["the", "of", "stone", "river"]) if rnd.random() < 0.3 else f"w{rnd.randint(0, 400)}" for _ in range(n)]
    items = [(k, " ".join(some(rnd.randint(12, 40))) + ". " + " ".join(some(rnd.randint(3, 9)))) for k in range(16)]
    items += [(20, "zebra"), (21, "ada who"), (22, "one two three"), (23, "w1 w2 w3 w4")]
    docs, planted = [], set()
    for k in range(120):
        i, text = rnd.choice(items)
        ws = decontaminate.words_of(text)
        edits = rnd.choice([0, 0, 1, 2, 6]) if len(ws) > 10 else 0
        for _ in range(edits):
            ws[rnd.randrange(len(ws))] = "edited"
        if edits <= 1:
            planted.add((k, i))
        docs.append((k, " ".join([*some(rnd.randint(0, 90)), *ws, *some(rnd.randint(0, 90))])))
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_items in (decontaminate.MAX_ITEMS, 7, 1):
        assert found(decontaminate.match_documents(d, bench, max_items=max_items)).keys() == want, max_items
    # copies with at most one word changed: all but those whose few answer words were hit
    assert len(planted & want) >= 0.9 * len(planted)


def test_shards_run_in_one_worker(spark):
    docs = spark.createDataFrame([(k, f"some words before the item number {k % 40} with words of its own v{k % 40} and w{k % 40} then the end of it") for k in range(120)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"the item number {k} with words of its own v{k} and w{k}") for k in range(40)], "item_id long, text string")
    key = lambda df: sorted((r["doc_id"], [(m["item_id"], round(m["score"], 9)) for m in sorted(r["matches"])]) for r in df.collect())
    one, many = (decontaminate.match_documents(docs, bench, max_items=m) for m in (1_000, 3))
    assert many._jdf.queryExecution().toString().count("MapInArrow") == one._jdf.queryExecution().toString().count("MapInArrow")
    assert key(one) == key(many) and all(k % 40 in [m[0] for m in found] for k, found in key(many))
