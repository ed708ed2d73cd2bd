"""Token counts, spelling variants and the filter audit against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumiquery.llm import filter_audit, queries, spelling, token_counts

DATA = "/root/testdata/sf0.001"
JSON = ("byte_bpe_50k.json", "word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string"


def library(name):
    """A function that gives a text's number of tokens as the library does."""
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        held = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(held.encode(t))
    made = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(made.encode(t, add_special_tokens=False).ids)


TEXTS = ["", "a", "one two  three\n\n four", "it's 9's we'll <|endoftext|> <|endoftext|>x", "Ärger über Öl, naïve façade", "ab12cd34" * 50, "x" * 5000, " \t\n  ", "漢字、かな。" * 40, "a b c", "😀😀 😀", "\x1c\x1d a", "▁a ▁b", "A b. C d! 1 2"]


@pytest.mark.parametrize("name", [*JSON, "piece_bpe_32k.model"])
def test_pieces_count_like_whole_texts(name):
    with open(public_tokenizers.path(name), "rb") as f:
        counter, whole = token_counts.Counter(name.rpartition(".")[2], f.read()), library(name)
    assert name.endswith(".model") or counter.cut is not None
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice(["a", "B", "'s", "'", " ", "  ", "\n", "7", "é", "漢", "。", "<|endoftext|>", "<|", ".", " ", "z9"]) for _ in range(60)) for _ in range(300)]
    for most in (1, 7, 40):
        assert counter.counts(iter(texts), len(texts), batch_bytes=50, piece_chars=most).tolist() == [whole(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_in_pieces(text):
    counter, whole = byte_level()
    assert "".join(token_counts.pieces(text, counter.cut, 3)) == text
    assert counter.counts(iter([text]), 1, piece_chars=3)[0] == whole(text)


def byte_level(made={}):  # noqa: B006
    if not made:
        with open(public_tokenizers.path(JSON[0]), "rb") as f:
            made["it"] = token_counts.Counter("json", f.read()), library(JSON[0])
    return made["it"]


def test_unknown_forms_are_not_cut():
    whole = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}
    assert token_counts._json_can_split(whole)
    assert not token_counts._json_can_split(whole | {"pre_tokenizer": {"type": "Metaspace"}})
    assert not token_counts._json_can_split(whole | {"normalizer": {"type": "Prepend", "prepend": "x"}})
    assert not token_counts._json_can_split(whole | {"added_tokens": [{"lstrip": False, "rstrip": True, "single_word": False, "content": "<s>"}]})
    with pytest.raises(ValueError):
        token_counts.Counter("bin", b"")


def test_token_query_against_the_library(spark):
    whole = library(JSON[0])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_token_counts(spark, DATA).collect()}
    assert got == {i: (len((t or "").encode()), n := whole(t or ""), n > 512) for i, t in texts.items()}


def test_token_counts_edges(spark):
    path = public_tokenizers.path(JSON[0])
    d = spark.createDataFrame([(None, None, "n", 1), (1, "", "n", 1), (2, "a b", "n", 1), (2, "a b", "n", 1), (3, "word 12 " * 40_000, "n", 1)], "doc_id long, text string, n_tokens string, _text int")
    got = sorted(tuple(r) for r in token_counts.count_tokens(d, path).fillna(-1, "doc_id").collect())
    assert got[:4] == [(-1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False)]
    assert got[4] == (3, 320_000, library(JSON[0])("word 12 " * 40_000), True)
    assert token_counts.count_tokens(d.limit(0), path).collect() == []
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62') as string)").alias("text"))
    assert token_counts.count_tokens(broken, path).first()["n_bytes"] == 3


def words_of(rows):
    """Words and their counts, by hand."""
    n = Counter()
    for doc, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in raw)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def variants(n):
    """All rows, by comparing with every single deletion, replacement and insertion."""
    letters, out = sorted(set("".join(n))), {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = (near & set(n)) - {w}
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(near))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def test_spelling_query_against_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(words_of(texts))


def test_spelling_edges(spark):
    rnd = random.Random(9)
    base = ["aaaaaaa", "aaaaaaaa", "abababab", "Éclairage", "éclairage", "straßen", "strasen", "STRASEN", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(None, None), (1, ""), (2, "short wo7ds"), (3, "q" * 3_000 + " " + "q" * 3_001), (3, "q" * 3_000 + " " + "q" * 3_001), (4, "q" * 3_001)]
    for k in range(900):
        w = list(rnd.choice(base))
        if k % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice("abz")
        rows.append((k if k % 5 else None, "".join(w) + rnd.choice([" ", ".", "1"])))
    rows += [(10_000 + k, "abcdefgh abcdefgh") for k in range(300)] + [(20_000 + k, "abcdefghi " * 20) for k in range(300)]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n int, _run int")
    got = {tuple(r) for r in spelling.group_variants(spelling.count_words(d)).collect()}
    assert got == variants(words_of(rows))
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of two forms
    assert spelling.group_variants(spelling.count_words(d.limit(0))).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(spelling.count_words(d), ratio=1)


def test_spelling_chains_and_ties(spark):
    chain = [("abcdefghijklmnop"[: 7 + k], 10**k * 2) for k in range(9)]
    ties = [("zzzzzzx", 50), ("zzzzzzy", 50), ("zzzzzzz", 2)]
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(chain + ties, "word string, n long")).collect()}
    assert {got[w]["root"] for w, _ in chain} == {chain[-1][0]} and got["zzzzzzz"]["form"] == "zzzzzzx" and got["zzzzzzx"]["form"] is None
    assert {tuple(r) for r in got.values()} == variants(dict(chain + ties))


def test_full_filter_and_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    n = {"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 8))): rnd.choice([2, 30, 400]) for _ in range(800)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = variants(n)
    monkeypatch.setattr(spelling, "MAX_BITS", spelling.LEAST_BITS)
    monkeypatch.setattr(spelling, "BLOCK", 64)
    monkeypatch.setattr(spelling, "TASK_WORDS", 50)
    assert {tuple(r) for r in spelling.group_variants(words).collect()} == want


def test_candidates_are_distinct_and_complete():
    import numpy as np

    every = spelling.Neighbours(["a", "b", "é"], np.full(2**12, 255, np.uint8), 15)
    for word in ("aaabbaa", "ababéab", "b", "aa"):
        got = [c for _, c in every.of([word])]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in "abé" for k in (0, 1) if i + k <= len(word)}
        assert len(got) == len(set(got)) and set(got) == want - {word}


def audited(rows, labels):
    """The result by applying every order to every row."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    fails = []
    for doc, text, source in rows:
        t = text or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        own = {c for c, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), doc is not None and doc > first[t]), strict=True) if f}
        fails.append((source or "", own, doc in good, doc in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                at = [f for f in fails if f[0] == part]
                gone = [f for f in at if c in f[1] and not f[1] & before]
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = (sum(not f[1] & (before | {c}) for f in at), len(gone), sum(c in f[1] and bool(f[1] & before) for f in at), sum(f[1] == {c} for f in at), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(seed, n):
    rnd = random.Random(seed)
    texts = [None, "", "a " * 60, "A B C", "x | y"] + [" ".join(rnd.choice(["one", "two", "Three", "FOUR", "5%", f"w{rnd.randint(0, 99)}"]) for _ in range(rnd.choice([5, 55, 70]))) for _ in range(12)]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts) if k % 3 else texts[2], rnd.choice(["s1", "s1", "", None, "s2"])) for k in range(n)]
    return rows, [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in [*range(30), *range(10), None]]


@pytest.mark.parametrize("held", [1, 200, 1 << 25])
def test_audit_against_brute_force(spark, monkeypatch, held):
    rows, labels = audit_rows(held, 400)
    local = [t for part in (rows[:150], rows[150:]) for t in filter_audit.settle([(d, s or "", 0, zlib.crc32((t or "").encode()), t or "") for d, t, s in part], held)]
    assert sum(n for _, v in local for _, n in v[3]) == len(rows)
    settle = filter_audit.settle
    monkeypatch.setattr(filter_audit, "settle", lambda rows: settle(rows, held))
    d = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], SCHEMA + ", mask int, route string, n int").repartition(5)
    got = [tuple(r) for r in filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, labels)


def test_audit_with_one_fingerprint_for_all(monkeypatch):
    rows, _ = audit_rows(77, 300)
    entries = [e for part in (rows[:100], rows[100:]) for e in filter_audit.settle([(d, s or "", 0, 5, t or "") for d, t, s in part])]
    got = Counter()
    for doc, part, mask, n in filter_audit.resolve(sorted(entries, key=lambda e: e[0])):
        got[doc, part, mask] += n
    first = defaultdict(lambda: 99)
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first[t or ""], d)
    assert got == Counter((d, s or "", filter_audit.COPY if d is not None and d > first[t or ""] else 0) for d, t, s in rows)


def test_audit_of_other_ids_and_empty_tables(spark):
    labels = spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int")
    d = spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), ("c", "y " * 300_000, "s")], "doc_id string, text string, source string")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(d, labels).collect()}
    assert (got["EABCD", 1]["removed"], got["EABCD", 1]["good_lost"], got["BACDE", 1]["removed"], got["EABCD", 1]["shapley"]) == (1, 1, 1, 60)
    assert filter_audit.audit(d.limit(0), labels).collect() == [] and len(filter_audit.audit(d, labels.limit(0)).collect()) == 600
