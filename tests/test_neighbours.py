"""Exact neighbours over sets of 2,048 bits against all pairs."""

from __future__ import annotations

import random

import duckdb
import pytest

from lumiquery.operators import neighbours
from lumiquery.plans import registry


def tanimoto(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute(candidates, references, k, exclude_self=False):
    out = []
    for c, x in candidates.items():
        near = sorted((-tanimoto(x, y), r) for r, y in references.items() if not (exclude_self and r == c))[:k]
        out += [(c, r, round(-s, 9), n) for n, (s, r) in enumerate(near, 1)]
    return sorted(out)


def families(seed, n, hot=12):
    """Sets like fingerprints: a family's core with changes, and some bits that most sets have."""
    rnd, out = random.Random(seed), {}
    cores = [rnd.sample(range(hot, 2048), 45) for _ in range(n // 12)]
    for i in range(n):
        own = set(rnd.choice(cores))
        for _ in range(rnd.randint(0, 12)):
            own.discard(rnd.choice(sorted(own)))
            own.add(rnd.randrange(hot, 2048))
        out[i] = own | {b for b in range(hot) if rnd.random() < 0.8}
    return out


def frame(spark, name, sets):
    return spark.createDataFrame([(i, sorted(s) if s is not None else None) for i, s in sets.items()], f"{name} long, bits array<int>")


def found(df):
    return sorted((r[0], r[1], round(r[2], 9), r[3]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5])
def test_families(spark, k):
    refs = families(3, 4_000)
    asked = {i: refs[i] for i in range(0, 4_000, 50)}
    q, r = frame(spark, "candidate_id", asked), frame(spark, "reference_id", refs)
    assert found(neighbours.top_k_sets(q, r, k, exclude_self=True)) == brute(asked, refs, k, True)
    compared = neighbours.compared_pairs(q.withColumnRenamed("candidate_id", "_q"), r.withColumnRenamed("reference_id", "_r"), k, True)
    assert compared.count() < 0.05 * len(asked) * len(refs)


@pytest.mark.parametrize("hot_share", [0.0, 0.05, 0.5, 1.0])
def test_odd_sets_and_ties(spark, hot_share):
    rnd = random.Random(8)
    refs = {i: {b for b in range(30) if rnd.random() < rnd.choice([0.05, 0.3, 0.9])} for i in range(120)}
    refs |= {200: set(), 201: set(), 202: {1}, 203: {1}, 204: {1, 2}, 205: set(range(30))}
    asked = {i: s for i, s in refs.items() if i % 4 == 0} | {300: {5_000}, 301: set(), 302: {1}, 303: None}
    want = brute({i: s or set() for i, s in asked.items()}, refs, 4, True)
    q, r = frame(spark, "candidate_id", asked), frame(spark, "reference_id", refs)
    assert found(neighbours.top_k_sets(q, r, 4, exclude_self=True, hot_share=hot_share)) == want
    # candidates that share no bit with any reference are kept, with similarity 0
    assert [x[1:] for x in want if x[0] == 300] == [(i, 0.0, i + 1) for i in range(4)]


def test_few_and_no_references(spark):
    refs = {1: {1, 2}, 2: {3}}
    q, r = frame(spark, "candidate_id", {7: {1}, 8: {9}}), frame(spark, "reference_id", refs)
    assert found(neighbours.top_k_sets(q, r, 5)) == brute({7: {1}, 8: {9}}, refs, 5)
    assert neighbours.top_k_sets(q, r.limit(0), 5).collect() == [] and neighbours.top_k_sets(q.limit(0), r, 5).collect() == []
    no_id = spark.createDataFrame([(None, [1]), (4, [1])], "candidate_id long, bits array<int>")
    assert found(neighbours.top_k_sets(no_id, r, 1)) == [(4, 1, 0.5, 1)]


def test_dissimilar_sets_leave_few_pairs(spark):
    rnd = random.Random(5)
    refs = {i: set(rnd.sample(range(2048), rnd.randint(30, 90))) | {b for b in range(9) if rnd.random() < 0.6} for i in range(2_500)}
    asked = {i: refs[i] for i in range(0, 2_500, 50)}
    q, r = frame(spark, "candidate_id", asked), frame(spark, "reference_id", refs)
    assert found(neighbours.top_k_sets(q, r, 5, exclude_self=True)) == brute(asked, refs, 5, True)
    pairs = neighbours.compared_pairs(q.withColumnRenamed("candidate_id", "_q"), r.withColumnRenamed("reference_id", "_r"), 5, True)
    assert pairs.count() <= 0.02 * len(asked) * len(refs)


def test_sets_in_many_cells(spark, monkeypatch):
    refs = families(4, 600)
    asked = {i: refs[i] for i in range(0, 600, 20)}
    monkeypatch.setattr(neighbours, "BLOCK_BITS", 400)
    monkeypatch.setattr(neighbours, "SCORES", 50)
    named = lambda df, c: df.selectExpr(f"concat('m', {c}) AS {c}", "bits")
    got = found(neighbours.top_k_sets(named(frame(spark, "candidate_id", asked), "candidate_id"), named(frame(spark, "reference_id", refs), "reference_id"), 3, exclude_self=True))
    assert got == brute({f"m{i}": s for i, s in asked.items()}, {f"m{i}": s for i, s in refs.items()}, 3, True)


def test_every_turn_is_a_candidate(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(c, t, " ".join(rnd.choices("abcdefghijkl", k=rnd.randint(0, 9)))) for c in range(40, 61) for t in range(rnd.randint(1, 4))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in registry.queries()["knn_sets_payload"](spark, str(tmp_path)).collect())
    assert [r[0] for r in got] == sorted(c * 1000 + t for c, t, _ in rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["knn_sets_payload"]).fetchall())


def test_sets_among_themselves(spark, monkeypatch):
    sets = families(9, 300) | {400: set(), 401: set(), 402: {7}}
    monkeypatch.setattr(neighbours, "BLOCK_BITS", 4_000)
    monkeypatch.setattr(neighbours, "GROUP", 3)
    assert found(neighbours.top_k_sets(frame(spark, "candidate_id", sets), None, 4, exclude_self=True)) == brute(sets, sets, 4, True)
