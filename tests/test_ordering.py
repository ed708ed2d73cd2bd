"""Places over all rows of a table."""

from __future__ import annotations

from lumiquery.plans import molecules, views

DATA = "/root/testdata/sf0.001"


def test_ranked_places_every_molecule(spark):
    mol = views.mol(spark, DATA)
    rows = mol.select("molecule_id", "substituent", "similarity").collect()
    rows.sort(key=lambda r: (r["substituent"] != "PROMO", r["similarity"] is None, -(r["similarity"] or 0), r["molecule_id"]))
    want = {r["molecule_id"]: k for k, r in enumerate(rows, 1)}
    for one_task_rows in (10, 1_000_000):  # by range partitions, and by one window
        got = molecules.ranked(mol, one_task_rows).collect()
        assert len(got) == len(rows) and {r["molecule_id"]: r["place"] for r in got} == want


def test_neighbours_in_blocks(spark):
    from lumiquery.operators import neighbours

    rows = spark.range(200).selectExpr("id AS reference_id", "pmod(xxhash64(id), 65536) AS fp")
    queries = rows.filter("reference_id % 50 = 0").withColumnRenamed("reference_id", "candidate_id")
    one = neighbours.top_k(queries, rows, 4, exclude_self=True)
    many = neighbours.top_k(queries, rows, 4, exclude_self=True, block_rows=30)
    key = lambda df: sorted((r["candidate_id"], r["rank"], r["reference_id"], round(r["similarity"], 9)) for r in df.collect())
    assert key(one) == key(many) and len(key(one)) == 16


def test_quantiles_and_sums_by_key(spark):
    from pyspark.sql import functions as F

    from lumiquery.operators import ordering

    rows = [("a" if k % 3 else None, float(k * 7 % 101) if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    for most in (ordering.ONE_TASK_ROWS, 5):
        got = {r["g"]: (r["low"], r["mid"]) for r in ordering.quantiles(df, ["g"], "v", (0.1, 0.5), ("low", "mid"), most).collect()}
        want = {r["g"]: (r["a"], r["b"]) for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.1)).alias("a"), F.percentile("v", F.lit(0.5)).alias("b")).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for g in want for x, y in zip(got[g], want[g], strict=True))


def task_memory(spark, after):
    """MB of execution memory of the largest task of the stages above a number, and the last stage's number."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [s for s in (stages.apply(k) for k in range(stages.size())) if s.stageId() > after]
    tasks = [t for s in stages for ts in [store.taskList(s.stageId(), s.attemptId(), 1_000)] for t in (ts.apply(k) for k in range(ts.size()))]
    return max((t.taskMetrics().get().peakExecutionMemory() for t in tasks if t.taskMetrics().isDefined()), default=0) / 1e6, max((s.stageId() for s in stages), default=after)


def test_neighbours_of_many_rows_sort_no_pairs(spark):
    from pyspark.sql import functions as F

    from lumiquery.operators import neighbours

    rows = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("reference_id"), F.xxhash64("id").alias("fp"))
    queries = rows.filter("reference_id % 150 = 0").withColumnRenamed("reference_id", "candidate_id")
    _, before = task_memory(spark, -1)
    got = sorted((r["candidate_id"], r["rank"], r["reference_id"], r["similarity"]) for r in neighbours.top_k(queries, rows, 2, exclude_self=True).collect())
    assert task_memory(spark, before)[0] < 200
    bits = {r["reference_id"]: r["fp"] % 2**64 for r in rows.collect()}
    for c in (0, 150, 29_850):
        want = sorted((-((bits[c] & f).bit_count() / (bits[c] | f).bit_count()), i) for i, f in bits.items() if i != c)[:2]
        assert [x[1:] for x in got if x[0] == c] == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_neighbours_of_odd_rows(spark):
    from lumiquery.operators import neighbours

    refs = spark.createDataFrame([(1, 0), (2, None), (3, -1), (4, 3), (4, 1), (5, -(2**63))], "reference_id long, fp long")
    queries = spark.createDataFrame([(4, 3), (7, None), (5, -(2**63)), (3, -1)], "candidate_id long, fp long")
    found = lambda **o: sorted((r["candidate_id"], r["rank"], r["reference_id"], round(r["similarity"], 9)) for r in neighbours.top_k(queries, refs, 2, **o).collect())
    assert found(exclude_self=True) == [(3, 1, 4, 0.03125), (3, 2, 4, 0.015625), (4, 1, 3, 0.03125), (4, 2, 1, 0.0), (5, 1, 3, 0.015625), (5, 2, 1, 0.0), (7, 1, 1, 0.0), (7, 2, 2, 0.0)]
    assert found()[:4] == [(3, 1, 3, 1.0), (3, 2, 4, 0.03125), (4, 1, 4, 1.0), (4, 2, 4, 0.5)]
    assert neighbours.top_k(queries, refs.limit(0), 2).collect() == neighbours.top_k(queries.limit(0), refs, 2).collect() == []
