"""The queue as a stream, the sink that adds each key once, expiring states, leases and filtered upserts."""

from __future__ import annotations

import json
import re
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lumiquery.sources.rest import RestReader, RestStreamReader, RestTable
from lumiquery.streaming import jobs, lifecycle, worker

COLUMNS = "id string, created_at string, status string"


def stamp(k):
    return f"2025-01-01T00:{k // 60:02d}:{k % 60:02d}+00:00"


class Endpoint:
    """Tables behind HTTP with the filters that the sources send."""

    def __init__(self):
        self.tables, self.asked, self.before = {}, [], []

    def rows(self, table, query):
        found = self.tables.setdefault(table, [])
        for name, value in query.items():
            if name in ("select", "order", "limit", "offset"):
                continue
            if name == "and":
                for time, op, at, key, last, own in re.findall(r'or\((\w+)\.(\w+)\."([^"]*)",and\(\w+\.eq\."[^"]*",(\w+)\.(\w+)\."([^"]*)"\)\)', value):
                    test = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
                    found = [r for r in found if test[op](r[time], at) or (r[time] == at and test[last](r[key], own))]
            elif value.startswith("in."):
                wanted = json.loads(f"[{value[4:-1]}]")
                found = [r for r in found if str(r[name]) in wanted]
            else:
                found = [r for r in found if f"eq.{r[name]}" == value]
        if "order" in query:
            found = sorted(found, key=lambda r: [r[c.split(".")[0]] for c in query["order"].split(",")])
        return found[int(query.get("offset", 0)) :][: int(query.get("limit", 10**9))]


@pytest.fixture
def endpoint():
    own = Endpoint()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            if own.before:
                own.before.pop(0)()
            found = own.rows(url.path.strip("/"), query)
            own.asked.append((url.path.strip("/"), query, len(found)))
            self.answer(200, json.dumps(found).encode())

        def do_POST(self):
            own.tables.setdefault(urlparse(self.path).path.strip("/"), []).extend(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer(201, b"")

        def answer(self, code, body):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    own.url = f"http://127.0.0.1:{http.server_port}"
    yield own
    http.shutdown()


def job(k, at=None):
    return {"id": f"j{k:04d}", "created_at": stamp(k if at is None else at), "status": "queued"}


def drain(spark, endpoint, cp, sink, **options):
    spark.dataSource.register(RestTable)
    df = spark.readStream.format("rest_table").schema(COLUMNS).options(url=endpoint.url, table="queue", **options).load()
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", cp).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()


def test_queue_as_a_stream(spark, endpoint, tmp_path):
    batches = []
    sink = lambda b, k: batches.append((k, sorted(r["id"] for r in b.collect())))
    # many rows of one time: the id goes on where the time is the same
    endpoint.tables["queue"] = [job(k, k // 7) for k in range(43)]
    endpoint.before = [lambda: None] * 3 + [lambda: endpoint.tables["queue"].extend([job(100), job(101)])]
    drain(spark, endpoint, str(tmp_path / "cp"), sink, page="5", admit="20")
    got = [i for _, b in batches for i in b]
    assert sorted(got) == sorted(r["id"] for r in endpoint.tables["queue"]) and max(len(b) for _, b in batches) <= 20
    assert all(n <= 5 for table, _, n in endpoint.asked)
    # a restart goes on behind the last key
    n = len(batches)
    endpoint.tables["queue"] += [job(k) for k in range(200, 231)]
    drain(spark, endpoint, str(tmp_path / "cp"), sink, page="5", admit="20")
    assert sorted(i for _, b in batches[n:] for i in b) == [f"j{k:04d}" for k in range(200, 231)] and max(len(b) for _, b in batches) <= 20


def test_batch_that_failed_is_read_again_with_its_bounds(spark, endpoint, tmp_path):
    endpoint.tables["queue"] = [job(k) for k in range(12)]
    seen = []

    def broken(b, k):
        seen.append(sorted(r["id"] for r in b.collect()))
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(spark, endpoint, str(tmp_path / "cp"), broken, page="4", admit="10")
    endpoint.tables["queue"] += [job(k) for k in range(50, 55)]
    again = []
    drain(spark, endpoint, str(tmp_path / "cp"), lambda b, k: again.append(sorted(r["id"] for r in b.collect())), page="4", admit="10")
    assert again[0] == seen[0] and sorted(i for b in again for i in b) == [r["id"] for r in endpoint.tables["queue"]]


def test_rows_that_appear_between_plan_and_read(endpoint):
    from pyspark.sql.types import StringType, StructField, StructType

    endpoint.tables["queue"] = [job(k) for k in range(0, 20, 2)]
    schema = StructType([StructField(c, StringType()) for c in ("id", "created_at", "status")])
    reader = RestStreamReader(schema, {"url": endpoint.url, "table": "queue", "page": "3"})
    start = reader.initialOffset()
    end = reader.latestOffset()
    endpoint.tables["queue"] += [job(k) for k in (5, 7, 30)]  # two within the batch's bounds, one behind them
    parts = reader.partitions(start, end)
    first = [r[0] for p in parts for r in reader.read(p)]
    after = reader.latestOffset()
    second = [r[0] for p in reader.partitions(end, after) for r in reader.read(p)]
    assert len(parts) == 4 and first == sorted(set(first)) and sorted(first + second) == sorted(r["id"] for r in endpoint.tables["queue"])
    assert reader.latestOffset() == after and reader.partitions(after, after) == []


def test_pages_until_one_is_short(spark, endpoint):
    endpoint.tables["t"] = [job(k) for k in range(11)]
    spark.dataSource.register(RestTable)
    read = lambda **o: sorted(r["id"] for r in spark.read.format("rest_table").schema(COLUMNS).options(url=endpoint.url, table="t", order="id.asc", **o).load().collect())
    every = [r["id"] for r in endpoint.tables["t"]]
    assert read(page="4") == read(page="4", rows="5") == read(page="4", rows="8") == read(page="4", rows="40") == read() == every
    assert read(page="4", limit="6") == every[:6] == read(page="4", rows="11", limit="6")
    assert len(RestReader(spark.createDataFrame([], COLUMNS).schema, {"page": "4", "rows": "9"}).partitions()) == 3


def test_sink_adds_each_key_once(spark, endpoint, tmp_path):
    spark.dataSource.register(RestTable)
    schema = "id string, value int"

    def put(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run(cp):
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = stream.writeStream.format("rest_table").options(url=endpoint.url, table="out", id="id", log="epochs", query="q1", batch="7").option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        q.awaitTermination()

    put(0, [(f"a{k}", k) for k in range(20)] + [("a1", 1)])
    run("cp")
    assert sorted(r["id"] for r in endpoint.tables["out"]) == sorted(f"a{k}" for k in range(20)) and endpoint.tables["epochs"] == [{"query": "q1", "epoch": 0}]
    # the same epoch again, as after a loss before the stream's own commit: nothing is sent
    run("cp2")
    assert len(endpoint.tables["out"]) == 20 and len(endpoint.tables["epochs"]) == 1
    # an epoch that ended after some requests: its rows are there, its mark isn't
    endpoint.tables["epochs"].clear()
    endpoint.tables["out"] = endpoint.tables["out"][:7]
    run("cp3")
    assert sorted(r["id"] for r in endpoint.tables["out"]) == sorted(f"a{k}" for k in range(20))
    # keys that are asked for follow the batch, not the table
    endpoint.tables["out"] += [{"id": f"old{k}", "value": 0} for k in range(500)]
    endpoint.asked.clear()
    put(1, [("a3", 3), ('odd "key", (x)', 5)])
    run("cp")
    assert len(endpoint.tables["out"]) == 521 and sum(n for t, _, n in endpoint.asked if t == "out") <= 2


def test_states_expire(spark, tmp_path):
    spark.conf.set(*lifecycle.STORE)
    t = datetime(2025, 1, 1)
    schema, found, sizes = "id string, status string, updated_at timestamp", [], []
    hour = timedelta(hours=1)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = lifecycle.expiring_states(spark.readStream.schema(schema).json(str(tmp_path / "in")), run_limit=3 * hour, keep=hour, late="0 seconds")
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: found.extend((r["id"], r["status"], r["n_updates"], tuple(r["path"]), r["error_code"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    try:
        run([("a", "queued", t), ("b", "queued", t), ("a", "running", t), ("x", "odd", t), (None, "queued", t)])
        assert sorted(found) == [("a", "running", 2, ("queued", "running"), None), ("b", "queued", 1, ("queued",), None)]
        found.clear()
        # a goes on running, b ends; an update that is as late but less far changes nothing
        run([("a", "running", t + hour), ("b", "running", t + hour), ("b", "completed", t + hour), ("b", "queued", t + hour)])
        assert ("b", "completed", 4, ("queued", "running", "completed"), None) in found
        found.clear()
        # time goes on: a has run for three hours since it began, b's state leaves
        run([("c", "queued", t + 4 * hour)])
        assert ("a", "failed", 3, ("queued", "running", "failed"), "TIMED_OUT") in found and not any(r[0] == "b" for r in found)
        found.clear()
        run([("d", "failed", t + 9 * hour)])
        run([("d", "completed", t + 9 * hour + hour / 2), ("e", "queued", t + 20 * hour)])
        assert [r[:2] for r in found if r[0] == "d"] == [("d", "failed"), ("d", "failed")]
        run([("f", "queued", t + 40 * hour)])
        run([("g", "completed", t + 60 * hour), ("h", "completed", t + 80 * hour)])
        run([("i", "completed", t + 99 * hour)])
        run([("k", "completed", t + 120 * hour)])
        assert sizes[-1] <= sizes[-2] <= sizes[-3] + 6  # open jobs c, e, f and the last that ended
    finally:
        spark.conf.unset(lifecycle.STORE[0])


def test_leases(spark, tmp_path):
    now, path = [1_000.0], str(tmp_path / "lock")
    clock = lambda: now[0]
    lost = worker.Lock(spark, path, 60, clock).__enter__()  # its worker is killed
    with pytest.raises(RuntimeError), worker.Lock(spark, path, 60, clock):
        pass
    now[0] += 30
    lost.renew()
    now[0] += 50
    with pytest.raises(RuntimeError), worker.Lock(spark, path, 60, clock):
        pass
    now[0] += 20
    with worker.Lock(spark, path, 60, clock) as own:
        assert own.holder()["owner"] == own.owner
        with pytest.raises(RuntimeError):
            lost.renew()
        lost.__exit__()  # doesn't take the other's lock away
        assert own.holder()["owner"] == own.owner
    assert worker.Lock(spark, path).holder() is None


def test_upserts_open_few_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    batch = lambda low, high: spark.range(low, high).select("id", (F.col("id") % 5).alias("v"))
    for k in range(6):
        jobs.upsert(spark, batch(1_000 * k, 1_000 * (k + 1)), path, k)
    fresh = batch(100_000, 100_010).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(jobs.BUCKETS)).cast("int"))
    opened = jobs.opened_keys(spark, fresh, path, 6)
    assert (0 if opened is None else opened.count()) <= 200  # of 6,000: what the filters mistake
    mixed = batch(2_990, 3_010).unionByName(batch(50_000, 50_005))
    jobs.upsert(spark, mixed, path, 7)
    jobs.upsert(spark, mixed, path, 7)
    rows = spark.read.parquet(path)
    assert rows.count() == rows.select("id").distinct().count() == 6_005
    jobs.upsert(spark, batch(0, 10), path, 8)
    assert spark.read.parquet(path).count() == 6_005
