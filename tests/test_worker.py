"""The polling worker, its streams, and the REST table."""

from __future__ import annotations

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from lumiquery.sources.rest import RestTable
from lumiquery.streaming import worker


def queue(spark):
    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(k, "queued" if k % 2 else "running", t - timedelta(minutes=k)) for k in range(12)], "id long, status string, created_at timestamp")


def test_work_polls_in_order_and_stops(spark):
    taken, slept = [], []
    done = worker.work(lambda: queue(spark), lambda jobs: taken.append([r["id"] for r in jobs.collect()]) or 3, lambda: 0, limit=3, max_loops=2, sleep=slept.append)
    assert taken == [[11, 9, 7]] * 2 and done["submitted"] == 6 and slept == [30.0]
    assert worker.work(lambda: queue(spark), None, None, limit=5, max_loops=1, dry_run=True, sleep=slept.append)["planned"] == 5
    done = worker.work(lambda: queue(spark), lambda j: 1, lambda: 0, busy=lambda: True, max_loops=1, sleep=slept.append)
    assert (done["skipped"], done["submitted"]) == (1, 0)
    left = [2, 0, 0, 0]
    done = worker.work(None, None, lambda: left.pop(0), mode="collect", idle_exit=2, sleep=slept.append)
    assert (done["loops"], done["collected"]) == (3, 2)

    def broken():
        raise OSError("no answer")

    assert worker.work(broken, lambda j: 1, lambda: 0, mode="submit", max_loops=3, sleep=slept.append)["errors"] == 3
    with pytest.raises(ValueError, match="mode"):
        worker.work(None, None, None, mode="other")


def test_outputs_are_collected_once(spark, tmp_path):
    def put(k, text):
        (tmp_path / f"in/prediction_{k}").mkdir(parents=True)
        (tmp_path / f"in/prediction_{k}/output.json").write_text(text)

    seen = []
    sink = lambda batch, _: seen.extend((r["job_id"], r["status"]) for r in batch.collect())
    put(1, '{"job_id": "a",\n "status": "success", "predictions": [{"model_name": "rf"}]}')
    put(2, "{broken")
    collect = lambda: worker.collect_outputs(spark, str(tmp_path / "in"), sink, str(tmp_path / "cp"))
    assert collect() == 1 and collect() == 0
    put(3, '{"job_id": "c", "status": "failed", "error_code": "INVALID_INPUT"}')
    assert collect() == 1 and seen == [("a", "success"), ("c", "failed")]


def test_states_move_forward_by_job(spark, tmp_path):
    t = datetime(2025, 1, 1)
    schema = "id string, status string, updated_at timestamp"
    batches = [[("a", "queued", t), ("b", "queued", t), ("a", "running", t)], [("a", "queued", t - timedelta(hours=1)), ("b", "running", t + timedelta(hours=1)), ("c", "odd", t)], [("b", "completed", t + timedelta(hours=2)), ("b", "completed", t + timedelta(hours=2))]]
    found = {}

    def keep(batch, _):
        found.update({r["id"]: (r["status"], r["n_updates"]) for r in batch.collect()})

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = worker.track_states(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert found == {"a": ("running", 3), "b": ("completed", 4)}


def test_only_one_worker(spark, tmp_path):
    with worker.Lock(spark, str(tmp_path / "lock")):
        with pytest.raises(RuntimeError), worker.Lock(spark, str(tmp_path / "lock")):
            pass
    with worker.Lock(spark, str(tmp_path / "lock")):
        pass


@pytest.fixture
def server():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            rows = [{"id": k, "name": f"n{k}"} for k in range(10)][int(q.get("offset", 0)) :][: int(q.get("limit", 100))]
            self.answer(200, json.dumps(rows).encode())

        def take(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            refused = any("note" in r for r in (body if isinstance(body, list) else [body]))
            if not refused:
                got.append((self.command, urlparse(self.path).query, body))
            self.answer(400 if refused else 201, b"")

        do_POST = do_PATCH = take

        def answer(self, code, body):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", got
    http.shutdown()


def test_rest_pages_inserts_and_patches(spark, server):
    url, got = server
    spark.dataSource.register(RestTable)
    df = spark.read.format("rest_table").schema("id long, name string").options(url=url, table="t", rows="10", page="4").load()
    assert df.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in df.collect()) == list(range(10))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, status string, note string").coalesce(1)
    rows.write.format("rest_table").options(url=url, table="t", optional="note").mode("append").save()
    assert got == [("POST", "", [{"id": 1, "status": "a"}, {"id": 2, "status": "b"}])]
    rows.drop("note").write.format("rest_table").options(url=url, table="t", id="id").mode("append").save()
    assert got[1:] == [("PATCH", "id=eq.1", {"status": "a"}), ("PATCH", "id=eq.2", {"status": "b"})]
