"""Standardizers on inline fixtures, the duplicate-check job and the REST source."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from lumiquery.operators import duplicate_check, standardize
from lumiquery.sources.rest import RestTable

DEEP = "Chromophore string, Solvent string, `Absorption max (nm)` string, `Emission max (nm)` string, `Lifetime (ns)` string, `Quantum yield` string, `log(e/mol-1 dm3 cm-1)` string"
FLUO = "smiles string, solvent string, `absorption/nm` string, `emission/nm` string, plqy string, `e/m-1cm-1` string, `reference(doi)` string, source string, tag string, tag_name string, solvent_num string, split string"


def frames(spark):
    deep = spark.createDataFrame([("OCC", "O", "350", "450", "nan", "0.5", "4.0"), ("bad(", "O", "1", "2", None, None, None), ("CC", "gas", None, "x", None, None, None)], DEEP)
    chem = spark.createDataFrame([("CCO", "O", "350", "450.0", "0.5"), ("c1ccccc1", "CCO", None, "610", None)], "SMILES string, solvent string, `Absorption/nm` string, `Emission/nm` string, PLQY string")
    fluo = spark.createDataFrame([("C(C)O", "bad(", "350", "455", "0.4", "10000", "10.1/x", "s", "1", "t", "2", "train")], FLUO)
    return (
        standardize.standardize(deep, standardize.LITERATURE, "literature"),
        standardize.standardize(chem, standardize.HANDBOOK, "handbook", infer=True),
        standardize.standardize(fluo, standardize.AGGREGATE, "Aggregate"),
    )


def test_standardize(spark):
    deep, chem, fluo = frames(spark)
    d = deep.collect()
    assert len(d) == 1 and (d[0]["canonical_chromophore_smiles"], d[0]["absorption_nm"], d[0]["lifetime_ns"], d[0]["log_extinction"]) == ("CCO", 350.0, None, 4.0)
    assert chem.count() == 2 and chem.first()["lifetime_ns"] is None
    f = fluo.first()
    assert (f["canonical_chromophore_smiles"], f["canonical_solvent_smiles"], f["log_extinction"], f["reference_doi"]) == ("CCO", None, 4.0, "10.1/x")
    assert deep.columns == chem.columns == fluo.columns


def test_prepare(spark):
    out = standardize.prepare(list(frames(spark)))
    assert out["combined"].count() == 4 and out["deduplicated"].count() == 4
    r = out["replicates"].collect()
    assert len(r) == 1 and r[0]["sources"] == "handbook,literature"
    assert {x["source_dataset"]: x["ge_600"] for x in out["coverage_after"].collect()}["ALL"] == 1


def test_duplicate_check(spark):
    data = spark.createDataFrame([("r7", "OCC", "O", 450.0, 0.5, "d"), ("r8", "CCN", "O", None, None, None), ("r9", "gas", "O", 1.0, None, None)], "record_id string, molecule_smiles string, solvent_smiles string, emission_nm double, quantum_yield double, source_doi string")
    job = {"job_id": "1", "molecule_smiles": "CCO", "solvent_smiles": "[OH2]"}
    got = duplicate_check.run(job, data)
    assert got["is_duplicate"] and [m["record_id"] for m in got["exact_matches"]] == ["r7"] and got["nearest"][0] == {"record_id": "r7", "molecule_smiles": "OCC", "similarity": 1.0}
    code = lambda j, d: duplicate_check.run(j, d)["error"]["code"]
    assert code({}, data) == "INVALID_INPUT" and code(job | {"molecule_smiles": "x("}, data) == "INVALID_SMILES"
    assert code(job, None) == "DATASET_NOT_CONFIGURED" and code(job, data.drop("record_id")) == "INVALID_DATASET"


def test_rest_table(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            body = json.dumps([{"id": 1, "status": "queued"}, {"id": 2}]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestTable)
    df = spark.read.format("rest_table").schema("id int, status string").options(url=f"http://127.0.0.1:{server.server_port}", table="jobs", filter="status=queued", order="created_at.asc", limit="5").load()
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "queued"), (2, None)]
    assert "status=eq.queued" in asked[0] and "limit=5" in asked[0]
    server.shutdown()
