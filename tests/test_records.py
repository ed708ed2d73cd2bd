"""Delimited records over many ranges of a file, against Python's csv."""

from __future__ import annotations

import csv
import io
import random

import pytest

from lumiquery.sources import readers, records


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rnd):
    kind = rnd.random()
    if kind < 0.3:
        return "".join(rnd.choice(['"', ",", "\n", "\r\n", "x", " "]) for _ in range(rnd.randint(0, 12)))
    if kind < 0.32:
        return "line\n" * 400  # longer than a range
    return rnd.choice(["", "a", "7.5", "café", "many words in a row"])


def body(text):
    """Rows as csv reads them, without the header and blank lines; empty cells are null."""
    rows = [row for row in csv.reader(io.StringIO(text, newline="")) if row][1:]
    return sorted((tuple(c or None for c in row) for row in rows), key=str)


def write(path, rows, **options):
    out = io.StringIO(newline="")
    csv.writer(out, **options).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return out.getvalue()


@pytest.mark.parametrize("options", [{}, {"lineterminator": "\n"}, {"quoting": csv.QUOTE_ALL}])
def test_quoted_line_breaks_in_many_ranges(spark, tmp_path, small_ranges, options):
    rnd = random.Random(7)
    rows = [["id", "b", "c"], *([str(k), cell(rnd), cell(rnd)] for k in range(300)), ["id", "b", "c"]]  # a data row that equals the header
    text = write(tmp_path / "a.csv", rows, **options)
    lines = records.lines_of(spark, str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() >= 4
    parted = records.begins_inside(records.range_functions(lines, ","))
    assert parted  # ranges do begin within fields
    got = readers.read_csv_ragged(spark, str(tmp_path / "a.csv"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == body(text)
    found = {r["id"]: (r["b"] or "", r["c"] or "") for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect() if r["id"] != "id"}
    assert found == {r[0]: (r[1], r[2]) for r in rows[1:-1]}


def test_ragged_rows_in_any_batches(spark, tmp_path, small_ranges):
    text = 'a,b,notes\r\n1,2,x\r\n3,4,one, two\r\n5\r\n\r\na,b,notes\r\n6,"q ""r""\r\ns",t,u\r\n7,5" pipe,"v"w\r\n'
    (tmp_path / "r.csv").write_text(text, newline="")
    want = [("1", "2", "x"), ("3", "4", "one, two"), ("5", None, None), ("a", "b", "notes"), ("6", 'q "r"\r\ns', "t,u"), ("7", '5" pipe', "vw")]
    got = None
    for batch in ("1", "2", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted((tuple(r) for r in readers.read_csv_ragged(spark, str(tmp_path / "r.csv")).collect()), key=str)
        assert got == sorted(want, key=str)


def test_open_quote_at_the_end_and_folders(spark, tmp_path, small_ranges):
    folder = tmp_path / "f"
    folder.mkdir()
    write(folder / "a.csv", [["x", "y"], *[[str(k), "a\nb" * (k % 9)] for k in range(200)]])
    write(folder / "b.csv", [["x", "y"], *[[str(k), "c,\n" * (k % 5)] for k in range(200, 300)]])
    assert sorted(int(r["x"]) for r in readers.read_csv(spark, str(folder)).collect()) == list(range(300))
    (tmp_path / "o.csv").write_text('x,y\n1,2\n3,"open\nuntil the end\n' + "z\n" * 900)
    rows = [tuple(r) for r in readers.read_csv_ragged(spark, str(tmp_path / "o.csv")).collect()]
    assert len(rows) == 2 and ("3", "open\nuntil the end\n" + "z\n" * 899 + "z") in [(a, b.rstrip("\n")) for a, b in rows]


@pytest.mark.parametrize(("late", "name"), [("Müller".encode("latin1"), "cp1252"), (b"M\x81ller", "latin1"), ("Müller €".encode("cp1252"), "cp1252"), ("Müller".encode(), "utf-8")])
def test_encoding_of_late_bytes(spark, tmp_path, late, name):
    path = tmp_path / "e.csv"
    path.write_bytes(b"k,v\n" + b"".join(b"%d,plain\n" % k for k in range(200_000)) + b"x," + late + b"\n")
    assert records.encoding_of(records.lines_of(spark, str(path))) == name
    assert readers.read_csv(spark, str(path)).filter("k = 'x'").first()["v"] == late.decode(name)


def test_states_of_lines():
    sep = b","
    assert [records.after_line(x, False, sep) for x in (b"a,b", b'"a', b'a,"b', b'"a",b', b'a"b', b'"a""', b'"a"",', b'"a"b"', b'""', b'"",""', b'"', b',"')] == [False, True, True, False, False, True, True, False, False, False, True, True]
    assert [records.after_line(x, True, sep) for x in (b"a,b", b'a"', b'a","b', b'a""', b'"', b'""')] == [True, False, True, True, False, True]
    rnd = random.Random(1)
    for _ in range(3_000):
        lines = ["".join(rnd.choice(['"', ",", "a"]) for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(1, 4))]
        inside, count = False, 0
        for line in lines:
            inside = records.after_line(line.encode(), inside, sep)
            count += not inside
        # csv has no row for an empty last line
        want = len(list(csv.reader(io.StringIO("\n".join(lines), newline=""))))
        assert count + inside - (lines[-1] == "" and not inside) == want
