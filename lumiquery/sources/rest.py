"""A table behind a REST endpoint as a Spark data source.

Reading: select, equality filter, order and limit go into the request; with ``page`` the
table is read in pages until one is short, with ``rows`` also in several partitions.
Writing: rows are inserted, or patched by id, in batches; a refused batch is sent again
without the optional columns.

Streaming: a table is a queue in the order of (``created_at``, ``id``). A batch's end is
the key of the last of at most ``admit`` rows, found by keyset pages; its rows are those
between two keys, so rows that appear while pages are read belong to this batch or to a
later one, and a batch that is read again has the same bounds. The stream sink inserts by a
key: a task asks which of its keys are there, inserts the others, and the
epoch's end is marked in a commit log, so a task or an epoch that is repeated adds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class RestTable(DataSource):
    """``spark.read.format("rest_table").schema(...).options(url=, table=, filter=, order=, limit=, key=)``."""

    @classmethod
    def name(cls) -> str:
        """Name of the format."""
        return "rest_table"

    def schema(self) -> str:
        """A schema is required: rows are taken by its columns."""
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        """One request a page, one partition each."""
        return RestReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        """Inserts, or patches by ``id``."""
        return RestWriter(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        """The rows by (``created_at``, ``id``) as they come."""
        return RestStreamReader(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        """Inserts by ``id``, each once."""
        return RestStreamWriter(schema, dict(self.options))


def fetch(options: dict[str, str], query: list[tuple[str, object]]) -> list[dict]:
    """The rows that a request gives."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {options['key']}"} if options.get("key") else {})
    with urlopen(Request(f"{options['url'].rstrip('/')}/{options['table']}?{urlencode(query)}", headers=headers), timeout=30) as answer:  # noqa: S310
        return json.loads(answer.read())


def quoted(value: str) -> str:
    """A value within a compound filter."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def equality(options: dict[str, str]) -> list[tuple[str, object]]:
    """The filter of the options as a part of a request."""
    column, _, value = (options.get("filter") or "").partition("=")
    return [(column, f"eq.{value}")] if column else []


class RestReader(DataSourceReader):
    """Reads the rows of one request, or of pages."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        """First and end row of each part; the last has no end, so rows beyond ``rows`` are read too."""
        o = self.options
        if not o.get("page"):
            return [InputPartition(None)]
        starts = list(range(0, int(o.get("rows") or 1), int(o["page"])))
        return [InputPartition((low, high)) for low, high in zip(starts, [*starts[1:], None], strict=True)]

    def request(self, first: int | None, most: int | None) -> list[tuple[str, object]]:
        """What is asked for."""
        o = self.options
        query = [("select", ",".join(self.columns)), *equality(o)]
        query += [("order", o["order"])] if o.get("order") else []
        if first is None:
            return query + ([("limit", o["limit"])] if o.get("limit") else [])
        return [*query, ("limit", most), ("offset", first)]

    def read(self, partition: object) -> Iterator[tuple]:
        """Rows in the order of the schema."""
        part = getattr(partition, "value", None)
        if part is None:
            for row in fetch(self.options, self.request(None, None)):
                yield tuple(row.get(c) for c in self.columns)
            return
        first, end = part
        # a limit holds for the whole table
        end = min((x for x in (end, int(self.options["limit"]) if self.options.get("limit") else None) if x is not None), default=None)
        while end is None or first < end:
            most = int(self.options["page"]) if end is None else min(int(self.options["page"]), end - first)
            rows = fetch(self.options, self.request(first, most))
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)
            if len(rows) < most:
                return
            first += most


class RestStreamReader(DataSourceStreamReader):
    """Rows between two keys (``created_at``, ``id``)."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.options = [f.name for f in schema.fields], options
        self.page, self.admit = int(options.get("page", 500)), int(options.get("admit", 10_000))
        self.order = (options.get("time", "created_at"), options.get("id", "id"))
        self.at: dict | None = None
        self.ends: list[dict] = []  # where the pages of the batch that comes next end

    def initialOffset(self) -> dict:
        """Before the first row."""
        self.at = {"time": "", "id": ""}
        return self.at

    def rows(self, columns: list[str], start: dict, end: dict | None, most: int) -> list[dict]:
        """The next rows after a key, in order, up to another key."""
        time, key = self.order
        query = [("select", ",".join(columns)), *equality(self.options), ("order", f"{time}.asc,{key}.asc"), ("limit", most)]
        beyond = lambda at, op, last: f"or({time}.{op}.{quoted(at['time'])},and({time}.eq.{quoted(at['time'])},{key}.{last}.{quoted(at['id'])}))"
        bounds = ([beyond(start, "gt", "gt")] if start["time"] else []) + ([beyond(end, "lt", "lte")] if end else [])
        return fetch(self.options, [*query, ("and", f"({','.join(bounds)})")] if bounds else query)

    def key(self, row: dict) -> dict:
        """A row's place in the queue."""
        return {"time": str(row[self.order[0]]), "id": str(row[self.order[1]])}

    def latestOffset(self) -> dict:
        """Key of the last row that is admitted; only keys are read here."""
        at, left = self.at or self.initialOffset(), self.admit
        self.ends = []
        while left > 0:
            rows = self.rows(list(dict.fromkeys(self.order)), at, None, min(self.page, left))
            if rows:
                at = self.key(rows[-1])
                self.ends.append(at)
            if len(rows) < min(self.page, left):
                break
            left -= len(rows)
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One for each page; of a batch that is planned again, one for all. A restart calls this with the last key twice."""
        ends = self.ends if self.at == start and self.ends and self.ends[-1] == end else [end]
        self.at, self.ends = end, []
        if start == end:
            return []
        return [InputPartition((low, high)) for low, high in zip([start, *ends[:-1]], ends, strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows of a range of keys, in pages until one is short."""
        at, end = partition.value
        columns = list(dict.fromkeys([*self.columns, *self.order]))
        while True:
            rows = self.rows(columns, at, end, self.page)
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)
            if len(rows) < self.page:
                return
            at = self.key(rows[-1])


class RestWriter(DataSourceWriter):
    """Sends the rows of a partition in batches."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.options = [f.name for f in schema.fields], options

    def _send(self, method: str, query: str, rows: object, table: str | None = None) -> None:
        o = self.options
        headers = {"Content-Type": "application/json", "Prefer": "return=minimal"} | ({"Authorization": f"Bearer {o['key']}"} if o.get("key") else {})
        body = json.dumps(rows, default=str, allow_nan=False).encode()
        urlopen(Request(f"{o['url'].rstrip('/')}/{table or o['table']}{query}", data=body, headers=headers, method=method), timeout=30).close()  # noqa: S310

    def _try(self, method: str, query: str, rows: list[dict]) -> None:
        optional = [c for c in (self.options.get("optional") or "").split(",") if c]
        shape = (lambda rs: rs[0]) if method == "PATCH" else (lambda rs: rs)
        try:
            self._send(method, query, shape(rows))
        except HTTPError:
            if not optional:
                raise
            self._send(method, query, shape([{k: v for k, v in r.items() if k not in optional} for r in rows]))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Insert in batches, or patch row by row."""
        key, size = self.options.get("id"), int(self.options.get("batch", 100))
        batch: list[dict] = []
        for row in iterator:
            r = row.asDict(recursive=True)
            if key:
                self._try("PATCH", f"?{key}=eq.{quote(str(r.pop(key)))}", [r])
                continue
            batch.append(r)
            if len(batch) >= size:
                self._try("POST", "", batch)
                batch = []
        if batch:
            self._try("POST", "", batch)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """Nothing is left to do: each request is final. Patches can be repeated; inserts need a key that the table checks."""

    def abort(self, messages: list) -> None:
        """Rows that were sent stay."""


class RestStreamWriter(RestWriter, DataSourceStreamWriter):
    """Inserts each key once, however often a task or an epoch is repeated.

    ``id`` names the key column, ``log`` a table of the same endpoint with the columns
    ``query`` and ``epoch``: an epoch that is marked there adds nothing. Of one that
    isn't, only keys that the table doesn't have are inserted, however its rows are dealt
    this time. A request holds at most ``batch`` keys, so what is asked for grows with the
    rows of an epoch, never with those of earlier ones.
    """

    def fresh(self, rows: list[dict]) -> list[dict]:
        """Of some rows those whose key isn't in the table, each key once."""
        key = self.options["id"]
        own = {str(r[key]): r for r in reversed(rows)}  # of repeated keys the first
        listed = ",".join(map(quoted, own))
        there = {str(r[key]) for r in fetch(self.options, [("select", key), (key, f"in.({listed})")])}
        return [r for k, r in reversed(own.items()) if k not in there]

    def marked(self, epoch: int) -> bool:
        """Whether the commit log has an epoch."""
        if not self.options.get("log"):
            return False
        return bool(fetch(self.options | {"table": self.options["log"]}, [("select", "epoch"), ("query", f"eq.{self.options.get('query', '')}"), ("epoch", f"eq.{epoch}"), ("limit", 1)]))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Insert what isn't there yet, in batches."""
        epoch, size = int(TaskContext.get().getLocalProperty("streaming.sql.batchId") or 0), int(self.options.get("batch", 100))
        if self.marked(epoch):
            return WriterCommitMessage()
        batch: list[dict] = []

        def flush() -> None:
            if fresh := self.fresh(batch):
                self._try("POST", "", fresh)
            batch.clear()

        for row in iterator:
            batch.append(row.asDict(recursive=True))
            if len(batch) >= size:
                flush()
        if batch:
            flush()
        return WriterCommitMessage()

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        """Mark the epoch: all its rows are there."""
        if self.options.get("log") and not self.marked(batchId):
            self._send("POST", "", [{"query": self.options.get("query", ""), "epoch": batchId}], self.options["log"])

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        """Rows that were sent stay; the epoch's next attempt finds them."""
