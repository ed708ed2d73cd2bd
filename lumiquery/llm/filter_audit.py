"""How a set of document filters act on each other, in every order.

Each document has a mask: bit i is set if it fails filter i. What every order of the
filters keeps and removes follows from the counts of masks alone.

1. The four filters that look at one text are expressions in the JVM.
2. The fifth, exact copies over the whole table, is a fingerprint-routed RDD. A task
   first settles its own rows: under each fingerprint (xxhash64) a chain of the different
   texts, each whole, with its smallest id. Rows whose text has a smaller id in the same
   task are copies for certain and go on as (id, part, mask); only one entry a text is
   shuffled with its text, so a group of copies with a third of all rows sends one entry
   a task, and the others are dealt by their own ids. A task's chains are flushed when they
   hold ``HELD_CHARS``: that costs shuffle, never results.
3. Entries are partitioned by fingerprint and sorted by (fingerprint, id) within their
   partitions, with spilling. So a chain is the texts of one fingerprint, the first entry
   of a text has its smallest id, and each further one with a larger id is a copy.
4. Labels join by id, without texts. Counts of masks by part are vectors that
   ``combineByKey`` adds up, on the map side first.

Edge cases: a null text is an empty one; a null source is the part of the empty text; a
row without an id is no copy and makes none; rows with the same id and text are no copies
of each other, both are copies of a smaller id; a label counts if any row of its id has
it; texts of any length pass through whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The filters, in the order of their bits: too few words, repeated words, capitals, marks, exact copies.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
MARKS = "[#$%&*|]"
#: Characters of different texts that a task holds before it sends them on.
HELD_CHARS = 1 << 25
#: Different settled rows that a task holds.
HELD_ROWS = 1 << 16
#: Partitions that texts are dealt to, for each one that they are read from.
SPREAD = 2

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words_of(text: Column) -> Column:
    """Words of a text, with case."""
    return F.filter(F.split(text, common.SPACE_RE), lambda w: w != "")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(MARKS))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def settle(rows: Iterable[tuple], held_chars: int | None = None) -> Iterator[tuple]:
    """A task's rows (id, part, mask, fingerprint, text) as entries with a text, one a text, and settled rows without.

    An entry's key is (fingerprint, 1, id), a settled row's (hash of its id or part, 0, 0); the value is (text, id, mask, parts and how often).
    """
    held_chars = held_chars or HELD_CHARS
    chains: dict[int, dict[str, list]] = {}
    settled: Counter = Counter()  # equal rows go on as one
    held = 0
    for doc, part, mask, route, text in rows:
        if doc is None:
            settled[None, part, mask] += 1
            continue
        chain = chains.setdefault(route, {})
        entry = chain.get(text)
        if entry is None:
            chain[text] = [doc, mask, Counter({part: 1})]
            held += len(text)
        elif doc == entry[0]:
            entry[2][part] += 1
        elif doc > entry[0]:
            settled[doc, part, mask | COPY] += 1
        else:
            for own, n in entry[2].items():
                settled[entry[0], own, mask | COPY] += n
            entry[0], entry[2] = doc, Counter({part: 1})
        if held > held_chars or len(settled) > HELD_ROWS:
            yield from _entries(chains, settled)
            chains, held = {}, 0
            settled.clear()
    yield from _entries(chains, settled)


def _entries(chains: dict[int, dict[str, list]], settled: Counter) -> Iterator[tuple]:
    for route, chain in chains.items():
        for text, (doc, mask, parts) in chain.items():
            yield (route, 1, doc), (text, doc, mask, tuple(parts.items()))
    for (doc, part, mask), n in settled.items():
        route = zlib.crc32((part if doc is None else str(doc)).encode("utf-8", "surrogatepass"))  # the same in every attempt of a task
        yield (route, 0, 0), (None, doc, mask, ((part, n),))


def resolve(entries: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (id, part, mask, how often) of entries and settled rows that are sorted by key."""
    now, chain = None, {}
    for (route, open_, _), (text, doc, mask, parts) in entries:
        if open_:
            if route != now:
                now, chain = route, {}
            if chain.setdefault(text, doc) < doc:
                mask |= COPY
        for part, n in parts:
            yield doc, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id``, ``part``, ``mask`` and ``n``, the number of such rows."""
    spark, text = docs.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.xxhash64("text").alias("route"), "text").rdd
    dealt = rows.mapPartitions(settle).repartitionAndSortWithinPartitions(SPREAD * rows.getNumPartitions(), lambda key: key[0])
    return spark.createDataFrame(dealt.mapPartitions(resolve), f"doc_id {kind}, part string, mask int, n long", verifySchema=False)


def orders() -> list[tuple[str, ...]]:
    """All orders of the filters."""
    return list(permutations(FILTERS))


def effects(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """A part's rows of the result, from its counts by mask (all, good, toxic)."""
    of = np.arange(1 << len(FILTERS))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    gone, rows = Counter(), []
    for order in orders():
        before = 0
        for step, f in enumerate(order, 1):
            fails, passed = (of & bit[f]) > 0, (of & before) == 0
            removed, good, toxic = counts[fails & passed].sum(axis=0)
            before |= bit[f]
            kept = counts[(of & before) == 0, 0].sum()
            redundant = counts[fails & ~passed, 0].sum()
            gone[f] += removed
            rows.append((f, part, "".join(order), step, kept, removed, redundant, counts[bit[f], 0], good, toxic))
    for f, *row in rows:
        yield (*row[:2], row[2], *map(int, row[3:]), int(gone[f]))


def _vector(value: tuple[int, int, bool, bool]) -> np.ndarray:
    return _add(np.zeros((1 << len(FILTERS), 3), np.int64), value)


def _add(counts: np.ndarray, value: tuple[int, int, bool, bool]) -> np.ndarray:
    mask, n, good, toxic = value
    counts[mask] += (n, n * good, n * toxic)
    return counts


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    spark = docs.sparkSession
    lost = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    lost = common.cut(lost.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    rows = masks(docs, id_col, text_col, part_col).join(common.lookup(lost), "doc_id", "left")
    rows = rows.select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd
    counts = rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _add, np.add)
    return spark.createDataFrame(counts.flatMap(lambda kv: effects(*kv)), RESULT, verifySchema=False)
