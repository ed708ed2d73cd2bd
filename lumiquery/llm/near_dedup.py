"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Its sketch is a SetSketch: register i
holds ``floor(1 - log_b(x_i))``, truncated, of the least of exponentially distributed
hashes of the elements. Registers of a union are the register-wise maxima, and they are
locality-sensitive: at base 1.001 two registers are equal with probability close to the
Jaccard similarity.

1. Exact copies (equal words) are grouped by digest; only one representative goes on.
2. Each band of four registers is a bucket. At similarity 0.85 all 32 bands of a pair
   differ with probability 5e-11; at 0.8, 5e-8.
3. Round one pairs each member of a bucket with its pivot, the smallest id: a group that
   shares many buckets shares the pivot, so it sends about one pair a member.
4. Pairs go on if the size bound allows, and the similarity that is most likely, given
   both sizes and how many registers are larger, smaller and equal, is at most five
   standard errors under the threshold. Then both texts' full sets are compared.
5. Round two takes the members of all buckets of three or more that still hold several
   components, and joins them by an exact prefix filter: texts meet only under a shingle
   that is among the rarest of both, so pages that share a template but aren't linked
   don't meet, however many they are. Under a shingle, members of the largest component
   meet only the others, in square cells of bounded size that are dealt over many tasks.
   Pairs of different components are compared by finer sketches; what passes is verified
   like before. So a link that no pivot was part of is found.
6. Components of the verified links come from alternating large-star and small-star steps.

No step sends out all pairs of a group: rounds send pairs with a pivot, and pairs that
the likelihood lets pass between components that aren't yet one. Nothing is capped.

Edge cases: texts without words have an empty set, link with nothing and are their own
component; a null id gets a null component and is kept; rows that share an id share
links; ties go to the smallest id; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile("[^\x20\x09-\x0d]+")
SHINGLE, PERCENT = 5, 85
REGISTERS, BAND_ROWS = 128, 4
#: Registers of the finer sketches of round two.
FINE = 512
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
#: Standard errors of the estimate that a pair may lie under the threshold and still be verified.
SLACK = 5.0
#: Members of a block; two blocks meet in a cell of round two.
BLOCK = 256
#: Hashed counters of shingle frequencies.
COUNTERS = 1 << 16
#: Rarest shingles that go with a text to its cells, so that most pairs go on from one cell only.
HEAD = 64
WORD_CACHE = 50_000

_rng = np.random.default_rng(20_240_501)
_FACTOR = (_rng.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_OFFSET = _rng.integers(0, 2**32, FINE, dtype=np.uint32)[:, None]
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


def words_of(text: str | None) -> list[str]:
    """The words of a text; A-Z are lower-cased."""
    return WORD.findall(text.encode().lower().decode()) if text else []


def shingle_set(words: list[str], hashes: _Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest("\x00".join(words).encode())], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    s = w[:n].copy()
    for k in range(1, size):
        s ^= s >> np.uint64(32)
        s *= _C1
        s += w[k : n + k]
    s ^= s >> np.uint64(32)
    s *= _C2
    s ^= s >> np.uint64(29)
    return np.unique(s)


def sketch(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes. A union's are the maxima of its parts'."""
    least = np.full(registers, 2**32 - 1, np.uint32)
    factor, offset = _FACTOR[:registers], _OFFSET[:registers]
    x = (elements >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        h = factor * x[None, k : k + 2048]
        h += offset
        np.minimum(least, h.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def likely_jaccard(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Most likely similarity, to 1/200, of sets of sizes n1 and n2 of whose registers so many are larger or smaller."""
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    plus, minus = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - plus - minus, 1e-12, 1)
    score = more[:, None] * np.log(plus) + less[:, None] * np.log(minus) + (registers - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), score.argmax(axis=1)]


def _plausible(n1: np.ndarray, r1: np.ndarray, n2: np.ndarray, r2: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may have the similarity asked for: size bound first, then the joint estimate."""
    t, registers = percent / 100, r1.shape[1]
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    out = np.zeros(len(n1), bool)
    at = np.flatnonzero(fits)
    if len(at):
        a, b = r1[at], r2[at]
        j = likely_jaccard(n1[at].astype(float), n2[at].astype(float), (a > b).sum(axis=1), (a < b).sum(axis=1), registers)
        out[at] = j >= t - SLACK * math.sqrt(t * (1 - t) / registers)
    return out


def _registers(column: pa.Array) -> np.ndarray:
    """Registers from a column of lists of bands."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: digest of its words, size of its set, and the bands of its sketch (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in common.slices(batches):
            digests, sizes, bands = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                s = shingle_set(words, hashes)
                digests.append(hashlib.blake2b("\x00".join(words).encode(), digest_size=16).digest())
                sizes.append(len(s))
                bands.append(sketch(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "digest", "n_shingles", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {kind}, digest binary, n_shingles long, bands array<long>")


def _score(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the sketches let pass."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bands_a", "bands_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = _plausible(x.column(2).to_numpy(), _registers(x.column(4)), x.column(3).to_numpy(), _registers(x.column(5)), percent)
                yield x.select([0, 1]).filter(pa.array(keep))

    kind = reps.schema["rep"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, with the sizes of intersection and union."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        recent: dict[str, np.ndarray] = {}

        def get(text: str) -> np.ndarray:
            if text not in recent:
                if len(recent) >= 16:
                    recent.clear()
                recent[text] = shingle_set(words_of(text), hashes)
            return recent[text]

        for x in common.slices(batches):
            common_n, union_n = [], []
            for ta, tb in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                s, t = get(ta), get(tb)
                i = len(np.intersect1d(s, t, assume_unique=True))
                common_n.append(i)
                union_n.append(len(s) + len(t) - i)
            i, u = np.array(common_n, np.int64), np.array(union_n, np.int64)
            out = pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(i), pa.array(u)], names=["a", "b", "n_common", "n_union"])
            yield out.filter(pa.array((u > 0) & (100 * i >= percent * u)))

    kind = texts.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, n_common long, n_union long")


def _frequencies(texts: DataFrame) -> Broadcast:
    """Shingle frequencies in ``COUNTERS`` hashed counters, so what the driver sees is bounded. They only put shingles in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros(COUNTERS, np.int64)
        for x in common.slices(batches):
            sets = [shingle_set(words_of(t), hashes) for t in x.column(2).to_pylist()]
            if sets:
                total += np.bincount(np.concatenate(sets) % np.uint64(COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])

    found = texts.mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    often = np.zeros(COUNTERS, np.int64)
    often[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return texts.sparkSession.sparkContext.broadcast(often)


def _by_rarity(s: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """The n rarest shingles of a set, in the one order of all shingles."""
    return s[np.lexsort((s, often[s % np.uint64(COUNTERS)]))[:n]]


def _prefixes(texts: DataFrame, often: Broadcast, percent: int) -> DataFrame:
    """(token, rep, comp, n_shingles, place, indexed): the rarest shingles of each text, enough of them for a prefix filter.

    In one order of all shingles, sets of similarity t share a token among the first
    ``n - ceil(t n) + 1`` of the larger set and the first ``n - ceil(2t / (1 + t) n) + 1``
    of the smaller one (``indexed``).
    """
    kind = common.arrow_type(texts.schema["rep"].dataType)
    schema = pa.schema([("token", pa.int64()), ("rep", kind), ("comp", kind), ("n_shingles", pa.int64()), ("place", pa.int32()), ("indexed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for x in common.slices(batches, 200):
            tokens, index, sizes = [], [], []
            for t in x.column(2).to_pylist():
                s = shingle_set(words_of(t), hashes)
                n = len(s)
                tokens.append(_by_rarity(s, often.value, n - -(-percent * n // 100) + 1).view(np.int64))
                index.append(n - -(-2 * percent * n // (100 + percent)) + 1)
                sizes.append(n)
            if tokens:
                lengths = [len(t) for t in tokens]
                each, places = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
                columns = [pa.array(np.concatenate(tokens)), x.column(0).take(pa.array(each)), x.column(1).take(pa.array(each)), pa.array(np.array(sizes, np.int64)[each]), pa.array(places), pa.array(places < np.array(index)[each])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    name = texts.schema["rep"].dataType.simpleString()
    return texts.mapInArrow(run, f"token long, rep {name}, comp {name}, n_shingles long, place int, indexed boolean")


def _fine_sketches(texts: DataFrame, often: Broadcast) -> DataFrame:
    """(rep, fine, head): sketches of ``FINE`` registers, and the ``HEAD`` rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for x in common.slices(batches):
            sets = [shingle_set(words_of(t), hashes) for t in x.column(2).to_pylist()]
            fine, head = [sketch(s, FINE).tobytes() for s in sets], [_by_rarity(s, often.value, HEAD).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fine, pa.binary()), pa.array(head, pa.binary())], names=["rep", "fine", "head"])

    return texts.mapInArrow(run, f"rep {texts.schema['rep'].dataType.simpleString()}, fine binary, head binary")


def _cells(rows: DataFrame) -> DataFrame:
    """Deal the members of each token to square cells of two blocks.

    Members of a token's largest component need no comparing among themselves: their
    blocks meet only those of the others, and the others' blocks each other.
    """
    per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.bool_or("indexed").alias("indexed"))
    per = per.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), F.bool_or("indexed").alias("indexed")).filter("n > big.n AND indexed")
    blocks = lambda n: F.ceil(n / BLOCK)
    dealt = common.cut(per.select("token", F.col("big.comp").alias("big"), blocks(F.col("big.n")).alias("nb"), blocks(F.col("n") - F.col("big.n")).alias("ns")))
    rows = rows.join(common.lookup(dealt), "token")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda row, col, left, right: F.struct(row.alias("row"), col.alias("col"), left.alias("left"), right.alias("right"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("comp") == F.col("big"), F.col("nb")).otherwise(F.col("ns")))
    rows = rows.withColumn("block", block)
    k, nb, ns = F.col("block"), F.col("nb"), F.col("ns")
    big = F.transform(upto(ns), lambda j: place(k, j, F.lit(True), F.lit(False)))
    other = F.concat(F.transform(upto(nb), lambda i: place(i, k, F.lit(False), F.lit(True))), F.transform(upto(ns), lambda j: place(nb + F.least(k, j), F.greatest(k, j), k <= j, k >= j)))
    cell = F.explode(F.when(F.col("comp") == F.col("big"), big).otherwise(other))
    return rows.select("token", "rep", "comp", "n_shingles", "place", "indexed", cell.alias("cell")).select("token", "cell.*", "rep", "comp", "n_shingles", "place", "indexed")


def _residual_pairs(docs: DataFrame, id_col: str, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """Plausible pairs of different components among the members of all buckets of three or more that hold several."""
    m = members.filter("n >= 3").join(labels, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_keys = common.cut(m.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high").select("key"))
    ids = common.cut(m.join(common.lookup(open_keys), "key").select("rep", "comp").distinct())
    if not ids.take(1):
        return None
    texts = docs.select(F.col(id_col).alias("rep"), "text").join(common.lookup(ids), "rep").select("rep", "comp", "text")
    often = _frequencies(texts)
    dealt = common.cut(_cells(common.cut(_prefixes(texts, often, percent))))
    ends = common.cut(dealt.select("rep", "comp").distinct())
    fine = _fine_sketches(docs.select(F.col(id_col).alias("rep"), "text").join(common.lookup(ends), "rep").select("rep", "comp", "text"), often)
    # the cells of a hot token hash to many tasks; a task holds one cell, two blocks, at a time
    rows = dealt.join(common.cut(fine), "rep").select("token", "row", "col", "left", "right", "rep", "comp", "n_shingles", "indexed", "fine", "head", "place")
    rows = rows.repartition("token", "row", "col").sortWithinPartitions("token", "row", "col")
    schema = pa.schema([("a", common.arrow_type(ids.schema["rep"].dataType)), ("b", common.arrow_type(ids.schema["rep"].dataType))])

    def cell(rows: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {"a": [], "b": []}
        seen: dict[object, frozenset[int]] = {}

        def early(r: tuple) -> frozenset[int]:
            if r[5] not in seen:
                seen[r[5]] = frozenset(np.frombuffer(r[10], np.uint64)[: r[11]].tolist())
            return seen[r[5]]

        right = [r for r in rows if r[4]]
        if right and any(r[6] != rows[0][6] for r in rows):
            comp, size, indexed = np.array([r[6] for r in right]), np.array([r[7] for r in right]), np.array([r[8] for r in right])
            regs = np.frombuffer(b"".join(r[9] for r in right), np.uint16).reshape(-1, FINE)
            for r in rows:
                if r[3]:
                    at = np.flatnonzero((comp != r[6]) & np.where(size >= r[7], r[8], indexed))
                    if len(at):
                        mine = np.broadcast_to(np.frombuffer(r[9], np.uint16), (len(at), FINE))
                        for k in at[_plausible(np.full(len(at), r[7]), mine, size[at], regs[at], percent)]:
                            # a pair that surely met under a rarer shingle went on from there
                            if not early(r) or early(r).isdisjoint(early(right[k])):
                                out["a"].append(min(r[5], right[k][5]))
                                out["b"].append(max(r[5], right[k][5]))
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != at:
                    if rows:
                        yield cell(rows)
                    at, rows = r[:3], []
                rows.append(r)
        if rows:
            yield cell(rows)

    kind = ids.schema["rep"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, comp) of every end of a link: comp is the smallest end that it reaches."""
    edges = common.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.cut(small.filter("u != v").distinct())
        if (now := mark(edges)) == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    return ends.unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct())


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sketch rows of all documents, their representatives, the verified links of representatives, and their components."""
    with common.few_rows_a_batch(docs.sparkSession, 500):  # every step here is eager
        return _similar_pairs(docs, id_col, percent)


def _similar_pairs(docs: DataFrame, id_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = common.cut(sketches(docs, id_col))
    reps = rows.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    reps = common.cut(reps)
    keys = reps.select("rep", F.posexplode("bands").alias("band", "_band")).select("rep", F.xxhash64("_band", "band").alias("key"))
    buckets = common.cut(keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = common.cut(keys.join(buckets, "key").select("key", "rep", "n", "pivot"))
    first = members.filter("rep != pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    first = common.cut(_score(first, reps, percent))
    ids = lambda pairs: common.lookup(common.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    text = lambda pairs: common.cut(docs.select(F.col(id_col).alias("id"), "text").join(ids(pairs), "id"))
    links = common.cut(_verify(first, text(first), percent))
    comps = common.cut(components(links))
    rest = _residual_pairs(docs, id_col, members, comps, percent)
    if rest is not None:
        second = common.cut(rest.join(first, ["a", "b"], "left_anti"))
        more = common.cut(_verify(second, text(second), percent))
        links = links.unionByName(more)
        if more.take(1):
            # components of components: what the first links join is one star each
            comps = common.cut(components(more.select("a", "b").unionByName(comps.select(F.col("rep").alias("a"), F.col("comp").alias("b")))))
    return rows, reps, links, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, component_id (smallest id it is linked to, step by step) and kept (it is that one)."""
    rows, reps, _, comps = similar_pairs(docs, id_col, percent)
    named = reps.select("digest", "rep").join(comps, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("_comp"))
    out = rows.select("id", "digest", "n_shingles").join(named, "digest", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("_comp", "id")).otherwise(F.col("id"))
    comp = F.when(F.col("id").isNotNull(), comp)
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
