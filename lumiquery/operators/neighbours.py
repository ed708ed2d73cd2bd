"""Nearest neighbours by Tanimoto similarity of bit fingerprints.

Candidates and references are dealt into blocks, and each pair of blocks is a cell: one
group of a shuffle that a task compares in NumPy. Of a cell only the k best references a
candidate go on, and the cells' bests are ranked. A cell's size is bounded whatever the
tables' sizes, and no pair of rows is ever shuffled, sorted or written. Fingerprints of up
to 64 bits are packed into a long and compared with bit counts; wider ones are sets of bits,
and meet over an inverted index of the cell's references (``top_k_sets``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import BROADCAST_ROWS
from .ordering import cut

#: Rows of the smallest block of references that is cut only to keep all cores busy, and cells for each core.
LEAST_ROWS, CELLS_A_CORE = 2_048, 4
#: Partitions for each cell, so that few partitions get several cells.
PARTS_A_CELL = 4
#: Bits of sets in a block, one more for each set.
BLOCK_BITS = 2_000_000
#: Similarities that a task holds at once.
SCORES = 2_000_000
#: Columns of scores in a group; only groups' largest scores are searched for the least score that can be among the best.
GROUP = 64
#: Bits in more than this share of a cell's references are counted by a matrix product, as long as the matrix has so many numbers at most; all others by their postings.
HOT_SHARE, HOT_CELLS = 0.05, 40_000_000

#: Similarities of a cell's candidates (some rows after the other) and all its references, which are in the order of their ids.
Scores = Callable[[pa.Table, pa.Table], Iterator[np.ndarray]]


def pack_bits(df: DataFrame, vector: str, out: str = "fp") -> DataFrame:
    """Pack the signs of a vector of up to 64 numbers into a long: bit i is set if element i is positive."""
    return df.withColumn(out, F.expr(f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"))


def _largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest numbers of each row, of equal ones the first."""
    n, groups = scores.shape[1], scores.shape[1] // GROUP
    tops = scores[:, : groups * GROUP].reshape(len(scores), GROUP, groups).max(axis=1) if k <= groups else scores
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] if k < n else np.full(len(scores), -np.inf)
    rows, columns = np.divmod(np.flatnonzero(scores >= least[:, None]), n)
    order = np.lexsort((-scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(scores)))[rows] < k
    return rows[best], columns[best]


def _own_rows(asked: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The references in the order of some number of their ids, and where in it those with each candidate's id begin and end."""
    ids = pa.chunked_array([*known.column("_r").chunks, *asked.column("_q").cast(known.column("_r").type).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(ids[: known.num_rows], kind="stable")
    return order, *(np.searchsorted(ids[order], ids[known.num_rows :], side) for side in ("left", "right"))


def _best_of_cells(queries: DataFrame, refs: DataFrame, k: int, scores: Scores, query_blocks: int, ref_blocks: int, exclude_self: bool) -> DataFrame:
    """``_q``, ``_r`` and ``similarity``: of every cell the k best references (``_r``) of each candidate (``_q``)."""
    cells = query_blocks * ref_blocks
    if exclude_self:
        queries, refs = queries.filter("_q IS NOT NULL"), refs.filter("_r IS NOT NULL")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_other", every(ref_blocks)).withColumn("_cell", block("_q", query_blocks) * ref_blocks + F.col("_other")).drop("_other")
    r = refs.withColumn("_other", every(query_blocks)).withColumn("_cell", F.col("_other") * ref_blocks + block("_r", ref_blocks)).drop("_other")

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.take(pc.sort_indices(known, [("_r", "ascending")], null_placement="at_start"))
        ids, near, found, first = [], [], [], 0
        if asked.num_rows and known.num_rows:
            order, begin, end = _own_rows(asked, known) if exclude_self else (None, [], [])
            for s in scores(asked, known):
                for i, (x, y) in enumerate(zip(begin[first : first + len(s)], end[first : first + len(s)], strict=True)):
                    s[i, order[x:y]] = -1
                rows, columns = _largest(s, k)
                ids.append(rows + first)
                near.append(columns)
                found.append(s[rows, columns])
                first += len(s)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table([asked.column("_q").take(whole(ids, np.int64)), known.column("_r").take(whole(near, np.int64)), pa.array(whole(found, float))], ["_q", "_r", "similarity"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    grouped = [df.repartition(PARTS_A_CELL * cells, "_cell").groupBy("_cell") for df in (q, r)]
    best = grouped[0].cogroup(grouped[1]).applyInArrow(run, f"_q {kind(queries, '_q')}, _r {kind(refs, '_r')}, similarity double")
    return best.filter("similarity >= 0")  # below it: the candidate itself


def _blocks(df: DataFrame, size: float, rows: int, most: float, others: int = 1) -> int:
    """Blocks of references: of at most about ``most`` of a size, and enough for all cores with ``others`` blocks of candidates."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(max(1, -(-size // most), min(-(-CELLS_A_CORE * cores // others), -(-rows // LEAST_ROWS))))


def _ranked(pairs: DataFrame, k: int, candidate_id: str, reference_id: str) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.col("similarity").desc(), "_r")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(candidate_id), F.col("_r").alias(reference_id), "similarity", "rank")


def _packed_scores(asked: pa.Table, known: pa.Table) -> Iterator[np.ndarray]:
    """Similarities of bits packed into longs, 0 where one is null or neither has a bit."""
    a, b = (pc.fill_null(t.column("fp").cast(pa.int64()), 0).to_numpy().view(np.uint64) for t in (asked, known))
    step = max(1, SCORES // len(b))
    for first in range(0, len(a), step):
        part = a[first : first + step, None]
        yield np.divide(np.bitwise_count(part & b), np.maximum(np.bitwise_count(part | b), 1), dtype=float)


def top_k(candidates: DataFrame, references: DataFrame, k: int, candidate_id: str = "candidate_id", reference_id: str = "reference_id", exclude_self: bool = False, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The k most similar references of each candidate; ties go to the smallest reference id.

    Candidates meet every reference (a search over a stated set of references), in cells of
    at most about ``block_rows`` rows of each. ``exclude_self`` leaves out references with the
    candidate's id, and rows without an id.
    """
    q, r = candidates.select(F.col(candidate_id).alias("_q"), "fp"), references.select(F.col(reference_id).alias("_r"), "fp")
    n, blocks = r.count(), _blocks(q, q.count(), 0, block_rows)
    pairs = _best_of_cells(q, r, k, _packed_scores, blocks, _blocks(r, n, n, block_rows, blocks), exclude_self)
    return _ranked(pairs, k, candidate_id, reference_id)


def neighbour_summary(neighbours: DataFrame, candidate_id: str = "candidate_id", reference_id: str = "reference_id") -> DataFrame:
    """Mean and maximum similarity, and the neighbours in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", reference_id))), lambda x: x[reference_id])
    return neighbours.groupBy(candidate_id).agg(F.avg("similarity").alias("mean_similarity"), F.max("similarity").alias("max_similarity"), F.array_join(listed, ",").alias("neighbours"))


def _set_scores(hot_share: float) -> Scores:
    """Similarities of sets of bits, 0 where neither has a bit."""

    def sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = t.column("bits").combine_chunks()
        return held.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(asked: pa.Table, known: pa.Table) -> Iterator[np.ndarray]:
        bits, b = sets(known)
        order = np.argsort(bits, kind="stable")
        bits, rows = bits[order], np.repeat(np.arange(len(b), dtype=np.int32), b)[order]
        first = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]]) if len(bits) else np.empty(0, np.int64)
        keys, last = bits[first], np.r_[first[1:], len(bits)]
        hot = np.argsort(first - last, kind="stable")[: HOT_CELLS // max(1, len(b))]
        hot = hot[(last - first)[hot] > hot_share * len(b)]
        place = np.full(len(keys) + 1, -1)
        place[hot] = np.arange(len(hot))
        has = np.zeros((len(hot), len(b)), np.float32)
        for k, h in enumerate(hot):
            has[k, rows[first[h] : last[h]]] = 1

        want, a = sets(asked)
        at = np.searchsorted(keys, want)
        at[keys[np.minimum(at, len(keys) - 1)] != want if len(keys) else slice(None)] = len(keys)  # a bit that no reference has
        begin = np.r_[0, np.cumsum(a)]
        step = max(1, SCORES // len(b))
        for low in range(0, len(a), step):
            high = min(low + step, len(a))
            mine = at[begin[low] : begin[high]]
            of = np.repeat(np.arange(high - low), a[low:high])
            asks = np.zeros((high - low, len(hot)), np.float32)
            asks[of[place[mine] >= 0], place[mine[place[mine] >= 0]]] = 1
            both = asks @ has
            rare = (mine < len(keys)) & (place[mine] < 0)
            for i, k in enumerate(np.split(mine[rare], np.searchsorted(of[rare], np.arange(1, high - low)))):
                if len(k):
                    both[i] += np.bincount(np.concatenate([rows[x:y] for x, y in zip(first[k], last[k], strict=True)]), minlength=len(b))
            either = np.add.outer(a[low:high].astype(np.float32), b.astype(np.float32))  # whole numbers are exact
            either -= both
            yield np.divide(both, np.maximum(either, 1, out=either), dtype=float)

    return run


def compared_pairs(candidates: DataFrame, references: DataFrame | None, k: int, exclude_self: bool = False, hot_share: float = HOT_SHARE) -> DataFrame:
    """``_q``, ``_r`` and ``similarity`` of pairs that hold the k most similar references of every candidate.

    Frames have ``_q`` or ``_r`` and ``bits``; without references, the candidates are. These pairs alone leave the cells: the k best
    references of a candidate in each. Inside a cell, shared bits are counted for every pair: rare
    bits by the postings of the cell's references, so the work is in proportion to the
    bits that pairs share; bits in more than ``hot_share`` of the references by a matrix product.
    """
    plain = lambda df, c: cut(df.select(c, F.array_distinct(F.array_compact("bits")).alias("bits")))
    queries = plain(candidates, "_q")
    refs = queries.withColumnRenamed("_q", "_r") if references is None else plain(references, "_r")
    (q, _), (r, nr) = (df.agg(F.coalesce(F.sum(F.size("bits") + 1), F.lit(0)), F.count(F.lit(1))).first() for df in (queries, refs))
    blocks = _blocks(queries, q, 0, BLOCK_BITS)
    return _best_of_cells(queries, refs, k, _set_scores(hot_share), blocks, _blocks(refs, r, nr, BLOCK_BITS, blocks), exclude_self)


def top_k_sets(candidates: DataFrame, references: DataFrame | None, k: int, candidate_id: str = "candidate_id", reference_id: str = "reference_id", bits: str = "bits", exclude_self: bool = False, hot_share: float = HOT_SHARE) -> DataFrame:
    """The k most similar references of each candidate by Tanimoto similarity of sets of bits; ties go to the smallest reference id.

    Exact for any number of bits. Ids are unique; rows with a null id are left out, a null
    set is empty, and an empty set has similarity 0 to all. Without references, candidates
    are searched among themselves.
    """
    side = lambda df, name, to: df.filter(F.col(name).isNotNull()).select(F.col(name).alias(to), F.coalesce(F.col(bits).cast("array<int>"), F.array().cast("array<int>")).alias("bits"))
    known = None if references is None else side(references, reference_id, "_r")
    pairs = compared_pairs(side(candidates, candidate_id, "_q"), known, k, exclude_self, hot_share)
    return _ranked(pairs, k, candidate_id, reference_id)
