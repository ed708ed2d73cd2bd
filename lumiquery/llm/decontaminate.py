"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every document is cut into overlapping passages, twice as long as the longest item, so
that each place where an item may stand lies whole in one of them. Each passage is a
query against the items. Scores are shares of the item's own score, so one threshold
holds for all of them, and all items at or above it are retrieved:

* bounds by block: items are in blocks, and each term has its largest impact in each
  block. The bounds of all passages of a batch are summed at once; passages none of
  whose blocks reaches the threshold go no further (terms of many items enter these
  sums as one constant, the most that they can add to any item);
* block-max WAND on the rest: cursors move by the pivot of the terms' upper bounds, and
  skip blocks whose maxima don't reach the threshold.

What is retrieved is verified: the word n-grams of the item's question and of its answer
must both stand in the passage.

The index is sent to the executors, so its size is bounded: beyond ``MAX_ITEMS`` items it
is cut into shards, which count with the figures of all items. The documents are read
once, whatever the number of shards: a task takes ``CHUNK_BYTES`` of them at a time, and
its one Python worker loads the shards one after the other from the executor's copies of
the broadcasts. The driver builds one shard at a time. Documents are not shuffled.

Items of fewer than ``MIN_WORDS`` words have too few terms for a score. They are found
exactly, as consecutive words; an item with letters of a script without blanks, as a
substring of the words joined by blanks. Both have a score of 1.

Edge cases: null or empty texts match nothing; so do items without words; an item without a second sentence is all question, and its last words
are its answer; equal items are each reported; repeated documents are each answered;
other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(r"\w+")
#: Letters of scripts that put no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION_OVERLAP, ANSWER_OVERLAP, GRAM = 0.8, 0.8, 3
#: An index has at most about so many items and so many postings (some 0.5 KB each while it is built); beyond either there are several.
MIN_WORDS, MAX_ITEMS, MAX_POSTINGS = 5, 50_000, 500_000
BLOCK = 4
#: Bytes of a task's documents that meet the shards together.
CHUNK_BYTES = 1 << 26
#: Terms in more than this share of the items are summed as one constant in the bounds.
FREQUENT = 0.05


def words_of(text: str | None) -> list[str]:
    """Lower-case words."""
    return WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: the answer is the last sentence, or without one the last third."""
    head, _, tail = text.rstrip().rstrip(".!?").rpartition(". ")
    question, answer = words_of(head), words_of(tail)
    if not question or len(answer) < GRAM:
        ws = words_of(text)
        cut = max(1, len(ws) - max(GRAM, len(ws) // 3))
        question, answer = ws[:cut], ws[cut:]
    return question, answer


def _grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(n)), strict=False))


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's word n-grams that stand in the passage."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    want = _grams(part, n)
    return len(want & _grams(passage, n)) / len(want)


def corpus_of(lengths: Iterable[int], counts: Iterable[Counter]) -> tuple[int, int, int, Counter]:
    """Number of items, of their words, words of the longest one, and items by word."""
    n, words, longest, df = 0, 0, 0, Counter()
    for length, c in zip(lengths, counts, strict=True):
        n, words, longest = n + 1, words + length, max(longest, length)
        df.update(c.keys())
    return n, words, longest or MIN_WORDS, df


class Index:
    """Inverted index of items with impacts in shares of each item's own score, in blocks."""

    def __init__(self, items: list[tuple[object, str]], corpus: tuple[int, int, int, Counter] | None = None) -> None:
        kept = [(i, t, ws) for i, t in items if t and len(ws := words_of(t)) >= MIN_WORDS]
        short = [(i, ws) for i, t in items if t and 0 < len(ws := words_of(t)) < MIN_WORDS]
        self.ids = [i for i, _, _ in kept] + [i for i, _ in short]
        #: Short items by their first word, or by the first two characters from the first unspaced letter on.
        self.by_word: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        self.by_letters: dict[str, list[tuple[int, int, str]]] = defaultdict(list)
        for j, (_, ws) in enumerate(short, len(kept)):
            text = " ".join(ws)
            if first := UNSPACED.search(text):
                self.by_letters[text[first.start() : first.start() + 2]].append((j, first.start(), text))
            else:
                self.by_word[ws[0]].append((j, ws))
        self.parts = [split_item(t) for _, t, _ in kept]
        counts = [Counter(ws) for _, _, ws in kept]
        lengths = [len(ws) for _, _, ws in kept]
        n = len(kept)
        # a shard counts with the figures of all items, so that its scores are those of one index
        all_n, words, self.longest, df = corpus or corpus_of(lengths, counts)
        mean = words / max(1, all_n)
        idf = {w: math.log(1 + (all_n - df[w] + 0.5) / (df[w] + 0.5)) for c in counts for w in c}
        often = max(1, FREQUENT * all_n)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        frequent = [0.0] * n
        for j, c in enumerate(counts):
            norm = K1 * (1 - B + B * lengths[j] / mean)
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in c.items()}
            total = sum(impact.values())
            for w, x in impact.items():
                postings[w].append((j, x / total))
                if df[w] > often:
                    frequent[j] += x / total
        self.constant = max(frequent, default=0.0)
        self.terms = {w: k for k, w in enumerate(postings)}
        self.items = [[j for j, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.most = [max(x) for x in self.impacts]
        self.blocks = -(-n // BLOCK) if n else 0
        starts, block, bound = [0], [], []
        for w, p in postings.items():
            top: dict[int, float] = {}
            if df[w] <= often:
                for j, x in p:
                    top[j // BLOCK] = max(top.get(j // BLOCK, 0.0), x)
            block += top
            bound += top.values()
            starts.append(len(block))
        self.starts, self.block, self.bound = np.array(starts), np.array(block, np.int64), np.array(bound)
        self.block_most = [defaultdict(float) for _ in self.items]
        for most, its, xs in zip(self.block_most, self.items, self.impacts, strict=True):
            for j, x in zip(its, xs, strict=True):
                most[j // BLOCK] = max(most[j // BLOCK], x)

    def passages_to_search(self, cell: np.ndarray, term: np.ndarray, cells: int) -> np.ndarray:
        """Which cells k begin a passage (cells k and k + 1) some block of which may reach the threshold."""
        if not self.blocks or not len(cell):
            return np.zeros(cells, bool)
        pair = np.unique(cell * len(self.terms) + term)
        cell, term = pair // len(self.terms), pair % len(self.terms)
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(cell, n) * self.blocks + self.block[at]
        # sums by (cell, block), kept sparse; the passage's bound is that of both its cells
        both = np.concatenate([key, key - self.blocks])
        weight = np.concatenate([self.bound[at]] * 2)
        ok = both >= 0
        found, place = np.unique(both[ok], return_inverse=True)
        sums = np.bincount(place, weights=weight[ok]) + self.constant
        out = np.zeros(cells, bool)
        out[found[sums >= THRESHOLD - 1e-9] // self.blocks] = True
        return out

    def search(self, terms: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND over the terms' postings."""
        least = threshold - 1e-9
        cursors = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # no item of this block up to the next cursor's can reach it
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                self._advance(cursors, pivot + 1, target)
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][p] for _, p, t in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot + 1, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _advance(self, cursors: list[list[int]], n: int, target: int) -> None:
        for c in cursors[:n]:
            its = self.items[c[2]]
            while c[1] < len(its) and its[c[1]] < target:
                c[1] += 1
            c[0] = its[c[1]] if c[1] < len(its) else -1

    def short_matches(self, words: list[str]) -> list[tuple[int, float, float, float]]:
        """Like ``matches``, for the items that are too short for a score."""
        found = set()
        if self.by_word:
            for k, w in enumerate(words):
                if w in self.by_word:
                    found.update(j for j, ws in self.by_word[w] if words[k : k + len(ws)] == ws)
        if self.by_letters:
            text = " ".join(words)
            spaced = lambda c: c.strip() and not UNSPACED.match(c)
            for m in UNSPACED.finditer(text):
                for key in {text[m.start() : m.start() + 2], m[0]}:
                    for j, ahead, item in self.by_letters.get(key, ()):
                        low = m.start() - ahead
                        high = low + len(item)
                        # letters of other scripts at an end of the item are whole words
                        if low >= 0 and text.startswith(item, low) and not (spaced(item[0]) and spaced(text[low - 1 : low])) and not (spaced(item[-1]) and spaced(text[high : high + 1])):
                            found.add(j)
        return [(j, 1.0, 1.0, 1.0) for j in sorted(found)]

    def matches(self, words: list[str], ids: np.ndarray, search: np.ndarray, stride: int) -> list[tuple[int, float, float, float]]:
        """(item, best score, question overlap, answer overlap) of the verified items of a document."""
        best: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero(search):
            low, high = k * stride, (k + 2) * stride
            terms = set(ids[low:high].tolist()) - {-1}
            for j, score in self.search(terms):
                passage = words[max(0, low - stride) : high + stride]
                q, a = overlap(self.parts[j][0], passage), overlap(self.parts[j][1], passage)
                if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP and score > best.get(j, (0.0,))[0]:
                    best[j] = (min(1.0, score), q, a)
        return [(j, *v) for j, v in sorted(best.items())]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of so many bytes at least."""
    held, size = [], 0
    for batch in common.slices(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hits(x: Index, texts: list[str | None]) -> list[list[dict]]:
    """What each text holds of an index's items."""
    out: list[list[dict]] = []
    stride, get = x.longest, x.terms.get
    for first in range(0, len(texts), 256):
        part = [words_of(t) for t in texts[first : first + 256]]
        ids = [np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)) for ws in part]
        cells = np.array([-(-len(ws) // stride) + 1 for ws in part])  # one empty cell between documents
        begin = np.concatenate([[0], np.cumsum(cells)])
        cell = np.concatenate([begin[i] + np.arange(len(v)) // stride for i, v in enumerate(ids)])
        flat = np.concatenate(ids)
        known = flat >= 0
        search = x.passages_to_search(cell[known], flat[known], int(begin[-1]))
        for i, ws in enumerate(part):
            mine = search[begin[i] : begin[i + 1] - 1]
            hits = (x.matches(ws, ids[i], mine, stride) if mine.any() else []) + x.short_matches(ws)
            out.append([{"item_id": x.ids[j], "score": s, "question": q, "answer": a} for j, s, q, a in hits])
    return out


def _match(docs: DataFrame, made: list[Broadcast], keep: list[str], item_type: T.DataType, text: str) -> DataFrame:
    """The documents' matches in all shards."""
    kind = pa.list_(pa.struct([("item_id", common.arrow_type(item_type)), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES if len(made) > 1 else 0):
            found: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in chunk]
            for shard in made:
                # of several shards none is kept: the next one takes its memory
                x = shard.value if len(made) == 1 else shard.load_from_path(shard._path)
                for batch, rows in zip(chunk, found, strict=True):
                    for row, hits in zip(rows, _hits(x, common.field_of(batch, text).to_pylist()), strict=True):
                        row += hits
                del x
            for batch, rows in zip(chunk, found, strict=True):
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, kind)], names=[*keep, "matches"])

    match = T.StructType([T.StructField("item_id", item_type), *[T.StructField(c, T.DoubleType()) for c in ("score", "question", "answer")]])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("matches", T.ArrayType(match))])
    return docs.select(*dict.fromkeys((*keep, text.split(".")[0]))).mapInArrow(run, schema)


def _words_of_items(items: DataFrame) -> DataFrame:
    """Each item's shard, number of words and distinct words, of the items that are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            words = [ws if len(ws) >= MIN_WORDS else [] for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array([list(dict.fromkeys(ws)) for ws in words], pa.list_(pa.string()))], names=["shard", "n", "words"])

    return items.select("shard", "text").mapInArrow(run, "shard long, n long, words array<string>").filter("n > 0")


def _shards(items: DataFrame, shards: int) -> Iterator[Index]:
    """Indexes of parts of the items, one after the other, each with the figures of all.

    Items by word are counted by a shuffle; the driver sees only the words of the shard that it builds.
    """
    items = common.cut(items.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards))))
    counted = common.cut(_words_of_items(items))
    n, words, longest = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(MIN_WORDS))).first()
    pairs = counted.select("shard", F.explode("words").alias("word"))
    df = common.cut(pairs.distinct().join(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word"))
    for k in range(shards):
        own = Counter({r["word"]: r["df"] for r in df.filter(F.col("shard") == k).select("word", "df").collect()})
        yield Index(_in_order(items.filter(F.col("shard") == k)), (n, words, longest, own))


def _in_order(items: DataFrame) -> list[tuple[object, str]]:
    return sorted(((r["id"], r["text"]) for r in items.select("id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def match_documents(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", max_items: int = MAX_ITEMS, text: str = "text") -> DataFrame:
    """Each document with the columns to keep and ``matches``, the test items that it holds.

    ``text`` may be a field of a kept struct, as ``row.text``.
    """
    send = docs.sparkSession.sparkContext.broadcast  # each at most about max_items items
    items = benchmark.select(F.col(item_col).alias("id"), "text").filter("text is not null")
    n, postings = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", "\\W+"))), F.lit(0))).first()
    shards = max(1, -(-n // max_items), -(-postings // MAX_POSTINGS))
    made = [send(Index(_in_order(items)))] if shards == 1 else [send(x) for x in _shards(items, shards)]
    return _match(docs, made, list(dict.fromkeys(keep)), benchmark.schema[item_col].dataType, text)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and test item that it holds."""
    found = match_documents(docs, benchmark, (id_col,)).filter(F.size("matches") > 0)
    return found.select(id_col, F.explode("matches").alias("m")).select(id_col, "m.item_id", F.round("m.score", 6).alias("score"), F.round("m.question", 6).alias("question_overlap"), F.round("m.answer", 6).alias("answer_overlap"))
