"""Spelling variants: words one edit apart, found through each word's full neighbourhood.

1. Words are counted over all texts in the JVM (``count_words``): equal words are summed
   before they are shuffled, so a word with a third of all places is one row a task.
2. The alphabet is that of the words themselves. For each word all distinct deletions,
   replacements and insertions over it are generated. Their hashes come from the hashes
   of the word's prefixes and suffixes, in NumPy: a candidate costs a few operations and
   becomes a string only if a Bloom filter of the words lets it pass. The filter has 16
   bits a word, up to ``MAX_BITS`` (128 MB); a vocabulary beyond that makes it let more
   pass, never fewer.
3. Candidates are hash-joined to the words by their whole text. What joins is exactly one
   edit away by construction, so no distance is computed.
4. A word's form is its near word of largest count; chains of forms are followed by
   doubling their steps. A form has at least ``ratio`` times its word's count, so a chain
   has at most log(largest count) steps and the number of rounds is known.

Distinct candidates: a run of equal letters loses only its first, and a letter is put in
only where the one before differs, so no candidate of a word comes twice.

Edge cases: a null text has no words; a null id counts as the empty text in the hash that
decides a place's deletion; repeated rows count again; a word of any length takes memory in
proportion to its length (its candidates are hashed block by block); ties between forms go
to the smallest word in code-point order; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a run; only A-Z are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Shortest word, in code points, and fewest places of it.
MIN_LENGTH, MIN_PLACES = 7, 2
#: A place in so many loses a letter.
DELETE_IN = 31
#: How many times as frequent as a word its form is, at least.
RATIO = 10
#: Bits of the filter: a word has 16, within these powers of two; 32,768 are one row of its table.
LEAST_BITS, MAX_BITS = 15, 30
#: Words of a task that generates candidates, and hashes that it makes at once.
TASK_WORDS, BLOCK = 16_384, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, places: int = MIN_PLACES) -> DataFrame:
    """``word`` and its number of places ``n``, of the words that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all(f"`{text_col}`", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_doc"), run.alias("_run"))
    runs = runs.select("_doc", F.when(F.octet_length("_run") == F.length("_run"), F.lower("_run")).otherwise(common.ascii_lower(F.col("_run"))).alias("_run"))
    h = F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select("_run", h.alias("_h")).select(F.when(F.col("_h") % DELETE_IN == 0, less).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= places)


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point."""
    z = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    return z ^ (z >> np.uint64(27))


def word_codes(words: list[str]) -> np.ndarray:
    """Words of one length as a table of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Hash of each prefix: that of x and y together is ``hash(x) * base ** len(y) + hash(y)``."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    for i in range(values.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + values[:, i]
    return out


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])


def bit_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """A word's two places in a filter of ``2 ** bits`` bits."""
    return [(hashes * m) >> np.uint64(64 - bits) for m in _MIX]


class Neighbours:
    """Candidates of words that may be words, by a filter."""

    def __init__(self, alphabet: list[str], table: np.ndarray, bits: int) -> None:
        self.letters = np.sort(word_codes(alphabet)[:, 0]) if alphabet else np.zeros(0, np.uint32)
        self.values, self.table, self.bits = letter_values(self.letters), table, bits

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the flattened hashes that the filter lets pass."""
        flat = hashes.ravel()
        has = lambda h, m: (self.table[(p := (h * m) >> np.uint64(64 - self.bits)) >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        first = np.flatnonzero(has(flat, _MIX[0]))
        return first[has(flat[first], _MIX[1]).astype(bool)]

    def of(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """Place of the word, and candidate, for words of one length; a distinct candidate comes once a word."""
        codes = word_codes(words)
        k, n = codes.shape
        values, a = letter_values(codes), len(self.letters)
        head, power = prefix_hashes(values), _powers(n + 1)
        tail = head[:, -1:] - head * power[n - np.arange(n + 1)]  # hash of w[i:]
        step = max(1, BLOCK // max(1, k * a))
        for low in range(0, n + 1, step):
            at = np.arange(low, min(n + 1, low + step))
            inner = at[at < n]
            if len(inner):
                gone = head[:, inner] * power[n - 1 - inner] + tail[:, inner + 1]
                for x in self.passing(gone):
                    row, i = divmod(int(x), len(inner))
                    i = int(inner[i])
                    if i == 0 or codes[row, i] != codes[row, i - 1]:
                        yield row, words[row][:i] + words[row][i + 1 :]
                kept = head[:, inner] * power[n - inner] + tail[:, inner + 1]
                put = kept[:, :, None] + (self.values[None, None, :] * power[n - 1 - inner][None, :, None])
                for x in self.passing(put):
                    row, rest = divmod(int(x), len(inner) * a)
                    i, c = divmod(rest, a)
                    i = int(inner[i])
                    if codes[row, i] != self.letters[c]:
                        yield row, f"{words[row][:i]}{chr(self.letters[c])}{words[row][i + 1 :]}"
            more = head[:, at] * power[n + 1 - at] + tail[:, at]
            put = more[:, :, None] + (self.values[None, None, :] * power[n - at][None, :, None])
            for x in self.passing(put):
                row, rest = divmod(int(x), len(at) * a)
                i, c = divmod(rest, a)
                i = int(at[i])
                if i == 0 or codes[row, i - 1] != self.letters[c]:
                    yield row, f"{words[row][:i]}{chr(self.letters[c])}{words[row][i:]}"


def _by_length(words: list[str], most: int) -> Iterator[list[int]]:
    """Places of words of one length, so many code points at a time."""
    groups: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        groups.setdefault(len(word), []).append(place)
    for length, places in groups.items():
        step = max(1, most // max(1, length))
        for first in range(0, len(places), step):
            yield places[first : first + step]


def _filter_table(words: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of all words: its bits are set by a grouped aggregate, 32,768 to a row, and at most 128 MB reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, TASK_WORDS):
            found, texts = [], batch.column("word").to_pylist()
            for group in _by_length(texts, BLOCK):
                found += bit_places(prefix_hashes(letter_values(word_codes([texts[i] for i in group])))[:, -1], bits)
            yield pa.record_batch([pa.array(np.concatenate(found).astype(np.int64) if found else [], pa.int64())], ["place"])

    rows = words.select("word").mapInArrow(places, "place long")
    one_up = F.col("place") + 1  # the functions count places from 1
    rows = rows.groupBy(F.bitmap_bucket_number(one_up).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_up)).alias("bits"))
    table = np.zeros(2**bits // 8, np.uint8)
    for part, held in rows.collect():
        table[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)[: len(table)]
    return table


def near_words(words: DataFrame, n_words: int) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n`` for all ordered pairs of words one edit apart. ``words`` is a checkpointed table of ``word`` and ``n``."""
    spark = words.sparkSession
    bits = min(MAX_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, n_words)))))
    alphabet = [r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().filter("c <> ''").collect()]  # code points, however many words
    made = spark.sparkContext.broadcast((alphabet, _filter_table(words, bits), bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Neighbours(*made.value)
        for batch in common.slices(batches):
            texts, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for group in _by_length(texts, BLOCK // 64):
                rows, found, held = [], [], 0
                some = [texts[i] for i in group]
                for row, candidate in own.of(some):
                    rows.append(group[row])
                    found.append(candidate)
                    held += len(candidate)
                    if held > BLOCK:
                        yield pa.record_batch([pa.array([texts[i] for i in rows]), pa.array(counts[rows]), pa.array(found)], ["word", "n", "near"])
                        rows, found, held = [], [], 0
                if rows:
                    yield pa.record_batch([pa.array([texts[i] for i in rows]), pa.array(counts[rows]), pa.array(found)], ["word", "n", "near"])

    dealt = words.select("word", "n").repartition(max(1, math.ceil(n_words / TASK_WORDS)), "word")
    pairs = dealt.mapInArrow(candidates, "word string, n long, near string")
    return pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of a table of distinct words and their counts ``n``."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = common.cut(words.select("word", F.col("n").cast("long").alias("n")))
    size = words.agg(F.count(F.lit(1)), F.max("n")).first()
    pairs = near_words(words, size[0])
    both = pairs.unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("_best"))
    frequent = -F.col("_best.less") >= ratio * F.col("n")
    found = common.cut(found.select("word", "n", "n_near", F.when(frequent, F.col("_best.near")).alias("form"), F.when(frequent, -F.col("_best.less")).alias("form_n")))

    steps = common.cut(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    chain = math.log(max(1, size[1] or 1), ratio)  # steps that a chain has at most
    for _ in range(math.ceil(math.log2(max(1.0, chain)))):
        then = common.lookup(steps).select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = common.cut(steps.join(then, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    out = found.join(common.lookup(steps), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
