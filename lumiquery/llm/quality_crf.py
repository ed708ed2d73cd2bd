"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are shares of character classes, its length,
words and repeats, and those of the lines before and after it. Forward-backward gives
each line's marginal; their mean, weighted by line length, is the document's quality,
which a logistic curve maps to the score.

Training: document labels are given to all lines; after a first fit the lines of bad
documents that look good on their own become good (never all of a document's lines),
and the field is fitted again. Only labelled rows whose crc32(id as text) mod 3 is not 1
are used: the first ``MAX_TRAIN_DOCS`` ids in hash order, and of these the first whose
lines are ``MAX_TRAIN_LINES`` in all (a longer document is left out), so the driver holds
at most 100 MB of features. Of rows that share an id one is used. The id chooses rows and
is never a feature. Scoring takes every line of every text.

Edge cases: a null or empty text is one empty line and is scored like any other;
repeated rows are each answered; rows with several labels count by the lowest; a null id
is never trained on and not held out; other columns are ignored; without usable labels
of both kinds every score is the share of good labels, or 0.5 without any; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 4_000, 200_000
STEPS, RATE, DECAY = 150, 0.15, 1e-3
#: A line of a bad document is good if the first fit, without neighbours' labels, says so this surely.
SURE = 0.9

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b".,;:'\"()-?", b"!", b"|", b"#*$%&<>@/\\=_{}[]~^+"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
_N = 10
FEATURES = _N + 7


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (lines x FEATURES) and the lines' lengths in bytes."""
    data = _bytes_of(text)
    lines = data.split(b"\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    at = np.repeat(np.arange(n), length + 1)[:-1] if n > 1 else np.zeros(len(data), np.int64)
    cls = _CLASS[np.frombuffer(data, np.uint8)]
    counts = np.bincount(at * _N + cls, minlength=n * _N).reshape(n, _N).astype(np.float32)
    counts[:-1, 0] -= 1  # the line break
    x = np.zeros((n, FEATURES), np.float32)
    full = np.maximum(length, 1).astype(np.float32)
    x[:, :_N] = counts / full[:, None]
    seen: set[bytes] = set()
    words, distinct, again = np.empty(n, np.float32), np.empty(n, np.float32), np.zeros(n, np.float32)
    for i, line in enumerate(lines):
        ws = line.split()
        words[i], distinct[i] = len(ws), len(set(ws))
        if ws:
            again[i] = line in seen
            seen.add(line)
    some = np.maximum(words, 1)
    x[:, _N] = np.log1p(length) / 8
    x[:, _N + 1] = np.log1p(words) / 6
    x[:, _N + 2] = length / some / 20
    x[:, _N + 3] = (distinct / some) * (words > 0)
    x[:, _N + 4] = again
    x[:, _N + 5] = words == 0
    x[:, _N + 6] = (some - distinct) / 50
    return np.minimum(x, 3.0, out=x), length


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), np.float32)])


@dataclass
class Field:
    """The fitted field: weights of a line being good, transition scores, and the curve from quality to score."""

    weights: np.ndarray
    transition: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def marginals(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(good) of each line; documents are the slices between ``starts``."""
        return forward_backward(x @ self.weights, self.transition, starts)[0]

    def quality(self, x: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Mean marginal of each document, weighted by line length."""
        w = length + 1.0
        p = self.marginals(x, starts)
        return np.add.reduceat(p * w, starts[:-1]) / np.add.reduceat(w, starts[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        if self.constant is not None:
            return np.full(len(quality), self.constant)
        return _sigmoid(self.curve[0] * quality + self.curve[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def forward_backward(unary: np.ndarray, transition: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transitions, of all documents at once.

    Documents are taken by falling length, so those with a line at step t are a prefix;
    messages are scaled to sum to 1 at each step.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    begin, n = starts[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with more than t lines
    move = np.exp(transition)
    local = np.stack([_sigmoid(-unary), _sigmoid(unary)], axis=1)
    forward, backward = np.empty_like(local), np.ones_like(local)
    for t in range(longest):
        at = begin[: live[t]] + t
        m = local[at] if t == 0 else local[at] * (forward[at - 1] @ move)
        forward[at] = m / m.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        m = (backward[at + 1] * local[at + 1]) @ move.T
        backward[at] = m / m.sum(axis=1, keepdims=True)
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    has_next = np.ones(len(unary), bool)
    has_next[starts[1:] - 1] = False
    i = np.flatnonzero(has_next)
    pair = forward[i][:, :, None] * move[None] * (local[i + 1] * backward[i + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pair.sum(axis=0)


def _fit_field(x: np.ndarray, y: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest weights and transitions for labelled lines, by Adam on the exact gradient."""
    w = np.zeros(x.shape[1]) if weights is None else weights.copy()
    a = np.zeros((2, 2))
    has_next = np.ones(len(y), bool)
    has_next[starts[1:] - 1] = False
    i = np.flatnonzero(has_next)
    seen = np.bincount(y[i] * 2 + y[i + 1], minlength=4).reshape(2, 2)
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for step in range(1, STEPS + 1):
        p, pair = forward_backward(x @ w, a, starts)
        g = np.concatenate([(y - p) @ x, (seen - pair).ravel()]) / len(y) - DECAY * np.concatenate([w, a.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        a += move[len(w) :].reshape(2, 2)
    return w, a


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """Fit on (line features, line lengths, label) of each training document."""
    good = [d[2] for d in docs]
    if not docs or len(set(good)) < 2:
        return Field(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), (0.0, 0.0), float(np.mean(good)) if good else 0.5)
    starts = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])])
    x = with_neighbours(np.vstack([d[0] for d in docs]), starts).astype(np.float64)
    length, label = np.concatenate([d[1] for d in docs]), np.array(good)
    y = np.repeat(label, np.diff(starts))
    w, _ = _fit_field(x, y, starts)
    alone = _sigmoid(x @ w)
    worst = np.minimum.reduceat(alone, starts[:-1])
    y = np.where((y == 0) & (alone > SURE) & (alone > np.repeat(worst, np.diff(starts))), 1, y)
    w, a = _fit_field(x, y, starts, w)
    field = Field(w, a, (1.0, 0.0))
    q = field.quality(x, starts, length)
    c = np.zeros(2)
    z = np.stack([q, np.ones(len(q))], axis=1)
    for _ in range(30):  # Newton steps of a logistic fit, lightly damped
        p = _sigmoid(z @ c)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        c += np.clip(np.linalg.solve(h, z.T @ (label - p) - 1e-2 * c), -5, 5)
    field.curve = (float(c[0]), float(c[1]))
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> Field:
    """Fit on a bounded sample of the labelled documents that aren't held out."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1))
    picked = usable.groupBy("_id").agg(F.min("_y").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs).collect()
    kind = docs.schema[id_col].dataType.simpleString()
    ids = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(picked)], f"_place int, _id {kind}, _y int")  # at most max_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for place, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (text or "").count("\n") < max_lines:
                    x, n = line_features(text)
                    out.append({"place": place, "lines": len(n), "x": x.tobytes(), "n": n.tobytes(), "y": y})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("place", pa.int32()), ("lines", pa.int32()), ("x", pa.binary()), ("n", pa.binary()), ("y", pa.int32())]))

    texts = docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(ids), "_id").select("_place", "text", "_y")
    features = texts.mapInArrow(run, "place int, lines int, x binary, n binary, y int")
    # one row an id, then documents in hash order as long as their lines are few enough for the driver
    with common.few_rows_a_batch(spark):
        one = common.cut(features.groupBy("place").agg(F.min(F.struct("lines", "x", "n", "y")).alias("r")).select("place", "r.*"))
    last, lines = -1, 0
    for r in one.select("place", "lines").orderBy("place").collect():
        lines += r["lines"]
        if lines > max_lines:
            break
        last = r["place"]
    rows = one.filter(F.col("place") <= last).orderBy("place").collect()
    return fit([(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES), np.frombuffer(bytes(r["n"]), np.int64), r["y"]) for r in rows])


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Per document: id, the columns to keep, and ``score``. ``text`` may be a field of a kept struct, as ``row.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores, part, lines = [], [], 0
            texts = common.field_of(batch, text).to_pylist()
            for i, t in enumerate(texts):
                part.append(line_features(t))
                lines += len(part[-1][1])
                if lines > 200_000 or i == len(texts) - 1:
                    starts = np.concatenate([[0], np.cumsum([len(d[1]) for d in part])])
                    x = with_neighbours(np.vstack([d[0] for d in part]), starts)
                    scores.append(field.score(field.quality(x, starts, np.concatenate([d[1] for d in part]))))
                    part, lines = [], 0
            out = [batch.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*cols, "score"])

    cols = list(dict.fromkeys((id_col, *keep)))
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys((*cols, text.split(".")[0]))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels, id_col), id_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
