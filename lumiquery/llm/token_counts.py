"""Token counts of whole texts under a public tokenizer.

An Arrow function takes the texts and gives back their numbers of tokens alone, so no id
leaves a Python worker and every other column stays in the JVM. Texts are regrouped into
batches of about ``BATCH_BYTES`` bytes before the library encodes them, however long the
single texts are: a batch's memory doesn't depend on the rows that Arrow happened to send
together. A text over ``PIECE_CHARS`` is cut at safe boundaries and its pieces' counts are
added; a safe boundary is a place that no token of the whole text can cross:

* byte-level and word-level files (``.json``), and ranks (``.tiktoken``): before white
  space that follows something else, between an ASCII letter and a digit, and before
  ideographic punctuation that follows an ideograph. The rules that cut texts into words
  match nothing across these places, and look ahead only past white space. They hold
  only for the forms of files that ``_json_can_split`` lists; a text under another
  form isn't cut.
* ``.model``: at a single blank between ASCII letters or digits, which is left out, since
  the library puts one before each text; only if no piece of the vocabulary has a blank
  after another character.

Special strings in a text are what the library's default makes of them; no begin or end
token is added, nothing is truncated or padded. The file is read on the driver and sent
to the workers; its size is that of a vocabulary.

Edge cases: a null or empty text has no bytes and no tokens; bytes that aren't UTF-8 count
as bytes and are replacement characters to the tokenizer; a long text without any safe
boundary goes whole; repeated rows and null ids each have a row; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_output import PATTERN

#: Bytes that go to the library at once, and characters of a text above which it is cut.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
#: Tokens above which a text is over the limit.
LIMIT = 512

#: Safe boundaries of byte-level and word-level tokenizers.
WORD_CUT = re.compile("(?<=[^\\s\\x00-\\x20\\x7f-\\xa0\\u180e])(?=[ \\n\\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\\u4e00-\\u9fa5\\u3041-\\u3096])(?=[\\u3001\\u3002\\uff0c\\uff01\\uff1f])")
#: Safe boundaries of piece tokenizers; the blank is left out.
BLANK_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def pieces(text: str, cut: re.Pattern[str] | None, most: int = PIECE_CHARS) -> Iterator[str]:
    """A text in parts of at most so many characters, as far as it has boundaries."""
    if cut is None or len(text) <= most:
        yield text
        return
    start, end, after = 0, 0, 0  # of the open part; the last boundary in it, and where the next part would begin
    for m in cut.finditer(text):
        if m.start() - start > most and end > start:
            yield text[start:end]
            start = after
        end, after = m.start(), m.end()
    if len(text) - start > most and end > start:
        yield text[start:end]
        start = after
    yield text[start:]


def _json_can_split(form: dict) -> bool:
    """Whether ``WORD_CUT`` is safe for a file: what it normalizes and how it cuts words is known, and special strings can't lie across."""
    for token in form.get("added_tokens") or ():
        if token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(r"[\s0-9]", token["content"]):
            return False
    normal, cutter = form.get("normalizer"), form.get("pre_tokenizer") or {}
    steps = (normal or {}).get("normalizers", [normal] if normal else [])
    if any(s["type"] not in ("NFC", "Lowercase") and not (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps):
        return False
    first = cutter.get("pretokenizers", [cutter])[0]
    if first.get("type") == "ByteLevel":
        return bool(first.get("use_regex")) and not first.get("add_prefix_space")
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # letters, single digits, other characters; white space is dropped
    return first.get("type") == "Split" and first.get("pattern") == {"Regex": pattern} and first.get("behavior") == "Removed" and bool(first.get("invert"))


class Counter:
    """Numbers of tokens under one tokenizer file."""

    def __init__(self, kind: str, data: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.cut: re.Pattern[str] | None = WORD_CUT
        self.encode: Callable[[list[str]], list]
        if kind == "json":
            import tokenizers

            made = tokenizers.Tokenizer.from_buffer(data)
            made.no_truncation()
            made.no_padding()
            self.encode = lambda texts: made.encode_batch_fast(texts, add_special_tokens=False)
            if not _json_can_split(json.loads(data)):
                self.cut = None
        elif kind == "model":
            import sentencepiece

            held = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: held.encode(texts, num_threads=1)
            across = any(re.search("[^▁]▁", held.id_to_piece(i)) for i in range(held.get_piece_size()))
            self.cut = None if across else BLANK_CUT
        elif kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            raise ValueError(f"no tokenizer library for files of kind {kind!r}")

    def counts(self, texts: Iterator[str], n: int, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> np.ndarray:
        """The number of tokens of each of n texts."""
        found, rows, batch, held = np.zeros(n, np.int64), [], [], 0

        def flush() -> None:
            np.add.at(found, rows, [len(x) for x in self.encode(batch)])
            rows.clear()
            batch.clear()

        for row, text in enumerate(texts):
            for piece in pieces(text, self.cut, piece_chars) if text else ():
                if batch and held + len(piece) > batch_bytes:
                    flush()
                    held = 0
                rows.append(row)
                batch.append(piece)
                held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if batch:
            flush()
        return found


_made: dict[bytes, Counter] = {}


def counter_of(kind: str, data: bytes) -> Counter:
    """The counter of a file, made once a Python worker."""
    digest = hashlib.sha256(data).digest()
    if digest not in _made:
        _made.clear()
        _made[digest] = Counter(kind, data)
    return _made[digest]


def _texts(array: pa.Array, rows: int = common.TEXTS_PER_SLICE) -> Iterator[str]:
    """The texts of an array, few of them as Python objects at a time."""
    array = array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary())
    for first in range(0, len(array), rows):
        for value in array.slice(first, rows):
            yield (value.as_py() or b"").decode("utf-8", "replace")


def _file(spark: SparkSession, path: str) -> bytes:
    """A tokenizer file, read once on the driver, from any store that Spark reaches."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a document: its id, ``n_bytes``, ``n_tokens``, and whether it is ``over_limit``."""
    spark = docs.sparkSession
    kind, data = tokenizer.rpartition(".")[2], spark.sparkContext.broadcast(_file(spark, tokenizer))

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter_of(kind, data.value)
        for array in batches:
            yield pa.array(own.counts(_texts(array), len(array)), pa.int64())

    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    counted = rows.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), lengths("_text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
