"""Quality rules: distribution divergence, in DataFrame functions only.

Each document's character-class and common-word histograms are compared with those of
its language, pooled over the whole corpus, by the Jensen-Shannon distance (base 2, 0 to
1). Documents below a minimum length keep the benefit of the doubt: a short text has no
stable histogram. The texts are read once; what is kept of each is a narrow row of
counts, checkpointed, from which the references (one row a listed language, and one for
all others) and then the distances are made.

Edge cases: a null text has no words; a null or unlisted language is held against the
characters of all languages, and has no common words to compare; a reference without any text gives no distance, and only the base rule
counts; repeated rows are each answered; an empty table gives an empty result. Repeated
three-word windows are found by 64-bit hashes of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Frequent function words of each language with a reference of its own.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that"),
    "de": ("der", "die", "und", "das", "nicht", "mit"),
    "fr": ("le", "de", "et", "les", "des", "que"),
    "es": ("el", "de", "la", "los", "que", "por"),
}
#: Character classes, stripped one after the other; "other" is what remains.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "wide": "[^\\x00-\\x7F]+", "mark": "[.,;:!?'\"()-]+"}
SYMBOLS = "[#*$%&|<>]"

MIN_CHARS, MIN_WORDS = 200, 40
#: A text without any common word is at 0.24 to 0.27 from its language's reference, so a word limit above that never fires.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.24


def words(text: Column) -> Column:
    """The words of a text: white space other than blanks is turned into blanks, for Spark's fast split."""
    return F.array_remove(F.split(F.regexp_replace(text, "[\\x09-\\x0D]", " "), " "), "")


def _windows() -> Column:
    """64-bit hashes of all three-word windows, from ``_words``, by their first word."""
    one = F.col("_hashes")
    two = F.zip_with(F.slice(one, F.lit(1), F.size(one) - 1), F.slice(one, F.lit(2), F.size(one) - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(one) >= 3, F.zip_with(F.slice(two, F.lit(1), F.size(one) - 2), F.slice(one, F.lit(3), F.size(one) - 2), lambda a, b: F.xxhash64(a, b)))


def _repeat_words() -> Column:
    """Words covered by a three-word window that occurs twice or more; ``_sorted`` has (hash, position)."""
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(at, zero, step, lambda a: a["n"]).cast("long")


def document_stats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of the base rules, character classes and its language's common words."""
    listed = list(COMMON_WORDS)
    d = docs.select(F.col(id_col), F.when(F.col("lang").isin(listed), F.col("lang")).otherwise(F.lit("")).alias("_lang"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.withColumn("_words", words(F.col("_text")))
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_joined": F.array_join("_words", ""),
        "_padded": F.when(F.col("_lang") != "", F.lower(F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")))),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    d = d.withColumn("_windows", _windows())
    # most texts repeat no window; only the others are sorted
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    left, rest = "_joined", {}
    for name, pattern in CLASSES.items():
        d = d.withColumn(f"_after_{name}", F.regexp_replace(left, pattern, ""))
        rest[f"c_{name}"] = (F.length(left) - F.length(f"_after_{name}")).cast("long")
        left = f"_after_{name}"
    hits = {}
    for k in range(max(map(len, COMMON_WORDS.values()))):
        hit = F.lit(0)
        for lang, listed_words in COMMON_WORDS.items():
            if k < len(listed_words):
                w = listed_words[k]
                hit = F.when(F.col("_lang") == lang, ((F.octet_length("_padded") - F.octet_length(F.replace(F.col("_padded"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int")).otherwise(hit)
        hits[f"w_{k}"] = hit.cast("long")
    return d.select(
        id_col,
        "_lang",
        "n_words",
        F.length("_joined").cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(), F.lit(0)).alias("n_repeat_words"),
        *[v.alias(k) for k, v in rest.items()],
        F.length(left).cast("long").alias("c_other"),
        *[v.alias(k) for k, v in hits.items()],
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2; null if either is null."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Counts, base rule, both distances and the verdict of each document.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows.
    ``kept``: false if that failed, or if the text is long enough for its histograms and a distance is above its limit.
    """
    stats = common.cut(document_stats(docs, id_col))
    classes = [c for c in stats.columns if c.startswith("c_")]
    words = [c for c in stats.columns if c.startswith("w_")]
    sums = stats.groupBy("_lang").agg(*[F.sum(c).alias(c) for c in (*classes, *words, "n_words")]).collect()  # one row a listed language, and one
    total = {c: sum(r[c] for r in sums) for c in (*classes, *words, "n_words")}
    by_lang = {r["_lang"]: r.asDict() for r in sums} | {"": total}

    def shares(r: dict, cols: list[str], rest: str | None) -> list[float] | None:
        n = r[rest] if rest else sum(r[c] for c in cols)
        counts = [r[c] for c in cols] + ([n - sum(r[c] for c in cols)] if rest else [])
        return [x / n for x in counts] if n else None

    def reference(cols: list[str], rest: str | None) -> Column:
        out = F.lit(None).cast("array<double>")
        for lang, r in sorted(by_lang.items()):
            if (q := shares(r, cols, rest)) is not None:
                out = F.when(F.col("_lang") == lang, F.array(*[F.lit(float(x)) for x in q])).otherwise(out)
        return out

    class_n = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    word_n = sum((F.col(c) for c in words[1:]), F.col(words[0]))
    p_class = F.when(class_n > 0, F.array(*[F.col(c) / class_n for c in classes]))
    p_word = F.when((F.col("n_words") > 0) & (F.col("_lang") != ""), F.array(*[F.col(c) / F.col("n_words") for c in words], (F.col("n_words") - word_n) / F.col("n_words")))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    long_enough = (F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    out = stats.withColumns({"js_classes": js_distance(p_class, reference(classes, None)), "js_words": js_distance(p_word, reference(words, "n_words")), "base_failed": base_failed})
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(long_enough & (far("js_classes", max_class) | far("js_words", max_word)))).alias("kept"),
        F.round("js_classes", 4).alias("js_classes"), F.round("js_words", 4).alias("js_words"),
    )
