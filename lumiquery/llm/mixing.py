"""Mixing sources to target weights.

Sources weigh 5, 2, 1, repeating in code-point order (null last), and share a budget of
150 % of all words; no source gives more than twice its words, and what it can't give is
shared again by weight. Each document gets a hash-random key of its id and text; equal rows are
counted first, so that no key is hot. Within each source the documents are range-sorted
by the key, their sizes are prefix-summed in parts, and the source is cut at exactly its
budget: whole epochs first, then the documents before the cut.

The texts are read once, for the sizes; everything after is narrow rows. The document
at the cut gives the part that fits, so a source's words are its target to the word.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its
own; rows that share an id, or have none, are documents of their own, each with its own
part; equal rows are counted out one after the other; columns of any name are kept as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from . import common

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Equal rows are counted out in runs of so many, so that no task holds all of them.
RUN = 1_000


def row_key(row_id: Column, text: Column) -> Column:
    """The hash-random key: rows with the same id and text share it, and no others."""
    blank = F.lit("")
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), blank), F.lit("|"), F.md5(F.coalesce(text, blank).cast("binary")), F.lit("|" + SEED)).cast("binary"))


def document_sizes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for equal ones (id, source and text): number of words, key, and how many rows they are; checkpointed."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(common.WORD_RE)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_key(F.col(id_col), F.col("text")).alias("key"))
    same = rows.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    return common.cut(same.withColumns({"h32": F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), "words": F.col("size") * F.col("n")}))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: rank, size, rows and target.

    Each target is min(most * size, level * weight) for the one level that spends the
    budget. Sources reach their limit in the order of size over weight, so prefix sums
    in that order give the level at each of them, and the first at which no further
    source is above its limit is it. Ranks and sums are running sums over range parts, so
    no task holds all sources, however many there are.
    """
    s = common.cut(sizes.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    s = running_sum(s, [F.col("source").asc_nulls_last()], F.lit(1), "_earlier").withColumn("rank", (F.col("_earlier") + 1).cast("int")).drop("_earlier")
    s = common.cut(s.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights))).withColumn("_ratio", F.col("source_size") / F.col("weight")))
    total, all_weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [F.col("_ratio"), F.col("rank")]
    before = running_sum(running_sum(s, order, F.col("source_size"), "_full"), order, F.col("weight"), "_gone")
    level = (F.lit(share * total) - most * F.col("_full")) / (F.lit(all_weights) - F.col("_gone"))
    best = before.withColumn("_level", level).filter(F.col("_level") <= most * F.col("_ratio")).agg(F.min(F.struct(*order, "_level"))["_level"]).first()[0]
    most_words = (most * F.col("source_size")).cast("double")
    target = most_words if best is None else F.least(most_words, F.lit(best) * F.col("weight"))
    return s.select("source", "rank", "source_size", "source_rows", target.alias("target"))


def _shares(docs: DataFrame, id_col: str, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Equal rows with ``epochs``, how often each is taken whole, and ``rest``, the words that are taken of them beyond that."""
    sizes = document_sizes(docs, id_col)
    targets = common.cut(source_targets(sizes, weights, share, most))
    t = common.lookup(targets).withColumnRenamed("source", "_source")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = common.hash_order_prefix(rows, ["rank"], "words", "h32", ["key", "size"], "source_rows")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("_left", F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("before"))
    return rows.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("words"), F.col("_left"))).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per document: size, its source's size and target, and ``taken``, the words the mix takes of it.

    Equal rows are one row up to here; they are dealt out again in runs of ``RUN``.
    """
    rows = _shares(docs, id_col, weights, share, most)
    runs = rows.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("_k", F.explode(F.sequence(F.col("_first"), F.least(F.col("n"), F.col("_first") + RUN) - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_k") * F.col("size")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "key")


def source_cuts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a source: how often each document is taken, the first key that is not taken once more, and how many rows of that key are."""
    extra = F.ceil(F.col("rest") / F.col("size"))
    ends = F.when(extra < F.col("n"), F.struct("key", extra.alias("extra")))
    # documents without a word are never taken, so they decide nothing
    shares = _shares(docs, id_col, WEIGHTS, SHARE, MOST).filter("size > 0")
    found = shares.groupBy("source").agg(F.max("epochs").cast("int").alias("epochs"), F.min(ends).alias("end"))
    return common.cut(found.select(F.col("source").alias("_src"), "epochs", F.col("end.key").alias("cut"), F.col("end.extra").cast("long").alias("extra")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``.

    Keys of a source below its cut are taken once more than those above it, so a row
    needs only its source's cut: documents are read and written, and not shuffled.
    Documents stay whole: the one at a source's cut is given once more in full, so a
    source exceeds its budget by less than one document. Rows with equal id, source and
    text take turns; at the cut (one such group a source at most) the first of them by
    their other columns is given as often as words are left.
    """
    cuts = common.lookup(source_cuts(docs, id_col))
    sized = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(common.WORD_RE)) > 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col(id_col), F.col("text")).alias("key"), F.col("source").cast("string").alias("src"), sized.alias("sized"))
    rows = rows.filter("sized").join(cuts, F.col("src").eqNullSafe(F.col("_src")))
    again = F.when(F.col("cut").isNull() | (F.col("key") < F.col("cut")), 1).otherwise(0)
    taken = rows.withColumn("copies", F.col("epochs") + again).filter("copies > 0")
    out = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row")
    there = rows.filter("key = cut AND extra > 0")  # rows of one key a source
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    first = there.groupBy("src", "extra").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra") - 1, F.lit(RUN).cast("long")))).repartition("src", "run")
    out = out.unionByName(runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("extra"), F.col("run") + RUN) - 1))).select("row"))
    return out.select("row.*")
