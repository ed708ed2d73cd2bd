"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans come from ``split`` and ``regexp_extract_all`` over the same pattern: the lengths
of the pieces between matches and of the matches give each match's place in code points,
by sums of sums of short blocks.
The hash of each candidate's secret is then aggregated over the corpus by distinct
repositories and owners (first by both, so that a secret copied everywhere is summed
before it is shuffled): one that many owners hold is a copied example, others look live.
Many are ``MIN_OWNERS``, or half of all owners of the corpus where there are fewer.

Edge cases: a null text is empty; a null repository or owner counts as one of its own;
repeated rows are each answered, and count once in the frequencies; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    """A kind of secret: pattern, group that holds the secret, least length of it."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds. A match whose secret is too short is dropped, not retried.
#: In the last two a run shorter than the least length holds no other match, so the length is in the pattern.
BASE_KINDS = (
    Kind("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16, True),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, True),
)
#: The method's own kinds: public token formats.
KINDS = (
    *BASE_KINDS,
    Kind("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Kind("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}"),
)

#: A secret that so many owners hold is a widely copied example; so is one that half of all owners hold, two at least.
MIN_OWNERS, LEAST_OWNERS = 5, 2

#: Steps that are summed one after the other: a match costs so much, not as many as the text has.
RUN = 128

SPAN = "array<struct<kind:string,rank:int,start:bigint,end:bigint,value:string>>"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sums_before(steps: Column, start: Column) -> Column:
    """For each step the start and all earlier steps; each round copies what it has, so the steps are few."""
    zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(steps, zero, lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def running_sums(steps: Column) -> Column:
    """For each step the sum of all earlier ones: by blocks of ``RUN`` steps, whose own sums are summed first."""
    zero = F.lit(0).cast("long")

    def by_blocks(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int"))
        block = lambda k: F.slice(s, k * RUN + 1, F.lit(RUN))
        totals = F.transform(blocks, lambda k: F.aggregate(block(k), zero, lambda a, x: a + x))
        inside = lambda bases: F.flatten(F.transform(blocks, lambda k: _sums_before(block(k), F.get(bases, k))))
        return F.when(F.size(s) > 0, _bound(_sums_before(totals, zero), inside)).otherwise(F.array().cast("array<bigint>"))

    return _bound(steps, by_blocks)


def spans(text: Column, kind: Kind, rank: int) -> Column:
    """All matches of one kind: leftmost, non-overlapping, long enough; places in code points.

    The work is in proportion to the text, and to the matches times ``RUN``.
    """
    one = F.lit(kind.pattern)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))

    def placed(m: Column) -> Column:
        # the gap before a match belongs to the match's own step, and is taken back from the sum that comes after it
        steps = F.zip_with(m["gaps"], m["lengths"], lambda g, n: g + n)
        ends = F.zip_with(running_sums(steps), steps, lambda before, step: before + step)
        found = F.zip_with(
            F.arrays_zip(ends.alias("end"), m["lengths"].alias("n")),
            m["values"],
            lambda p, v: F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), (p["end"] - p["n"]).alias("start"), p["end"].alias("end"), v.alias("value")),
        )
        return F.filter(found, lambda x: F.length(x["value"]) >= kind.least)

    matches = F.regexp_extract_all(text, one, F.lit(0))
    both = _bound(matches, lambda xs: F.struct(
        lengths(xs).alias("lengths"), F.slice(lengths(F.split(text, kind.pattern)), F.lit(1), F.size(xs)).alias("gaps"),
        (xs if kind.group == 0 else F.regexp_extract_all(text, one, F.lit(kind.group))).alias("values"),
    ))
    return F.when(text.rlike(kind.pattern), _bound(both, placed)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def in_order(found: Column) -> Column:
    """Spans by start, then by kind as listed."""
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each secret's hash; candidates: secret, repository, owner."""
    once = candidates.select("secret", "repository", "owner").distinct()
    by_owner = once.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan_secrets(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", repository: str = "doc_id", owner: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """Per document: ``spans`` in order (with their secrets), and how many distinct secrets look live or copied."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    rows = rows.withColumn("spans", in_order(F.concat(*[spans(F.col("text"), k, i) for i, k in enumerate(kinds)]))).drop("text")
    # two 64-bit hashes: equal rows share a key, and no others
    content = ("id", "repository", "owner", F.to_json("spans"))
    rows = common.cut(rows.withColumns({"key": F.xxhash64(*content), "key2": F.xxhash64(F.lit("again"), *content)}))
    held = rows.filter(F.size("spans") > 0).select("key", "key2", "repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("secret"))
    all_owners = rows.agg(F.countDistinct("owner") + F.max(F.col("owner").isNull().cast("int"))).first()[0] or 0
    cut = min(min_owners, max(LEAST_OWNERS, -(-all_owners // 2)))
    known = common.cut(ownership(held.select("secret", "repository", "owner")))
    judged = held.select("key", "key2", "secret").distinct().join(known, "secret").groupBy("key", "key2").agg(F.count_if(F.col("owners") < cut).alias("n_live"), F.count_if(F.col("owners") >= cut).alias("n_copied"), F.max("owners").alias("most_owners"))
    out = rows.join(judged, ["key", "key2"], "left")
    return out.select(F.col("id").alias(id_col), "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_owners")])
