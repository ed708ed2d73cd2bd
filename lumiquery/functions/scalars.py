"""Scalar functions: text keys, safe numbers, unit conversions and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column) -> Column:
    """Number or null: what is no number, NaN included, is null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """Null for infinite and NaN values."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def solvent_key(c: Column) -> Column:
    """Trimmed, lower-case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def alnum_key(c: Column) -> Column:
    """Letters and digits only, lower-case."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\p{Alnum}]", "")


def first_number(c: Column) -> Column:
    """First signed decimal number in a text, null without any."""
    return safe_double(F.regexp_extract(c, r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", 0))


def non_blank(c: Column) -> Column:
    """Neither null nor only white space."""
    return c.isNotNull() & (F.trim(c) != "")


def contains_ci(c: Column, part: str) -> Column:
    """Case-insensitive substring test; null is false."""
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def job_id(c: Column) -> Column:
    """Number of a submitted batch job, null without one."""
    found = F.regexp_extract(c, r"Submitted batch job (\S+)", 1)
    return F.when(found != "", found)


def file_label(c: Column) -> Column:
    """File name without folder and extension, underscores as blanks."""
    return F.replace(F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" "))


def shorten(c: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where cut; pipes escaped for tables."""
    cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def sorted_list(c: Column, sep: str = ",") -> Column:
    """Aggregate: the distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def significant(c: Column, digits: int = 6) -> Column:
    """Rounded to significant digits, so equal measurements group together."""
    scale = F.floor(F.log10(F.abs(c))).cast("int")
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - scale)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * power, 0) / power)


def log10_positive(c: Column) -> Column:
    """log10 of positive values, else null."""
    return F.when(c > 0, F.log10(c))


def nm_to_ev(c: Column) -> Column:
    """Photon energy of a wavelength; null unless it is finite and positive."""
    return F.when((c > 0) & (c < float("inf")), F.lit(1240.0) / c)


def ev_to_nm(c: Column) -> Column:
    """Wavelength of a photon energy, which is clamped above zero."""
    return F.lit(1240.0) / F.greatest(c, F.lit(1e-6))


def logit(c: Column) -> Column:
    """Log odds, clamped away from 0 and 1."""
    p = clip(c, 1e-5, 1 - 1e-5)
    return F.ln(p / (1 - p))


def inverse_logit(c: Column) -> Column:
    """Probability of log odds."""
    return 1 / (1 + F.exp(-c))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limited to a range."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def threshold_score(c: Column, good: float, bad: float) -> Column:
    """1 up to good, 0 from bad, linear between; 0.5 if missing."""
    return F.when(c.isNull(), 0.5).when(c <= good, 1.0).when(c >= bad, 0.0).otherwise(1.0 - (c - good) / (bad - good))


def candidate_score(emission: Column, target: float | Column, quantum_yield: Column) -> Column:
    """Nearness to the target wavelength, plus 200 times the quantum yield."""
    return -F.abs(emission - target) + 200 * quantum_yield


def brightness(quantum_yield: Column, log_extinction: Column) -> Column:
    """Quantum yield times extinction, null without extinction."""
    return quantum_yield * F.pow(F.lit(10.0), log_extinction)


def domain_score(similarity: Column, scaffold_seen: Column, solvent_seen: Column) -> Column:
    """Weighted sum of similarity and seen flags, from 0 to 1."""
    return clip(0.6 * similarity + 0.25 * scaffold_seen.cast("double") + 0.15 * solvent_seen.cast("double"))


def out_of_domain(similarity: Column, threshold: float) -> Column:
    """True if the similarity is missing or under the threshold."""
    return similarity.isNull() | (similarity < threshold)


def uncertainty_caution(emission_std: Column, yield_std: Column) -> Column:
    """Whether an ensemble's spread calls for caution."""
    return F.coalesce(emission_std >= 50.0, F.lit(False)) | F.coalesce(yield_std >= 0.20, F.lit(False))


def confidence_level(similarity: Column, scaffold_seen: Column, solvent_seen: Column, imputed: Column, caution: Column) -> Column:
    """High, Medium or Low; a caution takes one level off."""
    high = scaffold_seen & (similarity >= 0.60) & solvent_seen & ~imputed
    medium = (similarity >= 0.40) & solvent_seen & ~imputed
    level = F.when(high, 2).when(medium, 1).otherwise(0) - caution.cast("int")
    return F.when(level >= 2, "High").when(level == 1, "Medium").otherwise("Low")


def low_reasons(similarity: Column, scaffold_seen: Column, solvent_seen: Column, imputed: Column) -> Column:
    """Why a confidence is low, comma-joined."""
    return F.concat_ws(
        ", ",
        F.when(similarity < 0.40, "low similarity"),
        F.when(~scaffold_seen, "new scaffold"),
        F.when(~solvent_seen, "unknown solvent"),
        F.when(imputed, "imputed descriptors"),
    )


def tanimoto(a: Column, b: Column) -> Column:
    """Shared on-bits over all on-bits of two bit lists; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def tanimoto_packed(a: Column, b: Column) -> Column:
    """The same for bits packed into one long."""
    return F.coalesce(F.try_divide(F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))), F.lit(0.0))


def one_hot(value: Column, choices: list[str]) -> Column:
    """Array of 0 and 1 with a last place for unknown values."""
    known = value.isin(choices)
    return F.array(*[F.coalesce((value == c).cast("int"), F.lit(0)) for c in choices], F.when(F.coalesce(known, F.lit(False)), 0).otherwise(1))
