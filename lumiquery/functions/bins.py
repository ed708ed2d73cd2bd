"""Binners: each is a ladder of cut points, as a CASE expression.

The reference engine has three binners of emission wavelengths with different cut
points and different treatment of missing values. They are kept apart by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the wavelength regions, in order.
REGIONS = ("UV", "blue", "green", "yellow/orange", "red/NIR")


@dataclass(frozen=True)
class Binner:
    """Ascending upper bounds (exclusive, or inclusive where listed), labels, label of a missing value."""

    cuts: tuple[float, ...]
    labels: tuple[str, ...]
    missing: str | None
    inclusive: frozenset[float] = frozenset()

    def label(self, value: Column) -> Column:
        """Label of a value."""
        out = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(self.missing))
        for cut, label in zip(self.cuts, self.labels, strict=False):
            out = out.when(value <= cut if cut in self.inclusive else value < cut, F.lit(label))
        return out.otherwise(F.lit(self.labels[len(self.cuts)] if len(self.labels) > len(self.cuts) else None))

    def rank(self, label: Column) -> Column:
        """Place of a label in the order of the bins; a missing value comes last."""
        out = F.when(F.lit(False), F.lit(0))
        for k, x in enumerate(self.labels):
            out = out.when(label == x, F.lit(k))
        return out.otherwise(F.lit(len(self.labels)))


#: Cut points of the three region binners.
EXPERIMENT = Binner((400, 500, 550, 600), REGIONS, "red/NIR")
ERROR = Binner((400, 480, 560, 620), REGIONS, "missing", frozenset({620}))
MANUSCRIPT = Binner((400, 500, 560, 620), REGIONS, "red/NIR")
#: Half-open bins of nearest-neighbour similarity.
SIMILARITY = Binner((0.30, 0.50, 0.70, 0.85, 1.000001), ("0.00-0.30", "0.30-0.50", "0.50-0.70", "0.70-0.85", "0.85-1.00"), None)
#: Confidence by similarity, and disagreement by range of the predictions.
CONFIDENCE = Binner((0.35, 0.50, 0.70), ("low", "low-medium", "medium", "high"), "unknown")
EMISSION_SPREAD = Binner((20, 60), ("low", "moderate", "high"), "unknown")
YIELD_SPREAD = Binner((0.10, 0.25), ("low", "moderate", "high"), "unknown")

CONFIDENCE_TEXT = {
    "high": "close to known molecules",
    "medium": "moderately close to known molecules",
    "low-medium": "weakly covered by known molecules",
    "low": "far from known molecules",
    "unknown": "similarity is not available",
}


def confidence_text(label: Column) -> Column:
    """A short text for a confidence label."""
    texts = F.create_map(*[F.lit(x) for kv in CONFIDENCE_TEXT.items() for x in kv])
    return F.coalesce(F.element_at(texts, label), F.lit(CONFIDENCE_TEXT["unknown"]))


def target_note(target: Column) -> Column:
    """Colour region of a screening target, within 25 nm."""
    out = F.when(F.lit(False), F.lit(""))
    for centre, name in ((450, "blue"), (520, "green"), (600, "orange/red")):
        out = out.when(F.abs(target - centre) <= 25, F.lit(name))
    return out


def better(a: Column, b: Column, a_name: str, b_name: str, lower: bool = True) -> Column:
    """Name of the better of two metrics; a missing one loses, equal ones tie."""
    wins = a < b if lower else a > b
    return (
        F.when(a.isNull() & b.isNull(), F.lit("tie")).when(a.isNull(), F.lit(b_name)).when(b.isNull(), F.lit(a_name))
        .when(a == b, F.lit("tie")).when(wins, F.lit(a_name)).otherwise(F.lit(b_name))
    )
