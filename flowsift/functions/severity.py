"""Severity names, ranks and probability bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity ranks, mildest first.
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# Lowest probability of each band, gravest first.
BANDS = [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM")]


def probability_band(p: Column) -> Column:
    out = F
    for low, name in BANDS:
        out = out.when(p >= low, name)
    return out.otherwise("LOW")


def band_rank(p: Column) -> Column:
    """Rank of the probability band, without a comparison of names (see ``rank_of``)."""
    out = F
    for low, name in BANDS:
        out = out.when(p >= low, RANKS[name])
    return out.otherwise(RANKS["LOW"])


def rank_of(name: str | None) -> int:
    """Rank of a known severity name, as ``rank`` gives it.

    The optimizer would take ``rank`` of a literal in the driver, and the first UPPER of a JVM builds ICU's table of case
    mappings: some 5 GB of short-lived objects, for which the driver's heap grows.
    """
    return RANKS.get((name or "").upper(), 1)


def rank(name: Column) -> Column:
    """Rank of a severity name; unknown names (also NONE) rank with LOW."""
    out = F
    for severity, number in RANKS.items():
        out = out.when(F.upper(name) == severity, number)
    return out.otherwise(1)


def name_of(number: Column) -> Column:
    out = F
    for severity, n in RANKS.items():
        out = out.when(number == n, severity)
    return out
