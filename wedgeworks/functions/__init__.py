"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precedes(a_degree: str, a: str, b_degree: str, b: str) -> Column:
    """Whether vertex a comes before b in order of (degree, id): a strict total order."""
    return (F.col(a_degree) < F.col(b_degree)) | ((F.col(a_degree) == F.col(b_degree)) & (F.col(a) < F.col(b)))


def common(a: str, b: str) -> Column:
    """How many elements two neighbour arrays share."""
    return F.size(F.array_intersect(a, b)).cast("long")


def search_steps(longer: Column) -> Column:
    """Probes of a binary search in a list of that length: bits of the length."""
    return F.when(longer > 0, F.length(F.bin(longer))).otherwise(0).cast("long")
