"""Chain identifiers of molecular complexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A to Z, then two letters; far more than a complex has.
LETTERS = [chr(65 + i) for i in range(26)]
NAMES = LETTERS + [a + b for a in LETTERS for b in LETTERS]


def chain_ids(n: Column, used: Column | None = None, start: int = 0) -> Column:
    """The first n free chain ids from position start on: A..Z, then AA, AB, ..; used is an array to leave out."""
    names = F.array(*map(F.lit, NAMES[start:]))
    free = F.array_except(names, used) if used is not None else names
    return F.slice(free, F.lit(1), n)
