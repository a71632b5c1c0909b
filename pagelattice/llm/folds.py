"""The fold of a row, by its id alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 by FOLDS; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def learns(key: str = "doc_id") -> Column:
    """Rows that a model may learn from."""
    return F.col(key).isNotNull() & ~held_out(key)


def share(key: str = "doc_id") -> Column:
    """A number from 0 to 999,999 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000))
