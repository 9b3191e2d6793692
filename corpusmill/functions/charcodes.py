"""A native character tokenizer: no external library, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import characters

END = 0


def char_ids(c: Column) -> Column:
    """One id from 1 to 26 for each code point."""
    return F.transform(characters(c), lambda x: F.least(F.ascii(x) % 27 + 1, F.lit(26)))


def with_end(ids: Column) -> Column:
    return F.array_append(ids, F.lit(END))
