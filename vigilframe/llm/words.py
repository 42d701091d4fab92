"""Words of a text and other expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What lies between words.
NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words in order: runs of letters and digits in lower case.  Null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def plain_source(source: Column) -> Column:
    """A source's name without padding and case."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
