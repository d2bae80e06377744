"""Text expressions on ASCII rules: only A-Z are lowered, only [a-z0-9] make words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def tokens(c: Column) -> Column:
    """Maximal runs of [a-z0-9] after lowering A-Z; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(tokens(c))


def n_pairs(c: Column) -> Column:
    """Adjacent character pairs inside words: the words' lengths less the number of words."""
    t = ascii_lower(F.coalesce(c, F.lit("")))
    return F.length(F.regexp_replace(t, "[^a-z0-9]+", "")) - F.size(tokens(c))


def timestamp_text(ts: Column) -> Column:
    """A time to the second; `unknown` where there is none or it is the epoch."""
    return F.coalesce(F.when(ts != F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")), F.lit("unknown"))
