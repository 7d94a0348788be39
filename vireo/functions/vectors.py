"""Expressions over descriptors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(score: Column) -> Column:
    return F.least(F.greatest((255 - score) / 255.0, F.lit(0.0)), F.lit(1.0))


def parse_vector(text: Column, length: int = 33) -> Column:
    """Base64 text to an array of bytes; null unless it has ``length`` of them."""
    raw = F.when(text.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0), F.unbase64(text))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(raw) == length, numbers)
