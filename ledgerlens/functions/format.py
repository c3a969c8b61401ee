"""Formatting helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(x: Column) -> Column:
    """integer with ',' every three digits (Python ``{:,}``)."""
    return F.format_number(x.cast("long"), 0)


def percent_text(ratio: Column) -> Column:
    """``{ratio*100:.0f}`` (half-even on the binary value)."""
    return F.bround(ratio * 100, 0).cast("long").cast("string")


def sha256_hex(x: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(x, 256)
