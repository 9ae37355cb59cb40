"""Dates by column expressions, and the key of the surrogates that ``document.surrogates`` draws.

The key travels only in a function's closure, never as a literal or a setting, so no plan or event log shows it.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOT = 30


def _year(two_or_four: Column) -> Column:
    n = two_or_four.cast("int")
    return F.when(F.length(two_or_four) == 4, n).when(n <= PIVOT, 2000 + n).otherwise(1900 + n)


def canonical_date(value: Column) -> Column:
    """Day-first numeric or ISO date as yyyy-MM-dd; null if it is none."""
    dmy = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    part = lambda i: F.regexp_extract(value, dmy, i)
    padded = F.concat_ws("-", _year(part(3)).cast("string"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).when(value.rlike(dmy), padded)
    return F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def shift_numeric_date(value: Column, days: int) -> Column:
    """A numeric or ISO date moved by ``days`` in its own layout; what is no date becomes [date]."""
    moved = F.date_add(F.to_date(canonical_date(value)), days)
    iso, dmy = r"^\d{4}-\d{2}-\d{2}$", r"^(\d{1,2})([/.\-])(\d{1,2})[/.\-](\d{4}|\d{2})$"
    part = lambda i: F.regexp_extract(value, dmy, i)
    day = F.when(F.length(part(1)) == 2, F.date_format(moved, "dd")).otherwise(F.dayofmonth(moved).cast("string"))
    month = F.when(F.length(part(3)) == 2, F.date_format(moved, "MM")).otherwise(F.month(moved).cast("string"))
    year = F.when(F.length(part(4)) == 4, F.date_format(moved, "yyyy")).otherwise(F.date_format(moved, "yy"))
    return F.coalesce(F.when(value.rlike(iso), F.date_format(moved, "yyyy-MM-dd")).when(value.rlike(dmy), F.concat(day, part(2), month, part(2), year)), F.lit("[date]"))


def master_key() -> bytes:
    """From VEILFRAME_KEY (hex, 32 bytes or more).  Without it VEILFRAME_DEVELOPMENT=1 asks for a fixed key by name."""
    text = os.environ.get("VEILFRAME_KEY")
    if not text and os.environ.get("VEILFRAME_DEVELOPMENT") != "1":
        raise ValueError("VEILFRAME_KEY isn't set")
    key = bytes.fromhex(text) if text else hashlib.sha256(b"veilframe development key").digest()
    if len(key) < 32:
        raise ValueError("the key is shorter than 32 bytes")
    return key
