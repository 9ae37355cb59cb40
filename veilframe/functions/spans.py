"""Where patterns match: 0-based code-point spans from native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import before, let


def spans(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, value) for the matches of a pattern that never matches the empty string.

    The i-th match begins after the first i + 1 pieces between matches and the first i matches.
    """
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def placed(hits: Column) -> Column:
        # the same groups as in the hits, so that back-references count alike
        gaps = F.transform(F.slice(F.split(text, f"({pattern})", -1), F.lit(1), F.size(hits)), lambda g: F.length(g))
        return let(gaps, lambda g: F.zip_with(F.zip_with(before(F.zip_with(g, hits, lambda x, h: x + F.length(h))), g, lambda a, x: a + x), hits, _span))

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits)))


def _span(begin: Column, hit: Column) -> Column:
    return F.struct(begin.alias("start"), (begin + F.length(hit)).alias("end"), hit.alias("value"))
