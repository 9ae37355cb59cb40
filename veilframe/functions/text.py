"""Length-preserving text views and comparison keys as column expressions (ASCII classes, code-point offsets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that readers produce in place of digits, and the digits they stand for.
CONFUSED = "OoQDUIl|i!LJZzEASsGbTBgq"
DIGITS = "000001111111223455667899"
CAPITALS = r"\b[A-Z][A-Z'\-]+\b"


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of ``pattern``, and the matches; matches are never empty."""
    return F.split(text, f"({pattern})", -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def replace_each(text: Column, pattern: str, by) -> Column:
    """``text`` with each match replaced by a column expression of it; Spark's regexp_replace has no callback."""
    between, hits = pieces(text, pattern)
    # one piece more than there are matches
    return F.array_join(F.zip_with(between, F.transform(hits, by), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def titlecase_capitals(text: Column) -> Column:
    return replace_each(text, CAPITALS, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2)))))


def ocr_normalise(text: Column) -> Column:
    """Digits for letters in words that are at least half digits."""

    def fix(w: Column) -> Column:
        digits, letters = (F.length(F.regexp_replace(w, p, "")) for p in ("[^0-9]", "[^A-Za-z0-9]"))
        return F.when((letters > 0) & (2 * digits >= letters), F.translate(w, CONFUSED, DIGITS)).otherwise(w)

    return replace_each(text, r"\S+", fix)


def match_key(text: Column) -> Column:
    """Comparison key of ASCII text; ``match_key_exact`` in operators.keys also folds other scripts."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_]+", ""))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def line_prefix(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters before the 0-based ``start`` on the same line."""
    line = F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)
    return F.substr(line, F.greatest(F.lit(1), F.length(line) - (width - 1)), F.lit(width))


def line_suffix(text: Column, end: Column, width: int) -> Column:
    """Up to ``width`` characters from the 0-based ``end`` on, on the same line."""
    return F.substr(F.substring_index(F.substr(text, end + 1), "\n", 1), F.lit(1), F.lit(width))


def apply_case(value: Column, template: Column) -> Column:
    lettered = F.upper(template) != F.lower(template)
    return F.when(lettered & (template == F.upper(template)) & (F.length(template) > 1), F.upper(value)).when(lettered & (template == F.lower(template)), F.lower(value)).otherwise(value)


def split_name(token: Column) -> Column:
    """prefix, core and suffix of a name token; a possessive and a final dot go to the suffix."""
    shape = r"^([^\p{L}]*)(.*?)((?:['’]s)?[^\p{L}]*)$"
    return F.struct(*[F.regexp_extract(token, shape, i + 1).alias(n) for i, n in enumerate(("prefix", "core", "suffix"))])
