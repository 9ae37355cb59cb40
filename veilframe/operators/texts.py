"""Places in texts: tokens at offsets, trimmed spans, neighbours on a line, pronouns after a mention, content ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..document.words import POSTCODE_LEADS, STATE_NAMES, STREET_WORDS
from ..functions.text import ocr_normalise, titlecase_capitals

# Punctuation that isn't part of a span, tokens beside a mention, and characters after it.
EDGE = " \t,;:.()[]{}\"'"
BEFORE, AFTER, PRONOUNS = 3, 4, 240
_EDGE = r"[ \t,;:.()\[\]{}\"']"


def token_at(offsets: DataFrame, tokens: DataFrame) -> DataFrame:
    """``offsets`` (doc_id, offset) with the word_no and line_no of the token that holds it; null between tokens."""
    t = tokens.select(F.col("doc_id").alias("t_doc_id"), "line_no", "word_no", F.col("start").alias("s"), F.col("end").alias("e"))
    return offsets.join(t, (F.col("doc_id") == F.col("t_doc_id")) & (F.col("offset") >= F.col("s")) & (F.col("offset") < F.col("e")), "left").drop("t_doc_id", "s", "e")


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, line, titlecase, digits, same): a text's views, and whether all have its length, as offsets ask for."""
    rows = docs.select("doc_id", F.col("text").alias("line"), titlecase_capitals(F.col("text")).alias("titlecase"), ocr_normalise(F.col("text")).alias("digits"))
    return rows.withColumn("same", (F.length("line") == F.length("titlecase")) & (F.length("line") == F.length("digits")))


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the span without punctuation at its ends; an empty one where nothing else is in it."""
    inner = F.substr(text, start + 1, end - start)
    left = F.length(F.regexp_extract(inner, f"^({_EDGE}*)", 1))
    right = F.length(F.regexp_extract(inner, f"({_EDGE}*)$", 1))
    whole = left == F.length(inner)
    return F.struct((start + F.when(whole, 0).otherwise(left)).cast("int").alias("start"), F.when(whole, start).otherwise(end - right).cast("int").alias("end"))


def neighbours(tokens: DataFrame) -> DataFrame:
    """``tokens`` with the text of the three tokens before and the four after on their line, and the line's."""
    line = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    text = lambda w: F.array_join(F.collect_list("text").over(w), " ")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tokens.withColumn("before", text(line.rowsBetween(-BEFORE, -1))).withColumn("after", text(line.rowsBetween(1, AFTER))).withColumn("line", text(whole))


def pronoun_gender(after: Column) -> Column:
    """m or f by which pronouns are more frequent in the 240 characters after a mention, else u."""
    window = F.substring(after, 1, PRONOUNS)
    count = lambda p: F.size(F.regexp_extract_all(window, F.lit(rf"(?i)\b(?:{p})\b"), F.lit(0)))
    he, she = count("he|him|his|himself"), count("she|her|hers|herself")
    return F.when(he > she, "m").when(she > he, "f").otherwise("u")


def canonical_state(word: Column) -> Column:
    """A state's short form, null for other words."""
    names = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_replace(F.trim(word), r"^[ ,]+|[ ,.]+$", "")))


def is_street_type(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[ ,.]+|[ ,.]+$", "")).isin(*sorted(STREET_WORDS))


def postcode_fits(state: Column, postcode: Column) -> Column:
    leads = F.create_map(*[F.lit(x) for kv in POSTCODE_LEADS.items() for x in kv])
    return F.startswith(postcode, F.try_element_at(leads, state))


def _content_id(kind: pd.Series, *parts: pd.Series) -> pd.Series:
    out = []
    for row in zip(kind, *parts, strict=True):
        digest = hashlib.blake2b(digest_size=12)
        for part in row:
            data = (b"n" if part is None else b"s" + str(part).encode())
            digest.update(len(data).to_bytes(8, "big") + data)
        out.append(f"{row[0]}{digest.hexdigest()}")
    return pd.Series(out)


def content_id(kind: Column, *parts: Column) -> Column:
    """A kind's letter and 96 bits of a hash of the parts; lengths and types tell neighbouring parts apart."""
    return F.pandas_udf(_content_id, "string")(kind, *[p.cast("string") for p in parts])
