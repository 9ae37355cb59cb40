"""Documents to lines and tokens, and the line view with exact offsets.

Plain text has one page; lines are split at newlines and tokens at white space.  Blank lines yield no line but keep
their vertical place.  Boxes follow a fixed grid: x from 100, 25 per character, gap 20; y = 100 + 60 per line, 50 high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import before as before_words

X0, CHAR, GAP, Y0, LINE, HEIGHT = 100, 25, 20, 100, 60, 50


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, word_no, token_id, text, start, end, x0, y0, x1, y1); start and end in the line view.

    Words of a line and lines of a document are arrays until the end, so there is no shuffle.
    """
    words = F.filter(F.split(F.col("line.text"), r"\s+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("row"), x.alias("text"))), lambda s: F.trim(F.regexp_replace(s["text"], r"\s+", " ")) != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("line_no", "line")).select("doc_id", "line_no", F.col("line.row").alias("row"), words.alias("words"))
    # a line's length in the view is its words' and the spaces between them; lines follow after a newline
    length = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) + F.size("words") - 1
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("length", length).withColumn("line_start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)))
    placed = F.zip_with("words", before_words(F.transform("words", lambda w: F.length(w))), lambda w, a: F.struct(w.alias("word"), a.alias("ahead")))
    rows = rows.select("*", F.posexplode(placed).alias("word_no", "placed")).select("*", "placed.word", "placed.ahead")
    rows = rows.withColumn("start", (F.col("line_start") + F.col("ahead") + F.col("word_no")).cast("int"))
    size = F.length("word")
    x0 = X0 + CHAR * F.col("ahead") + GAP * F.col("word_no")
    y0 = Y0 + LINE * F.col("row")
    return rows.select(
        "doc_id", F.lit(0).alias("page"), "line_no", "word_no", token_id(F.lit(0), F.col("line_no"), F.col("word_no")).alias("token_id"), F.col("word").alias("text"),
        "start", (F.col("start") + size).alias("end"), x0.alias("x0"), y0.alias("y0"), (x0 + CHAR * size).alias("x1"), (y0 + HEIGHT).alias("y1"),
    )


def token_id(page: Column, line: Column, word: Column) -> Column:
    return F.format_string("p%04d.l%04d.w%03d", page, line, word)


def line_view(docs: DataFrame) -> DataFrame:
    """(doc_id, text): tokens joined by spaces, lines by newlines, without blank lines.  No shuffle."""
    line = lambda x: F.array_join(F.filter(F.split(x, r"\s+"), lambda w: w != ""), " ")
    return docs.select("doc_id", F.array_join(F.filter(F.transform(F.split("text", "\n"), line), lambda x: x != ""), "\n").alias("text"))


def to_token_ranges(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """``candidates`` with the first and last index of the tokens they overlap; a range join within a document."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    indexed = tokens.select(F.col("doc_id").alias("d"), index.alias("i"), F.col("start").alias("s"), F.col("end").alias("e"))
    keyed = candidates.withColumn("cand", F.xxhash64(*candidates.columns))
    joined = keyed.join(indexed, (F.col("doc_id") == F.col("d")) & (F.col("e") > F.col("start")) & (F.col("s") < F.col("end")))
    return joined.groupBy(*keyed.columns).agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("cand")
