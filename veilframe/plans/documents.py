"""Text views, tokens and the flagship query over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import spans
from ..operators import render, tokens
from ..operators.detectors import detect
from ..operators.fusion import fuse
from ..operators.policy import decide, number_labels
from ..sources.tables import table

#: The same e-mail addresses without look-around, as RE2 needs it; equal on this data.
EMAIL_RE2 = r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b"


def q_email_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: e-mail mentions that profile broad replaces by labels, and replaced values that survive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = fuse(detect(docs, ["email"])).where("accepted")
    mentions = found.join(docs.select("doc_id", "text"), "doc_id").withColumn("value", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    acted = number_labels(decide(mentions, "broad").where("action <> 'keep'"))
    left = render.leaks(acted, render.rebuild(docs, acted)).groupBy("doc_id").agg(F.count("*").alias("survive"))
    per = acted.groupBy("doc_id").agg(F.count("*").alias("replaced")).join(left, "doc_id", "left").join(docs.select("doc_id", "lang"), "doc_id")
    return per.groupBy("lang").agg(F.sum("replaced").alias("replaced"), F.sum(F.coalesce("survive", F.lit(0))).alias("surviving"))


def q_line_view_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = tokens.line_view(table(spark, sf_dir, "documents"))
    return view.select("doc_id", F.length("text").alias("view_length"), F.md5("text").alias("view_md5"))


def q_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokens(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start").alias("sum_start"), F.max("end").cast("int").alias("last_end"), F.max("x1").cast("int").alias("right_edge"))


def q_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose text isn't what the line view has at their offsets: none."""
    docs = table(spark, sf_dir, "documents")
    rows = tokens.tokens(docs).join(tokens.line_view(docs).withColumnRenamed("text", "view"), "doc_id")
    wrong = F.substr("view", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")
    return rows.groupBy("page").agg(F.count("*").alias("n_tokens"), F.count_if(wrong).alias("n_wrong"))


def q_titlecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all languages; RE2's word borders are those of ASCII, so a test compares with Python instead of SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.titlecase_capitals(F.col("text"))).alias("text_md5"))


def q_ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("concat('Ref ', translate(lpad(CAST(o_orderkey * 7919 AS STRING), 9, '0'), '0158', 'OlSB'), ' for ', o_orderpriority, ' A', CAST(o_orderkey % 100 AS STRING))")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.ocr_normalise(value).alias("normalised"))


def q_match_key_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.match_key(F.concat_ws(" - ", "c_name", "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), T.digits_only(F.col("c_name")).alias("digits"))


def q_line_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 characters before each e-mail address on its line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(spans(F.col("text"), EMAIL_RE2)).alias("s"))
    return docs.select("doc_id", F.col("s.value").alias("email"), T.line_prefix(F.col("text"), F.col("s.start"), 28).alias("prefix"))


QUERIES = {f.__name__: f for f in (q_email_by_language, q_line_view_lengths, q_token_offsets, q_token_order, q_titlecase, q_ocr_normalise, q_match_key_ascii, q_line_prefix)}

_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(" + _WORDS.format("x") + ", ' ')), lambda x: x <> '')"
ORACLE_SQL = {
    "q_email_by_language": f"""
        WITH e AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{EMAIL_RE2}') AS hits FROM documents)
        SELECT lang, CAST(sum(len(hits)) AS BIGINT) AS replaced, CAST(0 AS BIGINT) AS surviving FROM e WHERE len(hits) > 0 GROUP BY lang
    """,
    "q_line_view_lengths": f"SELECT doc_id, CAST(length(v) AS INTEGER) AS view_length, md5(v) AS view_md5 FROM (SELECT doc_id, array_to_string({_LINES}, chr(10)) AS v FROM documents)",
    "q_token_offsets": f"""
        WITH l AS (SELECT doc_id, row_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_no FROM documents)),
             w AS (SELECT doc_id, row_no, {_WORDS.format('line')} AS words FROM l),
             k AS (SELECT doc_id, row_no, words, length(array_to_string(words, ' ')) AS n FROM w WHERE len(words) > 0),
             s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_ FROM k),
             t AS (SELECT doc_id, off_ + length(array_to_string(words[1:i], ' ')) - length(words[i]) AS start_, off_ + length(array_to_string(words[1:i], ' ')) AS end_,
                          100 + 25 * (length(array_to_string(words[1:i], ''))) + 20 * (i - 1) AS x1
                   FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM s))
        SELECT doc_id, count(*) AS n_tokens, CAST(sum(start_) AS BIGINT) AS sum_start, CAST(max(end_) AS INTEGER) AS last_end, CAST(max(x1) AS INTEGER) AS right_edge FROM t GROUP BY doc_id
    """,
    "q_token_order": f"SELECT 0 AS page, CAST(sum(len({_WORDS.format('text')})) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_wrong FROM documents",
    "q_ocr_normalise": """
        WITH w AS (SELECT o_orderkey, o_orderpriority, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 9, '0') AS d FROM orders),
             t AS (SELECT *, translate(d, '0158', 'OlSB') AS m FROM w)
        SELECT o_orderkey, 'Ref ' || CASE WHEN 2 * length(regexp_replace(m, '[^0-9]', '', 'g')) >= 9 THEN d ELSE m END || ' for ' || o_orderpriority
               || CASE WHEN o_orderkey % 100 >= 0 THEN ' 4' ELSE '' END || CAST(o_orderkey % 100 AS VARCHAR) AS normalised FROM t
    """,
    "q_match_key_ascii": "SELECT c_custkey, lower(regexp_replace(c_name || ' - ' || c_mktsegment, '[^A-Za-z0-9_]+', '', 'g')) AS key, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer",
    "q_line_prefix": rf"""
        WITH p AS (SELECT doc_id, string_split_regex(text, '{EMAIL_RE2}') AS gaps, regexp_extract_all(text, '{EMAIL_RE2}') AS hits FROM documents),
             u AS (SELECT doc_id, hits[i] AS email, array_to_string(list_transform(gaps[1:i], lambda g, k: g || CASE WHEN k < i THEN hits[k] ELSE '' END), '') AS before
                   FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p))
        SELECT doc_id, email, right(string_split(before, chr(10))[-1], 28) AS prefix FROM u
    """,
}
