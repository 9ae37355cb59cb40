"""Queries of places in texts, of files and their promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import texts as T
from ..operators.tokens import line_view, tokens
from ..sources import files as S
from ..sources.tables import table


def q_token_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document, the tokens at every 97th character of the line view."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = line_view(docs).where("text <> ''").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(97))).alias("offset"))
    return T.token_at(places, tokens(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count("word_no").alias("n_in_tokens"), F.sum("line_no").alias("lines"))


def q_view_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.views(table(spark, sf_dir, "documents")).groupBy("same").agg(F.count("*").alias("n"), F.sum(F.length("digits")).alias("length"))


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("text_md5"))


_SPAN = "concat('a (', repeat('.', CAST(o_orderkey % 3 AS INT)), o_orderpriority, repeat(',', CAST(o_custkey % 4 AS INT)), ') z')"


def q_trim_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SPAN} AS text")
    return rows.select("o_orderkey", T.trimmed(F.col("text"), F.lit(1), F.length("text") - 2).alias("s")).select("o_orderkey", "s.start", "s.end")


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses with the words beside them on their line."""
    rows = T.neighbours(tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.where(F.contains("text", F.lit("@"))).select("doc_id", "text", "before", "after", F.length("line").alias("line_length"))


def q_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(repeat('He said ', CAST(o_orderkey % 3 AS INT)), repeat('and she, with hers, ', CAST(o_custkey % 3 AS INT)), repeat('x', CAST(o_orderkey % 300 AS INT)), ' his himself')")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.pronoun_gender(text).alias("gender"))


def q_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States, postcodes and street types as words."""
    words = F.array(*map(F.lit, ("NSW,", "Victoria", "qld.", "South Australia", "ACT", "Street", "pde,", "Ave.", "nowhere", "")))
    word = F.element_at(words, (F.col("o_orderkey") % 10 + 1).cast("int"))
    state = T.canonical_state(word)
    return table(spark, sf_dir, "orders").select(word.alias("word"), state.alias("state"), T.is_street_type(word).alias("street"), T.postcode_fits(state, (F.col("o_custkey") % 10).cast("string")).alias("fits")).groupBy("word", "state", "street", "fits").agg(F.count("*").alias("n"))


def q_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of line items by what they hold: as many as there are different ones."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.content_id(F.lit("M"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("id"))
    return i.groupBy(F.length("id").alias("length")).agg(F.count_distinct("id").alias("n"))


def q_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: some missing, some changed, some that nobody promised."""
    p = table(spark, sf_dir, "part")
    name, digest = F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), F.sha2("p_name", 256)
    lines = p.where("p_partkey % 7 <> 0").select(F.concat(digest, F.lit("  "), name).alias("value")).unionByName(spark.createDataFrame([("# a comment",)], "value string"))
    found = p.where("p_partkey % 5 <> 0").select(name.alias("path"), F.when(F.col("p_partkey") % 11 == 0, F.sha2("p_brand", 256)).otherwise(digest).alias("sha256"))
    return S.broken(S.checksums(lines), found).groupBy("problem").agg(F.count("*").alias("n"))


def q_model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    registry = p.select(F.col("p_brand").alias("model"), F.col("p_partkey").cast("string").alias("file"), F.sha2("p_name", 256).alias("sha256"))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.sha2(F.when(F.col("p_size") == 1, F.lit("other")).otherwise(F.col("p_name")), 256).alias("sha256")).where("path <> '3'")
    return S.resolved(registry, files)


def q_reader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as a reader's rows: words, lines, and what isn't a word."""
    row = F.concat_ws("\t", (F.col("o_orderkey") % 3 + 3).cast("string"), F.lit("0"), (F.col("o_orderkey") % 2).cast("string"), F.lit("1"), (F.col("o_orderkey") % 4).cast("string"), F.lit("1"), (F.col("o_orderkey") % 500).cast("string"), F.lit("10"),
                      (F.col("o_orderkey") % 5).cast("string"), F.lit("12"), ((F.col("o_orderkey") % 9 - 1) * 10).cast("string"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("text"))
    return S.parse_reader_rows(rows).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "text", F.round("confidence", 3).alias("confidence"), "x0", "x1")


QUERIES = {f.__name__: f for f in (q_token_at, q_view_lengths, q_collapse, q_trim_span, q_neighbours, q_pronouns, q_places, q_content_ids, q_broken_files, q_model_registry, q_reader_rows)}

_SPACE = r"[ \t\n\r\f\v]"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: list_filter(regexp_split_to_array(x, '" + _SPACE + "+'), lambda w: w <> '')), lambda x: len(x) > 0)"
ORACLE_SQL = {
    "q_token_at": f"""
        WITH v AS (SELECT doc_id, {_LINES} AS l FROM documents), t AS (SELECT doc_id, list_transform(l, lambda w: array_to_string(w, ' ')) AS l, array_to_string(list_transform(l, lambda w: array_to_string(w, ' ')), chr(10)) AS v FROM v),
             p AS (SELECT doc_id, v, unnest(range(0, length(v), 97)) AS o FROM t WHERE v <> '')
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE v[o + 1] NOT IN (' ', chr(10))) AS n_in_tokens,
               CAST(sum(length(v[1:o]) - length(replace(v[1:o], chr(10), ''))) FILTER (WHERE v[o + 1] NOT IN (' ', chr(10))) AS BIGINT) AS lines FROM p GROUP BY 1
    """,
    "q_view_lengths": "SELECT TRUE AS same, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS length FROM documents",
    "q_collapse": f"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'), ' ')) AS text_md5 FROM documents",
    "q_trim_span": "SELECT o_orderkey, CAST(3 + o_orderkey % 3 AS INTEGER) AS start, CAST(3 + o_orderkey % 3 + length(o_orderpriority) AS INTEGER) AS \"end\" FROM orders",
    "q_neighbours": f"""
        WITH l AS (SELECT doc_id, unnest({_LINES}) AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM l)
        SELECT doc_id, w[i] AS text, array_to_string(w[greatest(i - 3, 1):i - 1], ' ') AS before, array_to_string(w[i + 1:i + 4], ' ') AS after, CAST(length(array_to_string(w, ' ')) AS INTEGER) AS line_length FROM t WHERE contains(w[i], '@')
    """,
    "q_pronouns": """
        SELECT o_orderkey, CASE WHEN he > she THEN 'm' WHEN she > he THEN 'f' ELSE 'u' END AS gender
        FROM (SELECT o_orderkey, she, he + CASE WHEN pos + 4 <= 240 THEN 1 ELSE 0 END + CASE WHEN pos + 12 <= 240 OR pos + 8 = 240 THEN 1 ELSE 0 END AS he -- cut to "him", it is one, too
              FROM (SELECT o_orderkey, 2 * (o_custkey % 3) AS she, o_orderkey % 3 AS he, 8 * (o_orderkey % 3) + 20 * (o_custkey % 3) + o_orderkey % 300 AS pos FROM orders))
    """,
    "q_places": """
        WITH w AS (SELECT ['NSW,', 'Victoria', 'qld.', 'South Australia', 'ACT', 'Street', 'pde,', 'Ave.', 'nowhere', ''][CAST(o_orderkey % 10 + 1 AS INTEGER)] AS word, ['NSW', 'VIC', 'QLD', 'SA', 'ACT', NULL, NULL, NULL, NULL, NULL][CAST(o_orderkey % 10 + 1 AS INTEGER)] AS state,
                          o_orderkey % 10 IN (5, 6, 7) AS street, ['2', '3', '4', '5', '2', NULL, NULL, NULL, NULL, NULL][CAST(o_orderkey % 10 + 1 AS INTEGER)] AS lead, CAST(o_custkey % 10 AS VARCHAR) AS p FROM orders)
        SELECT word, state, street, lead = p AS fits, count(*) AS n FROM w GROUP BY 1, 2, 3, 4
    """,
    "q_content_ids": "SELECT CAST(25 AS INTEGER) AS length, count(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) AS n FROM lineitem",
    "q_broken_files": """
        SELECT problem, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN 'unknown' WHEN p_partkey % 7 <> 0 AND p_partkey % 11 = 0 THEN 'differs' END AS problem FROM part) WHERE problem IS NOT NULL GROUP BY 1
    """,
    "q_model_registry": "SELECT DISTINCT p_brand AS model FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 OR p_partkey = 3)",
    "q_reader_rows": """
        WITH w AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderkey % 2 AS b, o_orderkey % 4 AS l FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 9 >= 1 AND o_orderkey % 5 > 0),
             f AS (SELECT doc_id, b, l, dense_rank() OVER (PARTITION BY doc_id ORDER BY min(k)) - 1 AS line_no FROM w GROUP BY 1, 2, 3)
        SELECT w.doc_id, line_no, row_number() OVER (PARTITION BY w.doc_id, line_no ORDER BY k) - 1 AS word_no, 'w' || CAST(k AS VARCHAR) AS text, round(((k % 9 - 1) * 10) / 100.0::DOUBLE, 3) AS confidence, CAST(k % 500 AS INTEGER) AS x0, CAST(k % 500 + k % 5 AS INTEGER) AS x1
        FROM w JOIN f ON f.doc_id = w.doc_id AND f.b = w.b AND f.l = w.l
    """,
}
