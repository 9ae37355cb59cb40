"""Queries of what is told about jobs and persons, over fixture tables made from orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources.tables import table


def _orders(spark: SparkSession, sf_dir: str, where: str = "true", **columns: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(where).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


#: A marked-up letter for each order.
_LETTER = (
    "concat('Re: [Ann ', o_orderstatus, '](person) claim [WC', lpad(CAST(o_orderkey AS STRING), 7, '0'), '](reference)', chr(10), 'takes <Panadol>(drug) and <Targin>(drug)', chr(10), "
    "'seen [', CAST(o_custkey AS STRING), ' High St](address) by <Dr Wu>(professional)')"
)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, doc_id="o_orderkey", page="o_orderkey % 3", text=_LETTER)


def q_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_markup(_letters(spark, sf_dir)).groupBy("action", "kind").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"), F.sum(F.length("text")).alias("length"))


def q_answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_customer = _orders(spark, sf_dir, doc_id="o_custkey", page="o_orderkey % 3", text=_LETTER)
    key = R.answer_key(R.parse_markup(by_customer))
    return key.select("doc_id", "action", "kind", "text", "n", F.array_join("pages", ",").alias("pages"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters' values against an output that leaves names of every fifth letter and loses a drug in every seventh."""
    letters = R.plain_text(_letters(spark, sf_dir))
    text = F.regexp_replace(F.regexp_replace(F.when(F.col("doc_id") % 5 != 0, F.regexp_replace("text", "Ann [A-Z]", "[NAME 1]")).otherwise(F.col("text")), "WC[0-9]+", "[ID 1]"), "[0-9]+ High St", "[ADDRESS 1]")
    return R.score_values(R.parse_markup(_letters(spark, sf_dir)), letters.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.replace(text, F.lit("Targin"), F.lit("[NAME 2]"))).otherwise(text)))


def q_score_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("action", "kind", "status").agg(F.count("*").alias("n"))


def q_score_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tally(_scored(spark, sf_dir))


def q_score_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _orders(spark, sf_dir, doc_id="o_custkey", page="o_orderkey % 2", region="o_orderkey", kind="o_orderstatus", x0="(o_orderkey % 9) * 50", y0="(o_orderkey % 5) * 100", x1="(o_orderkey % 9) * 50 + 60", y1="(o_orderkey % 5) * 100 + 40")
    made = _orders(spark, sf_dir, "o_orderkey % 2 = 0", doc_id="o_custkey", page="o_orderkey % 2", x0="(o_orderkey % 9) * 50 + o_orderkey % 30", y0="(o_orderkey % 5) * 100 - 5", x1="(o_orderkey % 9) * 50 + 55", y1="(o_orderkey % 5) * 100 + 35")
    return R.score_regions(wanted, made).groupBy("kind", "hit").agg(F.count("*").alias("n"))


_MANIFEST = (
    "concat('{\"outcome\":\"', CASE WHEN o_orderstatus = 'F' THEN 'released' ELSE 'quarantined' END, '\",\"low_evidence\":', CAST(o_orderkey % 3 AS STRING), "
    "',\"mentions\":[{\"action\":\"surrogate\",\"entity_type\":\"person\",\"n\":', CAST(o_orderkey % 10 AS STRING), '},{\"action\":\"keep\",\"n\":', CAST(o_custkey % 4 AS STRING), '},{\"action\":\"shift_date\",\"n\":2}],', "
    "'\"checks\":[{\"check\":\"V2\",\"passed\":true},{\"check\":\"V4\",\"passed\":', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END, '}]}')"
)


def q_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.job_summary(_orders(spark, sf_dir, doc_id="o_orderkey", manifest=_MANIFEST))


_EVENTS = {"job": "user_id", "seq": "event_id", "at": "ts", "state": "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'released' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"}


def q_invalid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _EVENTS.items()])
    return R.invalid_steps(events).select("job", "seq", "before", "state")


def q_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _EVENTS.items()])
    return R.jobs(events).select("job", "state", F.col("place").cast("long").alias("place"))


def q_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up mentions of all types, and of none, by the reviewer's category."""
    from ..operators.fusion import TYPES

    kind = F.element_at(F.array(*map(F.lit, (*TYPES, "residual"))), (F.col("o_orderkey") % (len(TYPES) + 1) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), kind.alias("entity_type"), F.when(F.col("o_orderkey") % 2 == 0, "keep").otherwise("surrogate").alias("action"))
    return R.category_counts(rows)


def q_offset_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a customer, all moved by one offset, by two, or not at all."""
    days = F.when(F.col("o_custkey") % 3 == 0, 47).when(F.col("o_custkey") % 3 == 1, 40 + F.col("o_orderkey") % 2).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").alias("before"), F.date_add(F.to_date("o_orderdate"), days.cast("int")).alias("after"))
    return R.offset_consistency(rows)


def q_replacement_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names found in an output, against the words drawn for parts of the same brand."""
    p = table(spark, sf_dir, "part")
    values = p.select(F.substr("p_brand", F.lit(7)).cast("long").alias("doc_id"), F.substring_index("p_name", " ", 1).alias("value")).distinct()
    drawn = p.where("p_partkey % 40 = 0").select(F.substr("p_brand", F.lit(7)).cast("long").alias("doc_id"), F.upper("p_name").alias("by"))
    return R.explained_by(values, drawn)


def q_near_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    made = c.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("cust"), (F.col("c_custkey") % 700).cast("string")).alias("key"))
    return R.near_originals(made, c.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("cust"), (F.col("c_custkey") % 90).cast("string"), F.lit("9")).alias("key")))


_CLUSTERS = {"doc_id": "c_nationkey", "surname": "concat('s', CAST(c_custkey % 8 AS STRING))", "cluster": "c_custkey", "given": "concat(substr('abcdef', CAST(c_custkey % 6 + 1 AS INT), 1), 'x')", "gender": "substr('mfu', CAST(c_custkey % 3 + 1 AS INT), 1)"}
_PARTIALS = {"doc_id": "s_nationkey", "mention": "s_suppkey", "surname": "concat('s', CAST(s_suppkey % 9 AS STRING))", "initial": "CASE WHEN s_suppkey % 2 = 0 THEN substr('ABCDEF', CAST(s_suppkey % 6 + 1 AS INT), 1) END", "gender": "substr('mfu', CAST(s_suppkey % 3 + 1 AS INT), 1)"}


def q_unique_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as partial names, every twelfth customer as a full one."""
    clusters = table(spark, sf_dir, "customer").where("c_custkey % 12 = 0").selectExpr(*[f"{e} AS {c}" for c, e in _CLUSTERS.items()])
    return R.unique_cluster(table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in _PARTIALS.items()]), clusters)


def q_gender_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.majority_gender(_orders(spark, sf_dir, cluster="o_custkey", gender="CASE o_orderkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'm' WHEN 2 THEN 'f' WHEN 3 THEN 'f' ELSE 'u' END"), "cluster")


def q_family_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "c_custkey % 40 AS cluster", "c_custkey % 23 AS surname", "c_custkey % 40 % 3 <> 0 AS candidate")
    return R.family_check(rows)


def q_cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "c_custkey AS mention", "concat('s', CAST(c_custkey % 11 AS STRING)) AS surname", "concat('g', CAST(c_custkey % 3 AS STRING)) AS given")
    return R.number_clusters(rows).select("doc_id", "mention", "cluster")


def q_manifest_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _orders(spark, sf_dir, doc_id="o_custkey", mention="o_orderkey")
    ops = _orders(spark, sf_dir, "o_orderkey % 4 <> 0", doc_id="o_custkey", op="o_orderkey * 10", ref="CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END", covers="CASE WHEN o_orderkey % 4 = 2 THEN array(o_orderkey, o_orderkey + 1) ELSE array() END")
    return R.assembled(mentions, ops).select("doc_id", "mention", F.array_join(F.transform("ops", lambda x: x.cast("string")), ",").alias("ops"))


QUERIES = {f.__name__: f for f in (
    q_markup, q_answer_key, q_score_values, q_score_tally, q_score_regions, q_job_summary, q_invalid_steps, q_jobs, q_categories, q_offset_consistency, q_replacement_explained, q_near_originals, q_unique_cluster,
    q_gender_vote, q_family_check, q_cluster_numbers, q_manifest_assembly,
)}

_VALUES = """
    SELECT o_orderkey, o_custkey, o_orderkey % 3 AS page, unnest([{'a': 'replace', 'k': 'person', 't': 'Ann ' || o_orderstatus}, {'a': 'replace', 'k': 'reference', 't': 'WC' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')},
           {'a': 'replace', 'k': 'address', 't': CAST(o_custkey AS VARCHAR) || ' High St'}, {'a': 'keep', 'k': 'drug', 't': 'Panadol'}, {'a': 'keep', 'k': 'drug', 't': 'Targin'}, {'a': 'keep', 'k': 'professional', 't': 'Dr Wu'}]) AS v FROM orders
"""
_STATUS = f"""
    SELECT o_orderkey AS doc_id, v.a AS action, v.k AS kind, v.t AS text,
           CASE WHEN v.k = 'person' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'leaked' ELSE 'replaced' END WHEN v.a = 'replace' THEN 'replaced' WHEN v.t = 'Targin' AND o_orderkey % 7 = 0 THEN 'damaged' ELSE 'kept' END AS status FROM ({_VALUES})
"""
_STATE = _EVENTS["state"]
ORACLE_SQL = {
    "q_markup": f"SELECT v.a AS action, v.k AS kind, count(*) AS n, count(DISTINCT v.t) AS n_texts, CAST(sum(length(v.t)) AS BIGINT) AS length FROM ({_VALUES}) GROUP BY 1, 2",
    "q_answer_key": f"SELECT o_custkey AS doc_id, v.a AS action, v.k AS kind, v.t AS text, count(*) AS n, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM ({_VALUES}) GROUP BY 1, 2, 3, 4",
    "q_score_values": f"SELECT action, kind, status, count(*) AS n FROM ({_STATUS}) GROUP BY 1, 2, 3",
    "q_score_tally": f"""
        WITH t AS (SELECT doc_id, count(*) FILTER (WHERE status = 'replaced') AS replaced, count(*) FILTER (WHERE status = 'leaked') AS leaked, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'damaged') AS damaged FROM ({_STATUS}) GROUP BY 1)
        SELECT *, round(100.0::DOUBLE * leaked / (leaked + replaced), 2) AS leaked_percent, round(100.0::DOUBLE * damaged / (damaged + kept), 2) AS damaged_percent FROM t
    """,
    "q_score_regions": """
        WITH w AS (SELECT *, (o_orderkey % 9) * 50 AS x, (o_orderkey % 5) * 100 AS y FROM orders)
        SELECT o_orderstatus AS kind, EXISTS (SELECT 1 FROM w m WHERE m.o_custkey = w.o_custkey AND m.o_orderkey % 2 = 0 AND w.o_orderkey % 2 = 0 AND m.x + m.o_orderkey % 30 <= w.x + 18 AND m.y - 5 <= w.y + 18 AND m.x + 55 >= w.x + 42 AND m.y + 35 >= w.y + 22) AS hit, count(*) AS n
        FROM w GROUP BY 1, 2
    """,
    "q_job_summary": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'released' ELSE 'quarantined' END AS outcome, o_orderkey % 10 + 2 AS replaced, o_custkey % 4 AS kept, o_orderkey % 3 AS low_evidence,
               CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS checks_passed, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS checks_failed FROM orders
    """,
    "q_invalid_steps": f"""
        WITH e AS (SELECT user_id AS job, event_id AS seq, {_STATE} AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY seq) AS before FROM e)
        SELECT job, seq, before, state FROM b WHERE NOT coalesce(CASE WHEN before IS NULL THEN state = 'queued' ELSE (before, state) IN (('queued', 'running'), ('queued', 'cancelled'), ('running', 'released'), ('running', 'quarantined'), ('running', 'failed'), ('running', 'cancelled'), ('failed', 'queued')) END, FALSE)
    """,
    "q_jobs": f"""
        WITH e AS (SELECT user_id AS job, event_id AS seq, ts, {_STATE} AS state FROM events), l AS (SELECT job, arg_max(state, seq) AS state, max(ts) AS since FROM e GROUP BY 1)
        SELECT job, state, CASE WHEN state = 'queued' THEN row_number() OVER (PARTITION BY state ORDER BY since, job) END AS place FROM l
    """,
    "q_categories": """
        WITH m AS (SELECT o_custkey AS doc_id, o_orderkey % 37 AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'keep' ELSE 'surrogate' END AS action FROM orders)
        SELECT CASE WHEN t <= 8 OR t IN (9, 10, 11, 12, 13, 14, 15, 16, 33) THEN 'identifier' WHEN t IN (17, 18, 19, 20) THEN 'reference' WHEN t IN (21, 22, 24, 25) THEN 'contact' WHEN t = 23 THEN 'file' WHEN t IN (26, 27, 34, 35) THEN 'date'
                    WHEN t = 28 THEN 'person' WHEN t IN (29, 31, 32) THEN 'place' WHEN t = 30 THEN 'organisation' ELSE 'residual' END AS category, action, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1, 2
    """,
    "q_offset_consistency": """
        SELECT o_custkey AS doc_id, count(DISTINCT CASE WHEN o_custkey % 3 = 1 THEN o_orderkey % 2 ELSE 0 END) AS n_offsets, CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN count(DISTINCT o_orderkey % 2) = 1 ELSE FALSE END AS consistent FROM orders GROUP BY 1
    """,
    "q_replacement_explained": """
        WITH v AS (SELECT DISTINCT CAST(p_brand[7:] AS BIGINT) AS doc_id, split_part(p_name, ' ', 1) AS value FROM part), r AS (SELECT CAST(p_brand[7:] AS BIGINT) AS doc_id, replace(lower(p_name), ' ', '') AS k FROM part WHERE p_partkey % 40 = 0)
        SELECT doc_id, value, length(value) >= 3 AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = v.doc_id AND (contains(k, lower(value)) OR contains(lower(value), k))) AS explained FROM v
    """,
    "q_near_originals": """
        WITH m AS (SELECT DISTINCT c_nationkey AS doc_id, 'cust' || CAST(c_custkey % 700 AS VARCHAR) AS key FROM customer), o AS (SELECT DISTINCT c_nationkey AS doc_id, 'cust' || CAST(c_custkey % 90 AS VARCHAR) || '9' AS key FROM customer)
        SELECT doc_id, key FROM m WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = m.doc_id AND levenshtein(o.key, m.key) <= 1)
    """,
    "q_unique_cluster": """
        WITH c AS (SELECT c_nationkey AS doc_id, c_custkey % 8 AS s, c_custkey AS cluster, c_custkey % 6 AS g, c_custkey % 3 AS x FROM customer WHERE c_custkey % 12 = 0), p AS (SELECT s_nationkey AS doc_id, s_suppkey AS mention, s_suppkey % 9 AS s, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 6 END AS i, s_suppkey % 3 AS x FROM supplier),
             f AS (SELECT p.doc_id, p.mention, c.cluster, p.x = 2 OR c.x = 2 OR p.x = c.x AS agrees FROM p JOIN c ON p.doc_id = c.doc_id AND p.s = c.s AND (p.i IS NULL OR p.i = c.g)),
             n AS (SELECT mention, count(*) AS n, count(*) FILTER (WHERE agrees) AS a, min(cluster) AS any_, min(cluster) FILTER (WHERE agrees) AS one FROM f GROUP BY 1)
        SELECT p.doc_id, p.mention, CASE WHEN n.n = 1 THEN any_ WHEN n.a = 1 THEN one END AS cluster FROM p LEFT JOIN n ON n.mention = p.mention
    """,
    "q_gender_vote": """
        SELECT o_custkey AS cluster, CASE WHEN m > f THEN 'm' WHEN f > m THEN 'f' ELSE 'u' END AS gender FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 5 < 2) AS m, count(*) FILTER (WHERE o_orderkey % 5 IN (2, 3)) AS f FROM orders GROUP BY 1)
    """,
    "q_family_check": """
        WITH r AS (SELECT c_nationkey AS doc_id, c_custkey % 40 AS cluster, c_custkey % 23 AS surname FROM customer)
        SELECT DISTINCT doc_id, cluster FROM r a WHERE cluster % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM r b JOIN r d ON b.doc_id = d.doc_id AND b.surname = d.surname WHERE b.doc_id = a.doc_id AND b.cluster = a.cluster AND d.cluster % 3 = 0)
    """,
    "q_cluster_numbers": "SELECT c_nationkey AS doc_id, c_custkey AS mention, 'P' || lpad(CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY 's' || CAST(c_custkey % 11 AS VARCHAR), c_custkey % 3) - 1 AS VARCHAR), 3, '0') AS cluster FROM customer",
    "q_manifest_assembly": """
        WITH d AS (SELECT o_custkey, o_orderkey AS mention, o_orderkey * 10 AS op FROM orders WHERE o_orderkey % 4 IN (1, 2) UNION ALL SELECT o_custkey, o_orderkey + 1, o_orderkey * 10 FROM orders WHERE o_orderkey % 4 = 2)
        SELECT o.o_custkey AS doc_id, o.o_orderkey AS mention, coalesce(string_agg(CAST(d.op AS VARCHAR), ',' ORDER BY d.op), '') AS ops FROM orders o LEFT JOIN d ON d.o_custkey = o.o_custkey AND d.mention = o.o_orderkey GROUP BY 1, 2
    """,
}
