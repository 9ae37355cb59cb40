"""Policy, transformation and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators import surrogates
from ..operators.boxes import region_action
from ..operators.fusion import TYPES
from ..sources.tables import table


def q_policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.policy_table(spark).groupBy("profile", "kind", "action").agg(F.count("*").alias("n"))


def q_policy_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_actions(P.policy_table(spark)).agg(F.count("*").alias("n_missing"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up mention a line item: type by part, value by quantity and date."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    value = F.when(kind == "age", F.concat(F.lit("aged "), (F.col("l_partkey") % 120).cast("string"))).when(kind == "date", F.date_format("l_shipdate", "yyyy")).otherwise(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), kind.alias("entity_type"), value.alias("value"))


def q_policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [P.decide(_mentions(spark, sf_dir), p).select(F.lit(p).alias("profile"), "entity_type", "action") for p in P.PROFILES]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    return every.groupBy("profile", "action").agg(F.count("*").alias("n"))


def q_age_topcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("aged "), (F.col("o_orderkey") % 130).cast("string"), F.lit(" or "), (F.col("o_custkey") % 100).cast("string"), F.lit("yo"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.generalise_age(text).alias("age"))


def q_effective_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.explode(F.array(F.lit("surrogate"), F.lit("label"), F.lit("blackout"))).alias("style")
    rows = P.policy_table(spark).where("kind = 'entity'").select("profile", "name", "action", styles)
    return rows.groupBy("profile", "style", P.effective_kind(F.col("action"), F.col("style")).alias("drawn")).agg(F.count("*").alias("n"))


def q_label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.number_labels(_mentions(spark, sf_dir).where("entity_type in ('email', 'phone', 'person', 'medicare')"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def q_date_shift_fixed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.date_format("o_orderdate", "dd/MM/yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", surrogates.shift_numeric_date(value, 47).alias("later"), surrogates.shift_numeric_date(F.date_format("o_orderdate", "yyyy-MM-dd"), -40).alias("earlier"))


def q_region_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept regions are dropped; stand-ins are only drawn in the surrogate style, else the region is removed."""
    style = F.explode(F.array(F.lit("surrogate"), F.lit("label"))).alias("style")
    rows = P.policy_table(spark).where("kind = 'region'").select("profile", "name", "action", style)
    acted = region_action(F.col("action"), F.col("style"))
    return rows.groupBy("profile", "style", acted.alias("acted")).agg(F.count("*").alias("n")).where("acted is not null")


def q_canonical_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first dates of two layouts, two-digit years pivoting at 30, as ISO."""
    two = F.date_format("o_orderdate", "d.M.yy")
    return table(spark, sf_dir, "orders").select("o_orderkey", surrogates.canonical_date(two).alias("short"), surrogates.canonical_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("long"))


QUERIES = {f.__name__: f for f in (
    q_policy_table, q_policy_complete, q_policy_decide, q_age_topcode, q_effective_kind, q_label_numbering, q_date_shift_fixed_days, q_region_actions, q_canonical_date,
)}

_TYPE = f"['{"', '".join(TYPES)}']"
_MENTIONS = f"""
    SELECT l_orderkey AS doc_id, l_linenumber AS start, t AS entity_type,
           CASE WHEN t = 'age' THEN 'aged ' || CAST(l_partkey % 120 AS VARCHAR) WHEN t = 'date' THEN strftime(l_shipdate, '%Y') ELSE 'v' || CAST(l_suppkey AS VARCHAR) END AS value, l_partkey
    FROM (SELECT *, ({_TYPE})[CAST(l_partkey % {len(TYPES)} + 1 AS INTEGER)] AS t FROM lineitem)
"""
# What each profile does, written out: types and regions that differ from the broad profile's surrogates and removals.
_ALL = ("medicare ihi hpi tfn crn ndis dva_file passport driver_licence provider_number ahpra card_number bank_account abn acn vin vehicle_reg clinical_id court_file employee_id reference email url file_path phone "
        "ip_address date_of_birth date_of_death person street_address organisation locality postcode other_id date age").split()  # fmt: skip
_REGIONS = "signature handwriting face photo barcode logo stamp illegible faint_ink graphic".split()
_POLICY = f"""
    SELECT profile, 'entity' AS kind, t AS name,
           CASE WHEN profile = 'maximal' AND t IN ('date', 'date_of_birth', 'date_of_death') THEN 'shift_date' WHEN profile = 'maximal' AND t = 'age' THEN 'generalise' WHEN t IN ('date', 'age') THEN 'keep'
                WHEN profile = 'client' AND t IN ('date_of_birth', 'date_of_death', 'locality', 'postcode') THEN 'keep' WHEN profile = 'claimant_focused' AND t IN ('hpi', 'provider_number', 'ahpra', 'organisation') THEN 'keep' ELSE 'surrogate' END AS action
    FROM (VALUES ('broad'), ('client'), ('claimant_focused'), ('maximal')) p(profile), (SELECT unnest({_ALL}) AS t)
    UNION ALL SELECT profile, 'region', r, CASE WHEN r = 'faint_ink' THEN 'suppress_ink' WHEN profile = 'client' AND r IN ('signature', 'face', 'photo') THEN 'synthesise' WHEN profile = 'client' AND r = 'graphic' THEN 'keep' ELSE 'remove' END
    FROM (VALUES ('broad'), ('client'), ('claimant_focused'), ('maximal')) p(profile), (SELECT unnest({_REGIONS}) AS r)
"""
ORACLE_SQL = {
    "q_policy_table": f"SELECT profile, kind, action, count(*) AS n FROM ({_POLICY}) GROUP BY ALL",
    "q_policy_complete": f"SELECT CAST(4 * 46 - count(*) AS BIGINT) AS n_missing FROM ({_POLICY})",
    "q_policy_decide": f"""
        WITH p AS ({_POLICY}), m AS ({_MENTIONS})
        SELECT profile, CASE WHEN action = 'generalise' AND l_partkey % 120 < 90 THEN 'keep' WHEN action = 'shift_date' AND regexp_matches(value, '^[0-9]{{4}}$') THEN 'keep' ELSE action END AS action, count(*) AS n
        FROM m JOIN p ON p.kind = 'entity' AND p.name = m.entity_type GROUP BY 1, 2
    """,
    "q_age_topcode": """
        SELECT o_orderkey, 'aged ' || CASE WHEN o_orderkey % 130 >= 90 THEN '90+' ELSE CAST(o_orderkey % 130 AS VARCHAR) END || ' or ' || CASE WHEN o_custkey % 100 >= 90 THEN '90+' ELSE CAST(o_custkey % 100 AS VARCHAR) END || 'yo' AS age FROM orders
    """,
    "q_effective_kind": f"""
        SELECT profile, style, CASE WHEN action = 'keep' THEN 'none' WHEN style = 'label' THEN 'label' WHEN style = 'blackout' THEN 'blackout' WHEN action = 'surrogate' THEN 'replace' ELSE 'transform' END AS drawn, count(*) AS n
        FROM ({_POLICY}) p, (VALUES ('surrogate'), ('label'), ('blackout')) s(style) WHERE kind = 'entity' GROUP BY 1, 2, 3
    """,
    "q_label_numbering": f"""
        WITH m AS (SELECT *, CASE entity_type WHEN 'email' THEN 'EMAIL' WHEN 'phone' THEN 'PHONE' WHEN 'person' THEN 'NAME' ELSE 'ID' END AS tag FROM ({_MENTIONS}) WHERE entity_type IN ('email', 'phone', 'person', 'medicare')),
             f AS (SELECT *, min(start) OVER (PARTITION BY doc_id, tag, value) AS first FROM m), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, tag ORDER BY first) AS k FROM f)
        SELECT '[' || tag || ' ' || CAST(k AS VARCHAR) || ']' AS label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM n GROUP BY 1
    """,
    "q_date_shift_fixed_days": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 47, '%d/%m/%Y') AS later, strftime(CAST(o_orderdate AS DATE) - 40, '%Y-%m-%d') AS earlier FROM orders",
    "q_region_actions": f"""
        SELECT profile, style, CASE WHEN action = 'synthesise' AND style <> 'surrogate' THEN 'remove' ELSE action END AS acted, count(*) AS n
        FROM ({_POLICY}) p, (VALUES ('surrogate'), ('label')) s(style) WHERE kind = 'region' AND action <> 'keep' GROUP BY 1, 2, 3
    """,
    "q_canonical_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS short, strftime(o_orderdate, '%Y-%m-%d') AS long FROM orders",
}
