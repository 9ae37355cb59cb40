"""Check-digit queries over identifiers made from table keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..sources.tables import table

#: By query: digits made of the order key in Spark and in SQL, the check, and the check in SQL over a column d.
_D = "CAST(substr(d, {}, 1) AS INTEGER)"


def _sum(weights, first: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(i)}" for i, w in enumerate(weights, first)) + ")"


def _luhn(length: int) -> str:
    terms = []
    for i in range(1, length + 1):
        x = _D.format(i)
        terms.append(f"(CASE WHEN 2 * {x} > 9 THEN 2 * {x} - 9 ELSE 2 * {x} END)" if (length - i) % 2 else x)
    return "(" + " + ".join(terms) + ") % 10 = 0"


_SPREAD = {9: "(o_orderkey * 7919) % 1000000000", 10: "2000000000 + (o_orderkey * 104729) % 5000000000", 11: "(o_orderkey * 1299709) % 100000000000", 16: "8003600000000000 + (o_orderkey * 15485863) % 30000000000"}
CHECKS = {
    "q_medicare": (10, C.medicare_valid, f"regexp_matches(d, '^[2-6][0-9]{{8}}[1-9]$') AND {_sum(C.MEDICARE)} % 10 = {_D.format(9)}"),
    "q_tfn": (9, C.tfn_valid, f"{_sum(C.TFN_9)} % 11 = 0"),
    "q_acn": (9, C.acn_valid, f"(10 - {_sum(C.ACN)} % 10) % 10 = {_D.format(9)}"),
    "q_abn": (11, C.abn_valid, f"d[1] <> '0' AND ({_sum(C.ABN)} - 10) % 89 = 0"),
    "q_luhn": (16, C.luhn_valid, _luhn(16)),
    "q_ihi": (16, C.ihi_valid, f"substr(d, 1, 6) IN ('800360', '800361', '800362') AND {_luhn(16)}"),
}


def _query(width: int, check):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.expr(f"lpad(CAST({_SPREAD[width]} AS STRING), {width}, '0')")
        rows = table(spark, sf_dir, "orders").select(value.alias("d"))
        return rows.groupBy(F.substring("d", width, 1).alias("last_digit")).agg(F.count_if(check(F.col("d"))).alias("n_valid"), F.count("*").alias("n"))

    return query


def q_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    place = F.substr(F.lit(C.PROVIDER_LOCATIONS), (F.pmod(key, F.lit(32)) + 1).cast("int"), F.lit(1))
    last = F.substr(F.lit(C.PROVIDER_CHECKS), (F.pmod(key, F.lit(11)) + 1).cast("int"), F.lit(1))
    value = F.concat(F.lpad(F.pmod(key * 7919, F.lit(1000000)).cast("string"), 6, "0"), place, last)
    rows = table(spark, sf_dir, "orders").select(value.alias("v"))
    return rows.groupBy(F.substring("v", 8, 1).alias("check_letter")).agg(F.count_if(C.provider_number_valid(F.col("v"))).alias("n_valid"), F.count("*").alias("n"))


def q_fictional_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("concat('02 ', CASE WHEN o_orderkey % 3 = 0 THEN '5550' WHEN o_orderkey % 3 = 1 THEN '7010' ELSE '9999' END, ' ', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'))")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("phone")).withColumn("fictional", C.fictional_phone(F.col("phone")))


QUERIES = {name: _query(width, check) for name, (width, check, _) in CHECKS.items()} | {"q_provider": q_provider, "q_fictional_phone": q_fictional_phone}
ORACLE_SQL = {
    name: f"""
        SELECT substr(d, {width}, 1) AS last_digit, count(*) FILTER (WHERE {sql}) AS n_valid, count(*) AS n
        FROM (SELECT lpad(CAST({_SPREAD[width]} AS VARCHAR), {width}, '0') AS d FROM orders) GROUP BY 1
    """
    for name, (width, _, sql) in CHECKS.items()
} | {
    "q_provider": f"""
        WITH v AS (SELECT lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS d, o_orderkey % 32 AS place,
                          substr('{C.PROVIDER_CHECKS}', CAST(o_orderkey % 11 + 1 AS INTEGER), 1) AS c FROM orders)
        SELECT c AS check_letter, count(*) FILTER (WHERE substr('{C.PROVIDER_CHECKS}', CAST(({_sum(C.PROVIDER)} + place * 6) % 11 + 1 AS INTEGER), 1) = c) AS n_valid,
               count(*) AS n FROM v GROUP BY 1
    """,
    "q_fictional_phone": """
        SELECT o_orderkey, '02 ' || CASE WHEN o_orderkey % 3 = 0 THEN '5550' WHEN o_orderkey % 3 = 1 THEN '7010' ELSE '9999' END || ' '
               || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone, o_orderkey % 3 <> 2 AS fictional FROM orders
    """,
}
