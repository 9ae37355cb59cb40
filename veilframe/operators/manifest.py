"""Release checks, the gate and the manifest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a document has to pass, and the column that counts its problems.  The pixel check has no counterpart in text.
CHECKS = {"V1": "error", "V2": "leaks", "V4": "residual", "V5": "unsafe", "V6": "changed"}


def checks(done: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, check, passed, problems) of the documents' rows: V1 there is an output, V2 no line of it holds a removed
    value, V4 neither a second search for removed values nor a second detection finds anything, V5 no surrogate is near
    an original or valid, V6 nothing but the mentions changed.  ``by``: the columns that tell rows apart."""
    problems = {"V1": (F.col("error").isNotNull() | F.col("text").isNull()).cast("int"), **{c: F.coalesce(F.col(n), F.lit(1)) for c, n in CHECKS.items() if c != "V1"}}
    rows = F.array(*[F.struct(F.lit(c).alias("check"), n.cast("long").alias("problems")) for c, n in problems.items()])
    return done.select(*by, F.explode(rows).alias("c")).select(*by, "c.check", (F.col("c.problems") == 0).alias("passed"), "c.problems")


def gate(done: DataFrame, checked: DataFrame, refused: DataFrame | None = None, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, outcome, reasons): released only where all checks ran and passed; every document has one outcome.

    ``refused``: (doc_id, reason) of documents that weren't read; ``by``: as in ``checks``, without refused ones.
    """
    seen = checked.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and("passed").alias("ok"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("reasons"))
    joined = done.select(*by).join(seen, list(by), "left")
    released = (F.col("n") == len(CHECKS)) & F.col("ok")
    out = joined.select(*by, F.when(released, "released").otherwise("quarantined").alias("outcome"), F.coalesce("reasons", F.array(F.lit("not_checked"))).alias("reasons"))
    if refused is not None:
        out = out.unionByName(refused.select("doc_id", F.lit("quarantined").alias("outcome"), F.array("reason").alias("reasons")))
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and whole floats as integers; NaN and infinities are refused."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        if isinstance(x, float) and x == x and abs(x) != float("inf") and x == int(x):
            return int(x)
        return x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _canonical_column(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else canonical(json.loads(x)))


def canonical_json(column: Column) -> Column:
    return F.pandas_udf(_canonical_column, "string")(column)


#: What made a manifest; part of it, so that another version's isn't taken for the same.
VERSIONS = {"manifest": "2", "rules": "2"}


def manifest(docs: DataFrame, decisions: DataFrame, checked: DataFrame, outcome: DataFrame, low: DataFrame | None = None, profile: str = "broad") -> DataFrame:
    """(doc_id, manifest): canonical JSON of sizes, mentions by type and action, evidence, checks and outcome; no text of
    the document and no value."""
    acts = decisions.groupBy("doc_id", "entity_type", "action").agg(F.count("*").alias("n"))
    acts = acts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entity_type", "action", "n"))).alias("mentions"))
    rules = decisions.select("doc_id", F.explode("evidence.rule").alias("rule")).groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    ran = checked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("check", "passed", "problems"))).alias("checks"))
    sizes = docs.select("doc_id", F.sha2("text", 256).alias("input_sha256"), F.length("text").alias("characters"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))
    joined = sizes.join(acts, "doc_id", "left").join(rules, "doc_id", "left").join(ran, "doc_id", "left").join(outcome, "doc_id")
    weak = F.lit(0).cast("long")
    if low is not None:
        joined = joined.join(low.groupBy("doc_id").agg(F.count("*").alias("weak")), "doc_id", "left")
        weak = F.coalesce("weak", weak)
    none = F.array().cast("array<struct<entity_type: string, action: string, n: bigint>>")
    versions = F.struct(*[F.lit(v).alias(k) for k, v in VERSIONS.items()])
    body = F.struct("doc_id", "input_sha256", "characters", "lines", F.lit(profile).alias("profile"), F.coalesce("mentions", none).alias("mentions"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), weak.alias("low_evidence"), "checks", "outcome", "reasons", versions.alias("versions"))
    return joined.select("doc_id", canonical_json(F.to_json(body)).alias("manifest"))
