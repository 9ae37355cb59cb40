"""Policy profiles as a table, decisions, styles, age top-coding and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fusion import TYPES

REGIONS = ("signature", "handwriting", "face", "photo", "barcode", "logo", "stamp", "illegible", "faint_ink", "graphic")
# What each profile does with entity types and regions where it differs from the broad profile.
BROAD = {t: "keep" if t in ("date", "age") else "surrogate" for t in TYPES}
BROAD_REGIONS = {r: "suppress_ink" if r == "faint_ink" else "remove" for r in REGIONS}
PROFILES: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "broad": ({}, {}),
    "client": (dict.fromkeys(("date_of_birth", "date_of_death", "locality", "postcode"), "keep"), {"signature": "synthesise", "face": "synthesise", "photo": "synthesise", "graphic": "keep"}),
    "claimant_focused": (dict.fromkeys(("hpi", "provider_number", "ahpra", "organisation"), "keep"), {}),
    "maximal": ({"date": "shift_date", "date_of_birth": "shift_date", "date_of_death": "shift_date", "age": "generalise"}, {}),
}
LABELS = {
    "person": "NAME", "date_of_birth": "DATE OF BIRTH", "date_of_death": "DATE OF DEATH", "street_address": "ADDRESS", "locality": "PLACE", "postcode": "POSTCODE",
    "phone": "PHONE", "email": "EMAIL", "url": "URL", "ip_address": "IP ADDRESS", "organisation": "ORGANISATION", "file_path": "FILE", "date": "DATE", "age": "AGE",
}


#: Profiles that keep the names of persons who act in their profession.
KEEP_PROFESSIONALS = ("claimant_focused",)


def actions_of(profile: str) -> dict[str, str]:
    """Each entity type's action in a profile."""
    return {**BROAD, **PROFILES[profile][0]}


def policy_table(spark: SparkSession) -> DataFrame:
    """(profile, kind, name, action) with an action for every type and region of every profile: a few hundred rows."""
    rows = []
    for profile, (entities, regions) in PROFILES.items():
        rows += [(profile, "entity", t, {**BROAD, **entities}[t]) for t in TYPES]
        rows += [(profile, "region", r, {**BROAD_REGIONS, **regions}[r]) for r in REGIONS]
    return spark.createDataFrame(rows, "profile string, kind string, name string, action string")


def missing_actions(policy: DataFrame) -> DataFrame:
    """Types and regions without an action in some profile; has to be empty."""
    spark = policy.sparkSession
    every = spark.createDataFrame([("entity", t) for t in TYPES] + [("region", r) for r in REGIONS], "kind string, name string")
    wanted = policy.select("profile").distinct().join(F.broadcast(every), F.lit(True))  # 46 rows
    return wanted.join(policy, ["profile", "kind", "name"], "left_anti")


def generalise_age(value: Column) -> Column:
    """Every number from 90 on becomes 90+."""
    return F.regexp_replace(value, r"(?<![0-9])(0?9[0-9]|[1-9][0-9]{2})(?![0-9])", "90+")


def decide(mentions: DataFrame, profile: str) -> DataFrame:
    """``mentions`` with their action; transformations that change nothing become keep."""
    policy = policy_table(mentions.sparkSession).where((F.col("profile") == profile) & (F.col("kind") == "entity")).select(F.col("name").alias("entity_type"), "action")
    joined = mentions.join(F.broadcast(policy), "entity_type")  # one row a type
    nothing = ((F.col("action") == "generalise") & (generalise_age(F.col("value")) == F.col("value"))) | ((F.col("action") == "shift_date") & F.col("value").rlike("^[0-9]{4}$"))
    return joined.withColumn("action", F.when(nothing, F.lit("keep")).otherwise(F.col("action")))


def effective_kind(action: Column, style: Column) -> Column:
    """What is drawn for an action in a style: surrogates, labels or blackouts."""
    return F.when(action == "keep", "none").when(style == "surrogate", F.when(action == "surrogate", "replace").when(action.isin("shift_date", "generalise"), "transform").otherwise("blackout")).when(style == "label", "label").otherwise("blackout")


def tag(entity_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, entity_type), F.lit("ID"))


def number_labels(mentions: DataFrame, key: str = "value") -> DataFrame:
    """``mentions`` with ``[TAG n]``: equal keys of a tag share a number, counted by first appearance in the document."""
    tagged = mentions.withColumn("tag", tag(F.col("entity_type")))
    first = F.min("start").over(Window.partitionBy("doc_id", "tag", key))
    numbered = tagged.withColumn("first", first).withColumn("n", F.dense_rank().over(Window.partitionBy("doc_id", "tag").orderBy("first")))
    return numbered.withColumn("label", F.concat(F.lit("["), F.col("tag"), F.lit(" "), F.col("n"), F.lit("]"))).drop("first", "n", "tag")
