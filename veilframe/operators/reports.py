"""What is told about jobs: summaries, categories, answer keys and scores, sealed and plain manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits_only, match_key
from .boxes import BOX, PAGE

# The reviewer's categories of entity types, and the tolerance of regions in points.
CATEGORIES = {
    "person": ("person",), "contact": ("phone", "email", "url", "ip_address"), "place": ("street_address", "locality", "postcode"),
    "identifier": ("medicare", "ihi", "hpi", "tfn", "crn", "ndis", "dva_file", "passport", "driver_licence", "provider_number", "ahpra", "card_number", "bank_account", "abn", "acn", "vin", "vehicle_reg", "other_id"),
    "reference": ("clinical_id", "court_file", "employee_id", "reference"), "date": ("date_of_birth", "date_of_death", "date", "age"), "organisation": ("organisation",), "file": ("file_path",),
}
TOLERANCE = 18.0
#: States of a job and those each may turn into.
STATES = {"queued": ("running", "cancelled"), "running": ("released", "quarantined", "failed", "cancelled"), "released": (), "quarantined": (), "failed": ("queued",), "cancelled": ()}


def category(entity_type: Column) -> Column:
    """The reviewer's category of an entity type; what no mention explains is residual."""
    of = F.create_map(*[F.lit(x) for c, types in CATEGORIES.items() for t in types for x in (t, c)])
    return F.coalesce(F.try_element_at(of, entity_type), F.lit("residual"))


def category_counts(mentions: DataFrame) -> DataFrame:
    """(category, action, n, n_docs) of mentions (doc_id, entity_type, action)."""
    return mentions.groupBy(category(F.col("entity_type")).alias("category"), "action").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def job_summary(manifests: DataFrame) -> DataFrame:
    """(doc_id, outcome, replaced, kept, low_evidence, checks_passed, checks_failed) from manifests (doc_id, manifest: JSON)."""
    body = "struct<outcome: string, mentions: array<struct<action: string, n: bigint>>, low_evidence: bigint, checks: array<struct<check: string, passed: boolean>>>"
    rows = manifests.select("doc_id", F.from_json("manifest", body).alias("m"))
    total = lambda keep: F.aggregate(F.filter("m.mentions", lambda x: (x["action"] == "keep") == F.lit(keep)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    passed = lambda ok: F.size(F.filter("m.checks", lambda c: c["passed"] == F.lit(ok))).cast("long")
    return rows.select("doc_id", "m.outcome", total(False).alias("replaced"), total(True).alias("kept"), F.coalesce("m.low_evidence", F.lit(0)).alias("low_evidence"), passed(True).alias("checks_passed"), passed(False).alias("checks_failed"))


def invalid_steps(events: DataFrame) -> DataFrame:
    """Events (job, seq, state) that don't follow from the job's state before; a job begins as queued."""
    allowed = F.create_map(*[x for s, to in STATES.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    before = F.lag("state").over(Window.partitionBy("job").orderBy("seq"))
    fine = F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("state")))
    return events.withColumn("before", before).where(~F.coalesce(fine, F.lit(False)))


def jobs(events: DataFrame) -> DataFrame:
    """(job, state, since, place): each job's latest state, and its place among those that wait, first come first served."""
    latest = events.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.max("at").alias("since"))
    return latest.withColumn("place", F.when(F.col("state") == "queued", F.row_number().over(Window.partitionBy("state").orderBy("since", "job"))))


def answer_key(planted: DataFrame) -> DataFrame:
    """(doc_id, action, kind, text, n, pages) of planted values (doc_id, page, action, kind, text)."""
    return planted.groupBy("doc_id", "action", "kind", "text").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("pages"))


#: Values in a marked-up document: "[value](kind)" is planted, "<value>(class)" has to survive.
PLANTED, SURVIVES = r"\[([^\]\[]+)\]\((\w+)\)", r"<([^<>]+)>\((\w+)\)"


def parse_markup(docs: DataFrame) -> DataFrame:
    """(doc_id, page, action, kind, text) of the values marked in (doc_id, page, text)."""
    out = None
    for action, form in (("replace", PLANTED), ("keep", SURVIVES)):
        values = F.arrays_zip(F.regexp_extract_all("text", F.lit(form), F.lit(2)).alias("kind"), F.regexp_extract_all("text", F.lit(form), F.lit(1)).alias("value"))
        rows = docs.select("doc_id", "page", F.explode(values).alias("v")).select("doc_id", "page", F.lit(action).alias("action"), F.col("v")["kind"].alias("kind"), F.col("v")["value"].alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def plain_text(docs: DataFrame) -> DataFrame:
    """Marked-up documents without their marks."""
    return docs.withColumn("text", F.regexp_replace(F.regexp_replace("text", PLANTED, "$1"), SURVIVES, "$1"))


def score_values(key: DataFrame, outputs: DataFrame) -> DataFrame:
    """``key`` (doc_id, action, kind, text) with a status: replaced or leaked, kept or damaged, by whether the value's key
    or digits stand in a line of the document's output (doc_id, text)."""
    lines = outputs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", match_key(F.col("line")).alias("hay"), digits_only(F.col("line")).alias("runs"))
    values = key.select("doc_id", "action", "kind", "text", match_key(F.col("text")).alias("needle")).distinct()
    digits = F.col("needle").rlike("^[0-9]{6,}$")
    found = values.join(lines, "doc_id").where((F.col("needle") != "") & (F.contains("hay", "needle") | (digits & F.contains("runs", "needle"))))
    joined = values.join(found.select("doc_id", "action", "kind", "text").distinct().withColumn("there", F.lit(True)), ["doc_id", "action", "kind", "text"], "left")
    there = F.coalesce("there", F.lit(False))
    status = F.when(F.col("action") == "keep", F.when(there, "kept").otherwise("damaged")).otherwise(F.when(there, "leaked").otherwise("replaced"))
    return joined.select("doc_id", "action", "kind", "text", status.alias("status"))


def score_regions(wanted: DataFrame, made: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``wanted`` (doc_id, page, region, kind, box in points) with hit: some operation ``made`` (doc_id, page, box) holds
    it but for ``tolerance`` on each side."""
    o = made.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, *BOX)])
    holds = (F.col("o_x0") <= F.col("x0") + tolerance) & (F.col("o_y0") <= F.col("y0") + tolerance) & (F.col("o_x1") >= F.col("x1") - tolerance) & (F.col("o_y1") >= F.col("y1") - tolerance)
    hit = wanted.join(o, (F.col("doc_id") == F.col("o_doc_id")) & (F.col("page") == F.col("o_page")) & holds).select(*PAGE, "region").distinct().withColumn("hit", F.lit(True))
    return wanted.select(*PAGE, "region", "kind").join(hit, [*PAGE, "region"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def tally(scored: DataFrame) -> DataFrame:
    """By document, values by status, and the percentages leaked and damaged."""
    n = {s: F.count_if(F.col("status") == s) for s in ("replaced", "leaked", "kept", "damaged")}
    rows = scored.groupBy("doc_id").agg(*[c.alias(s) for s, c in n.items()])
    percent = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 2)
    return rows.withColumn("leaked_percent", percent("leaked", "replaced")).withColumn("damaged_percent", percent("damaged", "kept"))


def offset_consistency(shifted: DataFrame) -> DataFrame:
    """(doc_id, n_offsets, consistent) of dates moved (doc_id, before, after: dates): one offset, and not none."""
    rows = shifted.groupBy("doc_id").agg(F.count_distinct(F.datediff("after", "before")).alias("n_offsets"), F.bool_or(F.datediff("after", "before") == 0).alias("still"))
    return rows.select("doc_id", "n_offsets", ((F.col("n_offsets") <= 1) & ~F.col("still")).alias("consistent"))


def explained_by(values: DataFrame, replacements: DataFrame) -> DataFrame:
    """``values`` (doc_id, value) with explained: its key, of 3 or more, is in a replacement's (doc_id, by) or holds one."""
    key = match_key(F.col("value"))
    by = replacements.groupBy("doc_id").agg(F.collect_set(match_key(F.col("by"))).alias("keys"))  # as many as a document has
    inside = F.exists("keys", lambda r: F.contains(r, key) | ((F.length(r) >= 3) & F.contains(key, r)))
    return values.join(by, "doc_id", "left").select("doc_id", "value", ((F.length(key) >= 3) & F.coalesce(inside, F.lit(False))).alias("explained"))


def near_originals(made: DataFrame, originals: DataFrame) -> DataFrame:
    """Keys ``made`` (doc_id, key) that equal an original's (doc_id, key) or, of 5 or more, are one edit from one."""
    o = originals.select("doc_id", F.col("key").alias("original")).distinct()
    both = made.join(o, "doc_id")
    close = (F.length("key") >= 5) & (F.length("original") >= 5) & F.levenshtein("key", "original", 1).isin(0, 1)
    return both.where((F.col("key") == F.col("original")) | close).select("doc_id", "key").distinct()


def unique_cluster(partials: DataFrame, clusters: DataFrame) -> DataFrame:
    """Partial names (doc_id, mention, surname, initial, gender) with the one cluster (doc_id, cluster, surname, given,
    gender) that fits; none where none or several do.  Gender decides only between several."""
    c = clusters.select("doc_id", "surname", "cluster", "given", F.col("gender").alias("c_gender"))
    fits = partials.join(c, ["doc_id", "surname"]).where(F.col("initial").isNull() | F.startswith("given", F.lower("initial")))
    mine = Window.partitionBy("doc_id", "mention")
    agrees = (F.col("gender") == "u") | F.col("c_gender").isin("u") | (F.col("c_gender") == F.col("gender"))
    fits = fits.withColumn("n", F.count("*").over(mine)).withColumn("agrees", agrees).withColumn("n_agree", F.count_if("agrees").over(mine))
    left = fits.where((F.col("n") == 1) | F.col("agrees") | (F.col("n_agree") == 0))
    one = left.withColumn("left", F.count("*").over(mine)).where("left = 1").select("doc_id", "mention", "cluster")
    return partials.select("doc_id", "mention").join(one, ["doc_id", "mention"], "left")


def majority_gender(votes: DataFrame, *by: str) -> DataFrame:
    """(by..., gender) of votes (by..., gender: m, f, u): the more frequent of m and f, u where neither is."""
    rows = votes.groupBy(*by).agg(F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f"))
    return rows.select(*by, F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("u").alias("gender"))


def family_check(clusters: DataFrame) -> DataFrame:
    """Clusters (doc_id, cluster, surname, candidate) that stay candidates: nobody else with the surname isn't one."""
    other = clusters.groupBy("doc_id", "surname").agg(F.bool_or(~F.col("candidate")).alias("shared"))
    tainted = clusters.join(other.where("shared"), ["doc_id", "surname"]).select("doc_id", "cluster").distinct()
    return clusters.where("candidate").select("doc_id", "cluster").distinct().join(tainted, ["doc_id", "cluster"], "left_anti")


def number_clusters(names: DataFrame) -> DataFrame:
    """``names`` (doc_id, mention, surname, given) with P000, P001, ... by surname and first given name."""
    order = Window.partitionBy("doc_id").orderBy("surname", "given")
    return names.withColumn("cluster", F.format_string("P%03d", F.dense_rank().over(order) - 1))


def low_evidence(groups: DataFrame) -> DataFrame:
    """(entity_type, detector, rule, n) of groups that weren't accepted (entity_type, evidence)."""
    return groups.select("entity_type", F.explode("evidence").alias("e")).groupBy("entity_type", "e.detector", "e.rule").agg(F.count("*").alias("n"))


def assembled(mentions: DataFrame, ops: DataFrame) -> DataFrame:
    """``mentions`` (doc_id, mention) with what was drawn for them: operations (doc_id, op, ref, covers) that name them,
    and those that cover them, in order."""
    own = ops.where("ref is not null").select("doc_id", F.col("ref").alias("mention"), "op")
    whole = ops.select("doc_id", F.explode("covers").alias("mention"), "op")
    drawn = own.unionByName(whole).distinct().groupBy("doc_id", "mention").agg(F.array_sort(F.collect_list("op")).alias("ops"))
    return mentions.join(drawn, ["doc_id", "mention"], "left").withColumn("ops", F.coalesce("ops", F.array().cast(ops.schema["op"].dataType.simpleString().join(["array<", ">"]))))
