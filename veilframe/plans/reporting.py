"""Queries of the whole flow over all documents, its checks and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import fictional_phone
from ..operators import manifest, render
from ..operators import reports as R
from ..operators.detectors import detect
from ..operators.documents import persons_table, settings_of, with_unique_ids
from ..operators.policy import PROFILES
from ..operators.tokens import to_token_ranges, tokens
from ..sources import lines as L
from ..sources.tables import table
from .documents import EMAIL_RE2
from .flow import deidentify, deidentify_each

#: The key of the queries' surrogates; a fixed one, so that results can be compared.
QUERY_KEY = bytes(range(32))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def q_deidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only e-mail addresses, the part of the flow that SQL can say; q_deidentify_all runs all rules."""
    out = deidentify(_docs(spark, sf_dir), "broad", "label", ["email"])
    return out["output"].select("doc_id", F.md5("text").alias("text_md5"))


def q_deidentify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, profiles and styles: by both, what was done with how many mentions."""
    done, _ = deidentify_each(_docs(spark, sf_dir), [(p, s) for p in PROFILES for s in ("label", "surrogate", "blackout")], key=QUERY_KEY)
    rows = done.select("profile", "style", F.explode("mentions").alias("m")).groupBy("m.entity_type", "m.action", "profile", "style")
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("m.by")).alias("drawn")).select("entity_type", "action", "n", "drawn", "profile", "style")


#: A note for each customer, with all that the profiles treat differently.
_NOTE = (
    "concat('Claim No: WC', lpad(CAST(c_custkey AS STRING), 7, '0'), chr(10), 'Dr Mary Jones, aged ', CAST(c_custkey % 110 AS STRING), ', seen ', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), "
    "'/03/2023, Mob 0412 ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' 001')"
)


def q_flow_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow, all rules, by profile and style: what becomes of each customer's note, and its outcome."""
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_NOTE} AS text")
    wanted = [(p, s) for p in PROFILES for s in ("label", "blackout")]
    done, _ = deidentify_each(notes, wanted)  # a note that wasn't read has no row
    by = ("doc_id", "profile", "style")
    outcomes = manifest.gate(done, manifest.checks(done, by), by=by)
    return done.select(*by, "text").join(outcomes, list(by)).select(*by, "outcome", "text")


def q_flow_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates of the maximal profile: by how many days each note's date moved, which numbers are reserved ones, and
    whether anything of the original is left."""
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{_NOTE} AS text")
    out = deidentify(notes, "maximal", "surrogate", key=QUERY_KEY)
    date = F.to_date(F.regexp_extract("text", r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")
    moved = F.abs(F.datediff(date, F.make_date(F.lit(2023), F.lit(3), (F.col("doc_id") % 28 + 1).cast("int"))))
    phone = fictional_phone(F.regexp_extract("text", "Mob (.*)$", 1))
    left = F.contains("text", F.lit("Jones")) | F.contains("text", F.concat(F.lit("WC"), F.lpad(F.col("doc_id").cast("string"), 7, "0")))
    return out["output"].select(moved.between(30, 365).alias("moved"), phone.alias("fictional"), left.alias("left")).groupBy("moved", "fictional", "left").agg(F.count("*").alias("n"))


def q_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deidentify(_docs(spark, sf_dir), "maximal", "surrogate", key=QUERY_KEY)["replaced"]
    return out.select("doc_id", "start", "end", "entity_type", "action", F.length("by").alias("length"))


def q_release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify(_docs(spark, sf_dir), "broad", "label")["gate"].groupBy("outcome").agg(F.count("*").alias("n"))


def q_release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check of the maximal profile with surrogates: documents that pass and don't."""
    return deidentify(_docs(spark, sf_dir), "maximal", "surrogate", key=QUERY_KEY)["checks"].groupBy("check", "passed").agg(F.count("*").alias("n"), F.sum("problems").alias("problems"))


def q_refused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer as documents: customers with several orders share an id, some have no text."""
    text = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 2 * (F.col("o_custkey") % 3)).alias("doc_id"), text.alias("text"))
    good, bad = with_unique_ids(rows)
    return bad.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("read").alias("reason"), F.count("*").alias("n")))


def q_manifest_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = deidentify(docs, "broad", "label")
    return manifest.manifest(docs, out["decisions"], out["checks"], out["gate"], out["low_evidence"])


def q_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests read back: what the job list shows of each document."""
    return R.job_summary(q_manifest_canonical(spark, sf_dir))


def q_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.category_counts(deidentify(_docs(spark, sf_dir), "broad", "label")["decisions"])


def q_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons_table(_docs(spark, sf_dir), settings_of("broad", "label")).select("doc_id", "first", "last", "surname", "cluster", "gender")


def q_low_evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.low_evidence(deidentify(_docs(spark, sf_dir), "broad", "label")["low_evidence"])


def q_text_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses that are still in the text where nothing was replaced: all of them."""
    docs = _docs(spark, sf_dir)
    removed = detect(docs, ["email"]).select("doc_id", "value")
    return render.leaks(removed, docs).groupBy("doc_id").agg(F.count("*").alias("n_leaks"))


def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose length is the input's with each mention exchanged, by whether the check says so."""
    docs = _docs(spark, sf_dir)
    out = deidentify(docs, "broad", "label")
    change = out["replaced"].groupBy("doc_id").agg(F.sum(F.length("by") - (F.col("end") - F.col("start"))).alias("change"))
    sizes = docs.select("doc_id", F.length("text").alias("before")).join(out["output"].select("doc_id", F.length("text").alias("after")), "doc_id").join(change, "doc_id", "left")
    same = sizes.select("doc_id", (F.col("before") + F.coalesce("change", F.lit(0)) == F.col("after")).alias("same"))
    return out["checks"].where("check = 'V6'").join(same, "doc_id").groupBy("passed", "same").agg(F.count("*").alias("n"))


def q_span_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each e-mail address of the line view overlaps: a range join within documents."""
    from ..operators.tokens import line_view

    docs = _docs(spark, sf_dir)
    found = detect(line_view(docs), ["email"])
    ranges = to_token_ranges(found.select("doc_id", "start", "end"), tokens(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")))
    return ranges.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("n_tokens"))


def q_tsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader output (level, confidence, word) per event: words of level 5 with confidence of 0 or more."""
    lines = F.concat_ws("\t", (F.col("event_id") % 6).cast("string"), (F.col("user_id") % 101 - 1).cast("string"), F.col("event_type"))
    return L.parse_tsv(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), lines.alias("text"))).groupBy("word").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (
    q_deidentify, q_deidentify_all, q_flow_notes, q_flow_shifts, q_surrogates, q_release_gate, q_release_checks, q_refused_ids, q_manifest_canonical, q_manifest_summary, q_category_counts, q_persons, q_low_evidence_rules, q_text_leak,
    q_integrity, q_span_to_tokens, q_tsv_parse,
)}

_HITS = f"regexp_extract_all(text, '{EMAIL_RE2}')"
#: A mention is whole tokens, but for the punctuation at its end.
_TOKEN = EMAIL_RE2 + r"""(?:[^\s]*[^\s)\]}"”,;:.!?])?"""
_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9_]+', '', 'g'))"
ORACLE_SQL = {
    "q_deidentify": f"""
        WITH e AS (SELECT doc_id, string_split_regex(text, '{_TOKEN}') AS gaps, regexp_extract_all(text, '{_TOKEN}') AS hits FROM documents),
             k AS (SELECT *, list_distinct(hits) AS u, list_transform(hits, lambda h: list_position(hits, h)) AS first FROM e),
             n AS (SELECT *, list_transform(first, lambda f: len(list_distinct(list_filter(first, lambda g: g <= f)))) AS no FROM k)
        SELECT doc_id, md5(array_to_string(list_transform(gaps, lambda g, i: g || CASE WHEN i <= len(hits) THEN '[EMAIL ' || CAST(no[i] AS VARCHAR) || ']' ELSE '' END), '')) AS text_md5 FROM n
    """,
    # every profile's differences written out: professionals, dates, and ages from 90 on
    "q_flow_notes": """
        WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 110 AS age, lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '/03/2023' AS day FROM customer),
             p AS (SELECT * FROM c, (VALUES ('broad'), ('client'), ('claimant_focused'), ('maximal')) p(profile), (VALUES ('label'), ('blackout')) s(style)),
             b AS (SELECT *, CASE style WHEN 'blackout' THEN '█████' END AS black FROM p)
        SELECT doc_id, profile, style, 'released' AS outcome, 'Claim No: ' || coalesce(black, '[ID 1]') || chr(10) || 'Dr ' || CASE WHEN profile = 'claimant_focused' THEN 'Mary Jones' ELSE coalesce(black, '[NAME 1]') END || ', aged '
               || CASE WHEN profile = 'maximal' AND age >= 90 THEN coalesce(black, '[AGE 1]') ELSE CAST(age AS VARCHAR) END || ', seen ' || CASE WHEN profile = 'maximal' THEN coalesce(black, '[DATE 1]') ELSE day END || ', Mob ' || coalesce(black, '[PHONE 1]') AS text FROM b
    """,
    "q_flow_shifts": "SELECT TRUE AS moved, TRUE AS fictional, FALSE AS left, count(*) AS n FROM customer",
    "q_release_gate": """
        SELECT CASE WHEN n = 1 AND doc_id IS NOT NULL AND NOT no_text THEN 'released' ELSE 'quarantined' END AS outcome, count(*) AS n
        FROM (SELECT doc_id, count(*) AS n, bool_or(text IS NULL) AS no_text FROM documents GROUP BY 1) GROUP BY 1
    """,
    "q_refused_ids": """
        WITH d AS (SELECT CASE WHEN o_custkey % 50 <> 0 THEN o_orderkey - o_orderkey % 2 * (o_custkey % 3) END AS doc_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS text FROM orders),
             g AS (SELECT doc_id, count(*) AS n, bool_or(text IS NULL) AS no_text FROM d GROUP BY 1)
        SELECT CASE WHEN doc_id IS NULL THEN 'no_id' WHEN n > 1 THEN 'repeated_id' WHEN no_text THEN 'no_text' ELSE 'read' END AS reason, count(*) AS n FROM g GROUP BY 1
    """,
    "q_text_leak": f"SELECT doc_id, count(DISTINCT h) AS n_leaks FROM (SELECT doc_id, unnest({_HITS}) AS h FROM documents) WHERE length({_KEY.format('h')}) >= 4 GROUP BY 1",
    "q_span_to_tokens": f"SELECT doc_id, count(*) AS n_spans, count(*) AS n_tokens FROM (SELECT doc_id, unnest({_HITS}) AS h FROM documents) GROUP BY 1",
    "q_tsv_parse": "SELECT event_type AS word, count(*) AS n, CAST(sum(user_id % 101 - 1) AS DOUBLE) AS confidence FROM events WHERE event_id % 6 = 5 AND user_id % 101 - 1 >= 0 GROUP BY 1",
}
