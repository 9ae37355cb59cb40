"""Rules, fusion, propagation, policy and the whole flow on small cases."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import policy, propagate, surrogates
from veilframe.operators.detectors import detect
from veilframe.operators.fusion import fuse
from veilframe.operators.tokens import line_view, tokens
from veilframe.plans.flow import deidentify

HITS = [
    ("D.O.B. 3/7/62", "3/7/62", "date_of_birth"), ("Born on 14 March 1978 in Dubbo", "14 March 1978", "date_of_birth"), ("Ph: 02 9999 1234", "02 9999 1234", "phone"),
    ("Mob 0412 555 666", "0412 555 666", "phone"), ("Contact +61 412 555 666 after hours", "+61 412 555 666", "phone"), ("IHI: 8003 6081 6669 0503", "8003 6081 6669 0503", "ihi"),
    ("ABN 51 824 753 556", "51 824 753 556", "abn"), ("TFN: 123 456 782", "123 456 782", "tfn"), ("PO Box 77, Wagga Wagga NSW 2650", "PO Box 77", "street_address"),
    ("Registration No: MED0001234567", "MED0001234567", "ahpra"), ("Specimen No 24-117733", "24-117733", "other_id"), ("Email: j.citizen@bigpond.com.au", "j.citizen@bigpond.com.au", "email"),
    ("He was injured on 14/03/2023. Pain persists.", "14/03/2023", "date"), ("aged 92", "92", "age"), ("card 4111 1111 1111 1111", "4111 1111 1111 1111", "card_number"),
]
MISSES = [
    "BP 120/80, HR 72, temperature 36.8 degrees.", "Range of motion was reduced to 50% of normal at L4-5 and C5/6.", "Ibuprofen 400mg three times daily; 12500IU vitamin D weekly.",
    "He was reviewed in 2019-2021 and again in March 2022.", "The claimant reports 7/10 pain.", "Software build 2.14.03.2023 installed",
]


@pytest.fixture(scope="module")
def fused(spark):
    lines = [t for t, _, _ in HITS] + MISSES
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = fuse(detect(docs)).where("accepted").join(docs, "doc_id")
    return found.select("doc_id", "entity_type", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value")).collect()


@pytest.mark.parametrize("i", range(len(HITS)))
def test_hit(fused, i):
    _, value, kind = HITS[i]
    assert any(r["doc_id"] == i and value in r["value"] and r["entity_type"] == kind for r in fused), [r for r in fused if r["doc_id"] == i]


@pytest.mark.parametrize("i", range(len(MISSES)))
def test_miss(fused, i):
    assert not [r for r in fused if r["doc_id"] == len(HITS) + i and r["entity_type"] not in ("date", "age")]


def test_tokens_and_view(spark, rows):
    docs = spark.createDataFrame([(1, "Dear  Sir,\n\n yours\t 😀 x"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(line_view(docs).where("doc_id = 1"), "text") == [("Dear Sir,\nyours 😀 x",)]
    assert rows(tokens(docs), "text", "start", "end", "line_no", "token_id") == sorted([
        ("Dear", 0, 4, 0, "p0000.l0000.w000"), ("Sir,", 5, 9, 0, "p0000.l0000.w001"), ("yours", 10, 15, 1, "p0000.l0001.w000"), ("😀", 16, 17, 1, "p0000.l0001.w001"), ("x", 18, 19, 1, "p0000.l0001.w002"),
    ], key=repr)


def test_propagation(spark, rows):
    docs = spark.createDataFrame([(1, "Claim No: WC1234567\nFurther to claim WC1234567 we enclose.\nRef WC 1234567 was reopened.\nThe file wc-1234567 is closed.")], "doc_id long, text string")
    values = spark.createDataFrame([(1, "reference", "WC1234567")], "doc_id long, entity_type string, value string")
    assert propagate.exact(docs, values).count() == 4


def test_policy_is_complete(spark):
    assert policy.missing_actions(policy.policy_table(spark)).count() == 0


def test_dates(spark):
    shift = lambda v, d: spark.range(1).select(surrogates.shift_numeric_date(F.lit(v), d)).first()[0]
    assert [shift(*x) for x in (("14/03/2023", 47), ("3.7.62", 47), ("14-03-23", -14), ("2023-03-14", -40), ("28/02/2024", 1), ("31/02/2023", 10), ("next Tuesday", 10))] == [
        "30/04/2023", "19.8.62", "28-02-23", "2023-02-02", "29/02/2024", "[date]", "[date]"]


def test_flow_releases_and_hides(spark, rows):
    docs = spark.createDataFrame([(1, "write to a.b@mail.org or A.B@mail.org, host 10.1.2.3"), (2, "nothing here"), (3, "")], "doc_id long, text string")
    out = deidentify(docs, "broad", "label", ["email", "ipv4"])
    assert rows(out["output"])[0] == (1, "write to [EMAIL 1] or [EMAIL 1], host [IP ADDRESS 1]")
    assert {r[1] for r in rows(out["gate"])} == {"released"} and out["gate"].count() == 3
    made = deidentify(docs, "broad", "surrogate", ["email", "ipv4"], key=b"k" * 32)
    text = rows(made["output"])[0][1]
    assert "mail.org" not in text and "10.1.2.3" not in text and "@example." in text
    assert rows(deidentify(docs.repartition(7), "broad", "surrogate", ["email", "ipv4"], key=b"k" * 32)["output"]) == rows(made["output"])


@pytest.mark.parametrize(("column", "check"), [("error", "V1"), ("leaks", "V2"), ("residual", "V4"), ("unsafe", "V5"), ("changed", "V6")])
def test_each_check_quarantines(spark, rows, column, check):
    from veilframe.operators import manifest

    done = deidentify(spark.createDataFrame([(1, "a.b@mail.org"), (2, "x")], "doc_id long, text string"), "broad", "label", ["email"])["documents"]
    broken = done.withColumn(column, F.when(F.col("doc_id") == 1, F.lit("E" if column == "error" else 1)).otherwise(F.col(column)))
    assert rows(manifest.gate(broken, manifest.checks(broken))) == [(1, "quarantined", [check]), (2, "released", [])]


def test_documents_that_cannot_be_told_apart_are_not_read(spark, rows):
    docs = spark.createDataFrame([(1, "a@b.org"), (1, "c@d.org"), (2, None), (None, "x"), (None, "y"), (3, "ok")], "doc_id long, text string")
    out = deidentify(docs)
    assert rows(out["output"]) == [(3, "ok")]
    assert rows(out["gate"]) == sorted([(1, "quarantined", ["repeated_id"]), (2, "quarantined", ["no_text"]), (None, "quarantined", ["no_id"]), (3, "released", [])], key=repr)


def test_a_failing_document_is_quarantined_alone(spark, rows):
    from veilframe.operators import manifest
    from veilframe.operators.documents import process, settings_of

    # surrogates without a key fail where something is to be replaced
    docs = spark.createDataFrame([(1, "write to a@b.org"), (2, "nothing")], "doc_id long, text string")
    got = process(docs, settings_of("broad", "surrogate"), None)
    assert rows(got, "doc_id", "text", "error") == [(1, None, "TypeError"), (2, "nothing", None)]
    assert [r[:2] for r in rows(manifest.gate(got, manifest.checks(got)))] == [(1, "quarantined"), (2, "released")]


def test_surrogates_need_a_key(spark, monkeypatch):
    monkeypatch.delenv("VEILFRAME_KEY", raising=False)
    monkeypatch.delenv("VEILFRAME_DEVELOPMENT", raising=False)
    with pytest.raises(ValueError, match="VEILFRAME_KEY"):
        deidentify(spark.createDataFrame([], "doc_id long, text string"), style="surrogate")


def test_title_case_equals_python(spark, rows):
    import re

    from veilframe.functions.text import titlecase_capitals

    texts = ["TOKEN of MARY O'BRIEN-SMITH", "L'ÉCOLE ABC", "aBC ABCd AB-CD' X YZ", "", "ÀBC_DEF GHI9 JKL"]
    want = [re.sub(r"\b[A-Z][A-Z'\-]+\b", lambda m: m[0][0] + m[0][1:].lower(), t) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", titlecase_capitals(F.col("t")).alias("t"))
    assert [r["t"] for r in got.orderBy("i").collect()] == want


def test_long_lines_take_time_in_proportion(spark):
    import time

    long = spark.createDataFrame([(1, "word1 " * 200_000)], "doc_id long, text string")
    began = time.time()
    assert tokens(long).agg(F.max("end")).first()[0] == 1_199_999 and time.time() - began < 60
