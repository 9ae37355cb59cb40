"""Check digits, text functions and spans."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import text as T
from veilframe.functions.spans import spans

CASES = [
    (C.abn_valid, "51824753556", True), (C.abn_valid, "51824753557", False), (C.acn_valid, "000000019", True), (C.tfn_valid, "123456782", True),
    (C.luhn_valid, "4111111111111111", True), (C.luhn_valid, "0", False), (C.ihi_valid, "8003608166690503", True), (C.medicare_valid, "2953701511", False),
    (C.medicare_valid, "2953701500", False), (C.fictional_phone, "+61 491 570 006", True), (C.fictional_phone, "02 5550 1234", True), (C.fictional_phone, "02 9999 1234", False),
]


def test_checksums(spark):
    df = spark.range(1).select(*[f(F.lit(v)).alias(str(i)) for i, (f, v, _) in enumerate(CASES)])
    assert list(df.first()) == [x for _, _, x in CASES]


def test_null_and_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 20,)], "v string")
    for check in (C.abn_valid, C.acn_valid, C.tfn_valid, C.luhn_valid, C.ihi_valid, C.medicare_valid, C.provider_number_valid):
        assert [r[0] for r in df.select(check(F.col("v"))).collect()] == [None, False, False]


def test_text_views(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.titlecase_capitals(F.lit("Mr SMITH-JONES and O'BRIEN"))) == "Mr Smith-jones and O'brien"
    assert one(T.ocr_normalise(F.lit("2953 7O15O 1 and Ohio"))) == "2953 70150 1 and Ohio"
    assert one(T.line_prefix(F.lit("one\ntwo three"), F.lit(8), 4)) == "two "
    assert one(T.line_suffix(F.lit("one two\nthree"), F.lit(4), 9)) == "two"
    assert one(T.apply_case(F.lit("Jones"), F.lit("SMITH"))) == "JONES"
    assert tuple(one(T.split_name(F.lit("(Smith's,")))) == ("(", "Smith", "'s,")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 .@-é😀\n", max_size=40), min_size=1, max_size=8))
def test_spans_equal_finditer(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in (r"[a-z]+", r"(?<![0-9])1+", r"([ab])[ ]?\2"):
        plain = pattern.replace(r"\2", r"\1")
        for i, found in df.select("i", spans(F.col("t"), pattern)).collect():
            assert [(s["start"], s["end"], s["value"]) for s in found] == [(m.start(), m.end(), m.group(0)) for m in re.finditer(plain, texts[i])]


@pytest.mark.parametrize("value", ["", None])
def test_spans_of_nothing(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert (df.select(spans(F.col("t"), "x")).first()[0] or []) == []
