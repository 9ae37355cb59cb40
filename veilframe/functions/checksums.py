"""Check digits of Australian identifiers as column expressions; digits come as strings.

A failed check never removes a labelled hit, a passed one raises an unlabelled hit; surrogates must fail them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and alphabets of the published check-digit rules.
MEDICARE = (1, 3, 7, 9, 1, 3, 7, 9)
TFN_9 = (1, 4, 3, 7, 5, 8, 6, 9, 10)
TFN_8 = (10, 7, 8, 4, 6, 3, 5, 1)
ABN = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN = (8, 7, 6, 5, 4, 3, 2, 1)
PROVIDER = (3, 5, 8, 4, 2, 1)
PROVIDER_LOCATIONS = "0123456789ABCDEFGHJKLMNPQRTUVWXY"
PROVIDER_CHECKS = "YXWTLKJHFBA"
IHI_PREFIXES = ("800360", "800361", "800362")


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i + 1, 1).cast("int")


def _weighted(x: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(x, i) * w
    return total


def _guard(shape: Column, check: Column) -> Column:
    """``check`` where the value has the right shape, else false; null stays null."""
    return F.when(shape, check).when(shape.isNotNull(), F.lit(False))


def medicare_valid(x: Column) -> Column:
    return _guard(x.rlike("^[2-6][0-9]{8}[1-9]$"), _weighted(x, MEDICARE) % 10 == _digit(x, 8))


def luhn_valid(x: Column) -> Column:
    return _guard(x.rlike("^[0-9]{2,}$"), F.call_function("luhn_check", x))


def ihi_valid(x: Column) -> Column:
    return _guard(x.rlike("^[0-9]{16}$"), F.substring(x, 1, 6).isin(*IHI_PREFIXES) & F.call_function("luhn_check", x))


def tfn_valid(x: Column) -> Column:
    nine, eight = _weighted(x, TFN_9) % 11 == 0, _weighted(x, TFN_8) % 11 == 0
    return _guard(x.rlike("^[0-9]{8,9}$"), F.when(F.length(x) == 9, nine).otherwise(eight))


def abn_valid(x: Column) -> Column:
    return _guard(x.rlike("^[1-9][0-9]{10}$"), (_weighted(x, ABN) - ABN[0]) % 89 == 0)


def acn_valid(x: Column) -> Column:
    return _guard(x.rlike("^[0-9]{9}$"), (10 - _weighted(x, ACN) % 10) % 10 == _digit(x, 8))


def provider_number_valid(x: Column) -> Column:
    full = F.when(F.length(x) == 7, F.concat(F.lit("0"), x)).otherwise(x)
    place = F.instr(F.lit(PROVIDER_LOCATIONS), F.substring(full, 7, 1)) - 1
    total = (_weighted(full, PROVIDER) + place * 6) % 11
    shape = full.rlike(f"^[0-9]{{6}}[{PROVIDER_LOCATIONS}][{PROVIDER_CHECKS}]$")
    return _guard(shape, F.substr(F.lit(PROVIDER_CHECKS), total + 1, F.lit(1)) == F.substring(full, 8, 1))


# Mobile and freephone numbers that the Australian numbering authority reserves for fiction.
FICTIONAL_MOBILES = (
    "0491570006", "0491570156", "0491570157", "0491570158", "0491570159", "0491570110", "0491570313",
    "0491570737", "0491571266", "0491571491", "0491571804", "0491572549", "0491572665", "0491572983",
    "0491573770", "0491573087", "0491574118", "0491574632", "0491575254", "0491575789", "0491576398",
    "0491576801", "0491577426", "0491577644", "0491578957", "0491578148", "0491578888", "0491579212",
    "0491579760", "0491579455",
)
FICTIONAL_SPECIAL = (
    "1800160401", "1800975707", "1800975708", "1800975709", "1800975710", "1800975711",
    "1300975707", "1300975708", "1300975709", "1300975710", "1300975711",
)


def fictional_phone(value: Column) -> Column:
    """A number from the ranges that are reserved for fiction, in any layout."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    local = F.when(digits.startswith("61"), F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).otherwise(digits)
    return local.isin(*FICTIONAL_MOBILES, *FICTIONAL_SPECIAL) | local.rlike("^0[2378](5550|7010)[0-9]{4}$")
