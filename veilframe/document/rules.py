"""The pattern rules on one document's views: identifiers, contacts, dates, addresses, ages and codes.

Patterns, cues and rule names are those of ``operators.detectors``, whose column expressions say the same for whole
tables; here all rules read a document once, next to what needs its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from ..operators.detectors import ADDRESS, AGES, CONTACT, CUES, DATES, GENERIC, IDS, PATTERNS, RATIO, UNIT_SUFFIX, YEAR_RANGE
from .checks import valid
from .view import View, digits_only
from .words import CAPITAL_CITIES, STATES, STREET_TYPES

STRONG, WEAK = 2, 1
_CUES = {name: re.compile(cue) for name, cue in CUES.items()}
# Letters that readers give for digits.
CONFUSED = str.maketrans("OoQDUIl|i!LJZzEASsGbTBgq", "000001111111223455667899")
_WORD, _DIGIT_WORD = re.compile(r"\S+", re.ASCII), re.compile(r"(?<!\S)[^\s\d]*+\d\S*", re.ASCII)
_NUMBER, _UNIT, _RANGE, _RATIO = re.compile(r"\d+"), re.compile(UNIT_SUFFIX), re.compile(YEAR_RANGE), re.compile(RATIO)
Decision = tuple[str, str, int] | None


class Hit(NamedTuple):
    start: int
    end: int
    entity_type: str
    detector: str
    rule: str
    strength: int
    score: float


def ocr_normalise(text: str) -> str:
    """Digits for look-alike letters in words that are at least half digits; of the same length."""

    def fix(m: re.Match) -> str:
        word = m[0]
        if word.isalpha() or (word.isdecimal() and word.isascii()):
            return word
        digits, letters = sum(c.isdigit() for c in word), sum(c.isalnum() for c in word)
        return word.translate(CONFUSED) if letters and 2 * digits >= letters else word

    return (_DIGIT_WORD if text.isascii() else _WORD).sub(fix, text)


def _checked(entity: str, passed: str, cue: str) -> Callable[[str, str], Decision]:
    def decide(v: str, before: str) -> Decision:
        if valid(entity, v):
            return entity, passed, STRONG
        return (entity, f"{passed.partition('.')[0]}.context", STRONG) if _CUES[cue].search(before) else None

    return decide


def _ihi(v: str, before: str) -> Decision:
    entity = "ihi" if digits_only(v).startswith("800360") else "hpi"
    if valid("ihi", v):
        return entity, "ihi.luhn", STRONG
    return (entity, "ihi.context", STRONG) if _CUES["ihi"].search(before) else None


def _nine(v: str, before: str) -> Decision:
    nine = len(digits_only(v)) == 9
    for cue in ("tfn", "acn", "ndis"):
        if (nine or cue == "tfn") and _CUES[cue].search(before):
            return cue, f"{cue}.context", STRONG
    if nine and valid("acn", v) and valid("tfn", v):
        return "other_id", "nine_digit.checksums", WEAK
    return ("tfn", "tfn.checksum", WEAK) if valid("tfn", v) else None


def _abn(v: str, before: str) -> Decision:
    cue = _CUES["abn"].search(before) is not None
    if valid("abn", v):
        return "abn", "abn.checksum", STRONG if cue else WEAK
    return ("abn", "abn.context", STRONG) if cue else None


def _with(cue: str, entity: str, rule: str, otherwise: int = 0) -> Callable[[str, str], Decision]:
    return lambda v, before: (entity, rule, STRONG) if _CUES[cue].search(before) else (entity, rule, otherwise) if otherwise else None


def _always(entity: str, rule: str) -> Callable[[str, str], Decision]:
    return lambda v, before: (entity, rule, STRONG)


def _card(v: str, before: str) -> Decision:
    return ("card_number", "card.luhn", STRONG) if 13 <= len(digits_only(v)) <= 19 and valid("card_number", v) else None


def _vin(v: str, before: str) -> Decision:
    return ("vin", "vin.format", STRONG) if sum(c.isdigit() for c in v) >= 3 and sum(c.isalpha() for c in v) >= 3 else None


def _date(shape: str) -> Callable[[str, str], Decision]:
    def decide(v: str, before: str) -> Decision:
        n = [int(x) for x in _NUMBER.findall(v)]
        if shape == "numeric":
            fits = (1 <= n[0] <= 31 and 1 <= n[1] <= 12) or (1 <= n[1] <= 31 and 1 <= n[0] <= 12)
        else:
            fits = 1 <= n[1] <= 12 and 1 <= n[2] <= 31 if shape == "iso" else 1 <= n[0] <= 31
        entity = "date_of_birth" if _CUES["dob"].search(before) else "date_of_death" if _CUES["dod"].search(before) else "date"
        return (entity, f"date.{shape}", STRONG) if fits else None

    return decide


def _generic(v: str, before: str) -> Decision:
    usual = _UNIT.search(v) or _RANGE.search(v) or _RATIO.search(v)
    return ("other_id", "generic.alnum", WEAK) if sum(c.isdigit() for c in v) >= 5 and not usual else None


#: By pattern: detector, characters of the line before the match that cues are looked for in, whether it is also read with digits for letters, decision.
RULES: dict[str, tuple[str, int, bool, Callable[[str, str], Decision]]] = {
    "medicare": (IDS, 40, True, _checked("medicare", "medicare.checksum", "medicare")),
    "ihi": (IDS, 40, True, _ihi),
    "nine": (IDS, 40, True, _nine),
    "abn": (IDS, 40, True, _abn),
    "provider": (IDS, 40, True, _checked("provider_number", "provider.checksum", "provider")),
    "ahpra": (IDS, 40, True, _always("ahpra", "ahpra.format")),
    "dva": (IDS, 40, True, _with("dva", "dva_file", "dva.context")),
    "crn": (IDS, 40, True, _with("crn", "crn", "crn.format", WEAK)),
    "passport": (IDS, 40, True, _with("passport", "passport", "passport.context")),
    "ndis": (IDS, 40, True, _with("ndis", "ndis", "ndis.context")),
    "card": (IDS, 40, True, _card),
    "vin": (IDS, 40, True, _vin),
    "ipv4": (IDS, 40, True, _always("ip_address", "ipv4")),
    "mobile": (CONTACT, 30, True, _always("phone", "phone.mobile")),
    "landline": (CONTACT, 30, True, _always("phone", "phone.landline")),
    "business": (CONTACT, 30, True, _always("phone", "phone.business")),
    "thirteen": (CONTACT, 30, True, _with("phone", "phone", "phone.thirteen")),
    "local8": (CONTACT, 30, True, _with("phone", "phone", "phone.local8")),
    "international": (CONTACT, 30, True, _always("phone", "phone.international")),
    "email": (CONTACT, 30, False, _always("email", "email")),
    "url": (CONTACT, 30, False, _always("url", "url")),
    "numeric_date": (DATES, 28, False, _date("numeric")),
    "iso_date": (DATES, 28, False, _date("iso")),
    "dmy_date": (DATES, 28, False, _date("text")),
    "mdy_date": (DATES, 28, False, _date("text")),
    "po_box": (ADDRESS, 40, False, _always("street_address", "address.po_box")),
    "generic": (GENERIC, 40, False, _generic),
    "aged": (AGES, 40, False, _always("age", "age.aged")),
    "years_old": (AGES, 40, False, _always("age", "age.years_old")),
    "yo": (AGES, 40, False, _always("age", "age.yo")),
}
#: ASCII classes, as the column expressions have them; the extra group keeps the numbers of back-references.
_FORMS = {name: re.compile(f"({PATTERNS[name]})", re.ASCII) for name in RULES}
# What each match of a pattern holds one of, letters in their small form; texts without are passed over.
_MONTH_HEADS = "jan feb mar apr may jun jul aug sep oct nov dec"
_NEEDS = {
    "email": "@", "ipv4": ".", "international": "+", "url": "http www.", "ihi": "8003", "business": "1300 1800", "thirteen": "13", "mobile": "04 61", "landline": "02 03 07 08 61",
    "numeric_date": "/ . -", "iso_date": "-", "dmy_date": _MONTH_HEADS, "mdy_date": _MONTH_HEADS, "po_box": "box bag pmb rmb rsd cmb", "aged": "age", "years_old": "old age", "yo": "yo y.o y/o",
}
_NEEDS = {name: tuple(heads.split(" ")) for name, heads in _NEEDS.items()}


def scan(view: View, names: list[str] | None = None) -> list[Hit]:
    """Hits of the rules, all by default; a code within a date is none."""
    text, out = view.text, []
    digits = ocr_normalise(text)
    some_digit = any(c in text for c in "0123456789")
    low = text.lower() if text == digits else text.lower() + "\n" + digits.lower()
    held = {head: head in low for heads in _NEEDS.values() for head in heads}
    for name in RULES if names is None else names:
        if name not in RULES or (name in _NEEDS and not any(map(held.__getitem__, _NEEDS[name]))) or (not some_digit and name not in ("email", "url") and digits == text):
            continue
        detector, width, normalised, decide = RULES[name]
        for body in (text, digits) if normalised and digits != text else (text,):
            for m in _FORMS[name].finditer(body):
                low = max(body.rfind("\n", 0, m.start()) + 1, m.start() - width)
                found = decide(m[0], body[low : m.start()])
                if found:
                    start = m.end() - len(_NUMBER.search(m[0])[0]) if name == "aged" else m.start()
                    out.append(Hit(start, m.end(), found[0], detector, found[1], found[2], 0.5 if name == "generic" else 1.0))
    dates = [(h.start, h.end) for h in out if h.detector == DATES]
    return [h for h in out if h.rule != "generic.alnum" or not any(a <= h.start and h.end <= b for a, b in dates)]


_UNITS = r"(?:(?:Unit|Apt|Apartment|Flat|Suite|Shop|Level|Lvl|Lot|U)\.?[ \t]*\d+[A-Za-z]?[ \t]*[,/]?[ \t]*)"
_NAME = r"(?:[A-Z][A-Za-z'\-]+|[A-Z]{2,})"
_TYPES = "|".join(STREET_TYPES)
_STREET = re.compile(rf"(?<![A-Za-z0-9]){_UNITS}?\d+[A-Za-z]?(?:[ \t]*[-/][ \t]*\d+[A-Za-z]?)?,?[ \t]+(?:{_NAME}[ \t]+){{1,3}}(?i:{_TYPES})\.?(?![A-Za-z])")
_LOCALITY = re.compile(rf"(?<![A-Za-z])((?:{_NAME})(?:[ \t]+{_NAME}){{0,3}}),?[ \t]+{STATES},?[ \t]+(\d{{4}})(?![0-9])")
_TO_STREET = re.compile(rf"(?i)(?:.*[ \t])?(?:{_TYPES})\.?(?:[ \t]+|$)")


def scan_addresses(view: View) -> list[Hit]:
    """Streets; places before a state and a postcode, from after the last street type on, but no capital cities."""
    out = [Hit(*m.span(), "street_address", ADDRESS, "address.street", STRONG, 1.0) for m in _STREET.finditer(view.text)]
    for m in _LOCALITY.finditer(view.text):
        begin, end = m.span(1)
        street = _TO_STREET.match(m[1])
        begin += street.end() if street else 0
        if begin < end and view.text[begin:end].lower() not in CAPITAL_CITIES:
            out.append(Hit(begin, end, "locality", ADDRESS, "address.locality", STRONG, 1.0))
        out.append(Hit(*m.span(2), "postcode", ADDRESS, "address.postcode", STRONG, 1.0))
    return out
