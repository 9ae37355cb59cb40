"""Rule detectors: pattern, context and check digits to candidate rows.

Each rule is data: the pattern, whose group 1 is the span, a cue that has to stand before it on the line, a check on
its digits, and the type and strength in each case.  One scan of the text evaluates all rules; candidates are
(doc_id, view, entity_type, start, end, value, detector, rule, strength, score), strength 2 strong and 1 weak.
Classes are ASCII, as the driver data and the identifiers are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions.spans import spans
from ..functions.text import digits_only, line_prefix, ocr_normalise

STRONG, WEAK = 2, 1

# Patterns, cues, prefix widths and rule names of the detection rules.
_S = r"[ \t\-]?"
_L, _R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
CUES = {
    "medicare": r"(?i)\b(medicare|mcn|medicare card)\b",
    "ihi": r"(?i)\b(ihi|hpi-?[io]|healthcare identifier)\b",
    "tfn": r"(?i)\b(tfn|tax file)\b",
    "abn": r"(?i)\babn\b",
    "acn": r"(?i)\bacn\b",
    "provider": r"(?i)\b(provider|prov\.?|prescriber)\b",
    "crn": r"(?i)\b(crn|centrelink|customer reference|concession|pension|health care card)\b",
    "ndis": r"(?i)\bndis\b",
    "passport": r"(?i)\bpassport\b",
    "dva": r"(?i)\b(dva|veteran|gold card|white card|orange card)\b",
    "phone": r"(?i)(\b(ph|phone|tel|telephone|mob|mobile|cell|fax|facsimile|contact|call|landline)\b|\b[ptfm]\s*:)",
    "dob": r"(?i)(\bd\.?[ \t]?o\.?[ \t]?b\b|date[ \t]+of[ \t]+birth|\bbirth[ \t]?date|\bborn\b|\bdob\b)",
    "dod": r"(?i)(\bd\.?[ \t]?o\.?[ \t]?d\b|date[ \t]+of[ \t]+death|\bdied\b|\bdeceased\b)",
}
PATTERNS = {
    "medicare": _L + rf"[2-6]\d{{3}}{_S}\d{{5}}{_S}\d(?:[ \t\-/]{{0,2}}\d)?" + _R,
    "ihi": rf"(?<![0-9])8003{_S}6[0-2]\d{{2}}{_S}\d{{4}}{_S}\d{{4}}(?![0-9])",
    "nine": rf"(?<![0-9])\d{{3}}{_S}\d{{3}}{_S}\d{{2,3}}(?![0-9])",
    "abn": rf"(?<![0-9])\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}(?![0-9])",
    "provider": _L + r"\d{5,6}[0-9A-HJ-NP-RT-Y][ABFHJKLTWXY]" + _R,
    "ahpra": _L + r"[A-Z]{3}\d{10}" + _R,
    "dva": _L + r"[NVQWST][A-Z]{0,3}[ \t]?\d{1,6}[A-Z]?" + _R,
    "crn": _L + rf"\d{{3}}{_S}\d{{3}}{_S}\d{{3}}[ \t]?[A-Za-z]" + _R,
    "passport": _L + r"[A-Z]{1,2}[ \t]?\d{7}" + _R,
    "ndis": rf"(?<![0-9])\d{{3}}{_S}\d{{3}}{_S}\d{{3}}(?![0-9])",
    # a number written in one run is taken alone, whatever digits stand before or behind it
    "card": r"(?<![0-9])(?:[3-6]\d{12,18}|[3-6](?:\d|[ \t\-](?!\d{13})\d){12,18})(?![0-9])",
    "vin": _L + r"[A-HJ-NPR-Z0-9]{17}" + _R,
    "ipv4": r"(?<![0-9.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![0-9.])",
    "mobile": rf"(?<![0-9+])(?:\+?61{_S}|0)4\d{{2}}{_S}\d{{3}}{_S}\d{{3}}(?![0-9])",
    "landline": rf"(?<![0-9+])(?:\(0[2378]\)|\+?61{_S}\(?0?[2378]\)?|0[2378]){_S}\d{{4}}{_S}\d{{4}}(?![0-9])",
    "business": rf"(?<![0-9])1[38]00{_S}\d{{3}}{_S}\d{{3}}(?![0-9])",
    "thirteen": rf"(?<![0-9])13{_S}\d{{2}}{_S}\d{{2}}(?![0-9])",
    "local8": rf"(?<![0-9])\d{{4}}{_S}\d{{4}}(?![0-9])",
    "international": rf"(?<![0-9])\+\d{{1,3}}{_S}(?:\(\d{{1,4}}\){_S})?\d{{1,4}}(?:{_S}\d{{2,4}}){{2,4}}(?![0-9])",
    "email": r"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._%+'\-]*[ \t]?@[ \t]?[A-Za-z0-9\-]+(?:[ \t]?\.[ \t]?[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9\-])",
    "url": r"""(?<![\w@])(?:https?://|www\.)[^\s<>"']+[^\s<>"'.,;:)\]]""",
    "numeric_date": r"(?<![0-9/\-])(?<![0-9]\.)\d{1,2}[ \t]?([/.\-])[ \t]?\d{1,2}[ \t]?\2[ \t]?(?:\d{4}|\d{2})(?![0-9/\-])(?!\.[0-9])",
    "iso_date": r"(?<![0-9])(?:18|19|20)\d{2}-\d{2}-\d{2}(?![0-9])",
    "dmy_date": rf"(?i:(?<![A-Za-z0-9])\d{{1,2}}(?:st|nd|rd|th)?(?:[ \t]+of)?[ \t]*[\-.,]?[ \t]*(?:{MONTHS})\.?,?[ \t\-.]*(?:(?:18|19|20)\d{{2}}|'?\d{{2}})(?![0-9]))",
    "mdy_date": rf"(?i:(?<![A-Za-z])(?:{MONTHS})\.?[ \t]+\d{{1,2}}(?:st|nd|rd|th)?,?[ \t]+(?:18|19|20)\d{{2}}(?![0-9]))",
    "po_box": r"(?i:(?<![A-Za-z])(?:P\.?[ \t]?O\.?[ \t]*Box|G\.?P\.?O\.?[ \t]+Box|Locked[ \t]+Bag|Private[ \t]+Bag|PMB|RMB|RSD|CMB)[ \t]*\d+[A-Za-z]?(?![A-Za-z0-9]))",
    "generic": r"(?<![A-Za-z0-9$])[A-Za-z0-9][A-Za-z0-9/\-]{4,}[A-Za-z0-9](?![A-Za-z0-9.%])",
    "aged": r"(?i:(?<![A-Za-z])(?:aged|age[ \t]*[:\-]|age[ \t]+of)[ \t]*(?:1[0-2]\d|\d{1,2})(?![0-9]))",
    "years_old": r"(?i:(?<![0-9])(?:1[0-2]\d|\d{1,2})[ \t]*[\-‐]?[ \t]*(?:years?|yrs?|y)[ \t]*[\-‐]?[ \t]*(?:old|of[ \t]+age)(?![A-Za-z]))",
    "yo": r"(?i:(?<![0-9A-Za-z])(?:1[0-2]\d|\d{1,2})[ \t]?(?:yo|y\.o\.?|y/o)(?![A-Za-z]))",
    "file_name": r"(?i:(?<![\w.\\/@\-])\w[\w\-.()]*\.(?:docx?|dotx?|pdf|rtf|txt|odt|xlsx?|csv|pptx?|msg|eml|jpe?g|png|tiff?|heic|bmp|gif|zip|wpd|html?|xml)(?![\w\\/]|\.\w))",
}
UNIT_SUFFIX = r"(?i)(?:mg|mcg|ug|ml|l|iu|units?|kg|g|cm|mm|m|km|mmol|umol|mmhg|bpm|hrs?|mins?|yrs?|kj|cal)$"
YEAR_RANGE, RATIO = r"^(?:19|20)\d{2}[-/](?:19|20)?\d{2}$", r"^\d{2,3}/\d{2,3}$"


@dataclass(frozen=True)
class Rule:
    """``decide`` maps (value, prefix) to a struct (entity_type, rule, strength) or null for no candidate."""

    detector: str
    pattern: str
    decide: Callable[[Column, Column], Column]
    width: int = 40
    normalised: bool = False  # also on the view with digits for look-alike letters
    score: float = 1.0


def _is(entity: str, rule: str, strength: int = STRONG) -> Column:
    return F.struct(F.lit(entity).alias("entity_type"), F.lit(rule).alias("rule"), F.lit(strength).alias("strength"))


def _cue(prefix: Column, name: str) -> Column:
    return prefix.rlike(CUES[name])


def _checked(entity: str, name: str, check: Callable[[Column], Column], passed: str, cue: str) -> Callable[[Column, Column], Column]:
    return lambda v, p: F.when(check(digits_only(v)), _is(entity, passed)).when(_cue(p, cue), _is(entity, f"{name}.context"))


def _nine(v: Column, p: Column) -> Column:
    d = digits_only(v)
    nine = F.length(d) == 9
    return (
        F.when(_cue(p, "tfn"), _is("tfn", "tfn.context"))
        .when(_cue(p, "acn") & nine, _is("acn", "acn.context"))
        .when(_cue(p, "ndis") & nine, _is("ndis", "ndis.context"))
        .when(nine & C.acn_valid(d) & C.tfn_valid(d), _is("other_id", "nine_digit.checksums", WEAK))
        .when(C.tfn_valid(d), _is("tfn", "tfn.checksum", WEAK))
    )


def _ihi(v: Column, p: Column) -> Column:
    d = digits_only(v)
    own = lambda rule: F.when(d.startswith("800360"), _is("ihi", rule)).otherwise(_is("hpi", rule))
    return F.when(C.ihi_valid(d), own("ihi.luhn")).when(_cue(p, "ihi"), own("ihi.context"))


def _date(shape: str) -> Callable[[Column, Column], Column]:
    def decide(v: Column, p: Column) -> Column:
        number = lambda i: F.get(F.regexp_extract_all(v, F.lit("([0-9]+)"), F.lit(1)), F.lit(i)).cast("int")
        if shape == "numeric":
            d, m = number(0), number(1)
            valid = (d.between(1, 31) & m.between(1, 12)) | (m.between(1, 31) & d.between(1, 12))
        elif shape == "iso":
            valid = number(1).between(1, 12) & number(2).between(1, 31)
        else:
            valid = number(0).between(1, 31)
        rule = f"date.{shape}"
        return F.when(valid, F.when(_cue(p, "dob"), _is("date_of_birth", rule)).when(_cue(p, "dod"), _is("date_of_death", rule)).otherwise(_is("date", rule)))

    return decide


def _generic(v: Column, p: Column) -> Column:
    return F.when((F.length(digits_only(v)) >= 5) & ~v.rlike(UNIT_SUFFIX) & ~v.rlike(YEAR_RANGE) & ~v.rlike(RATIO), _is("other_id", "generic.alnum", WEAK))


def _vin(v: Column, p: Column) -> Column:
    return F.when((F.length(digits_only(v)) >= 3) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 3), _is("vin", "vin.format"))


def _card(v: Column, p: Column) -> Column:
    d = digits_only(v)
    return F.when(F.length(d).between(13, 19) & C.luhn_valid(d), _is("card_number", "card.luhn"))


def _abn(v: Column, p: Column) -> Column:
    cue = _cue(p, "abn")
    return F.when(C.abn_valid(digits_only(v)), F.when(cue, _is("abn", "abn.checksum")).otherwise(_is("abn", "abn.checksum", WEAK))).when(cue, _is("abn", "abn.context"))


def _always(entity: str, rule: str) -> Callable[[Column, Column], Column]:
    return lambda v, p: _is(entity, rule)


def _with(cue: str, entity: str, rule: str) -> Callable[[Column, Column], Column]:
    return lambda v, p: F.when(_cue(p, cue), _is(entity, rule))


IDS, CONTACT, DATES, ADDRESS, GENERIC, AGES, FILES = "rules.au_ids", "rules.contact", "rules.dates", "rules.address", "rules.generic_id", "rules.ages", "rules.files"
RULES: dict[str, Rule] = {
    "medicare": Rule(IDS, "medicare", _checked("medicare", "medicare", lambda d: C.medicare_valid(F.substring(d, 1, 10)), "medicare.checksum", "medicare"), normalised=True),
    "ihi": Rule(IDS, "ihi", _ihi, normalised=True),
    "nine": Rule(IDS, "nine", _nine, normalised=True),
    "abn": Rule(IDS, "abn", _abn, normalised=True),
    "provider": Rule(IDS, "provider", lambda v, p: F.when(C.provider_number_valid(v), _is("provider_number", "provider.checksum")).when(_cue(p, "provider"), _is("provider_number", "provider.context")), normalised=True),
    "ahpra": Rule(IDS, "ahpra", _always("ahpra", "ahpra.format"), normalised=True),
    "dva": Rule(IDS, "dva", _with("dva", "dva_file", "dva.context"), normalised=True),
    "crn": Rule(IDS, "crn", lambda v, p: F.when(_cue(p, "crn"), _is("crn", "crn.format")).otherwise(_is("crn", "crn.format", WEAK)), normalised=True),
    "passport": Rule(IDS, "passport", _with("passport", "passport", "passport.context"), normalised=True),
    "ndis": Rule(IDS, "ndis", _with("ndis", "ndis", "ndis.context"), normalised=True),
    "card": Rule(IDS, "card", _card, normalised=True),
    "vin": Rule(IDS, "vin", _vin, normalised=True),
    "ipv4": Rule(IDS, "ipv4", _always("ip_address", "ipv4"), normalised=True),
    "mobile": Rule(CONTACT, "mobile", _always("phone", "phone.mobile"), normalised=True),
    "landline": Rule(CONTACT, "landline", _always("phone", "phone.landline"), normalised=True),
    "business": Rule(CONTACT, "business", _always("phone", "phone.business"), normalised=True),
    "thirteen": Rule(CONTACT, "thirteen", _with("phone", "phone", "phone.thirteen"), 30, True),
    "local8": Rule(CONTACT, "local8", _with("phone", "phone", "phone.local8"), 30, True),
    "international": Rule(CONTACT, "international", _always("phone", "phone.international"), normalised=True),
    "email": Rule(CONTACT, "email", _always("email", "email")),
    "url": Rule(CONTACT, "url", _always("url", "url")),
    "numeric_date": Rule(DATES, "numeric_date", _date("numeric"), 28),
    "iso_date": Rule(DATES, "iso_date", _date("iso"), 28),
    "dmy_date": Rule(DATES, "dmy_date", _date("text"), 28),
    "mdy_date": Rule(DATES, "mdy_date", _date("text"), 28),
    "po_box": Rule(ADDRESS, "po_box", _always("street_address", "address.po_box")),
    "generic": Rule(GENERIC, "generic", _generic, score=0.5),
    "aged": Rule(AGES, "aged", _always("age", "age.aged")),
    "years_old": Rule(AGES, "years_old", _always("age", "age.years_old")),
    "yo": Rule(AGES, "yo", _always("age", "age.yo")),
    "file_name": Rule(FILES, "file_name", _always("file_path", "file.name")),
}


def _named(name: str, view: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(name).alias("name"), F.lit(view).alias("view"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


#: Rules that one scan evaluates; generated code stays below the size up to which it is compiled.
RULES_A_SCAN = 5


def detect(docs: DataFrame, names: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Candidates of (doc_id, text) by the named rules, all by default.  A scan for each few rules, no shuffle.

    ``where``: only matches (name, view, start, end, value) of ``text`` for which it is true.
    """
    wanted = list(names or RULES)
    found = None
    for at in range(0, len(wanted), RULES_A_SCAN):
        part = _scan(docs, wanted[at : at + RULES_A_SCAN], where)
        found = part if found is None else found.unionByName(part)
    if "generic" in wanted and len(wanted) > 1:
        # a code inside a date is none
        dates = [n for n in wanted if RULES[n].detector == DATES]
        if dates:
            inner = _scan(docs, dates).select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
            inside = (F.col("rule") == "generic.alnum") & (F.col("doc_id") == F.col("d")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
            found = found.join(inner, inside, "left_anti")
    return found


def _scan(docs: DataFrame, names: list[str], where: Column | None = None) -> DataFrame:
    normalised = any(RULES[n].normalised for n in names)
    views = docs.select("doc_id", "text", (ocr_normalise(F.col("text")) if normalised else F.col("text")).alias("digits"))
    found = []
    for name in names:
        rule = RULES[name]
        for view, column in (("line", "text"), ("ocr_normalised", "digits"))[: 1 + rule.normalised]:
            found.append(F.transform(spans(F.col(column), PATTERNS[rule.pattern]), _named(name, view)))
    hits = views.select("doc_id", "text", "digits", F.explode(F.concat(*found)).alias("hit")).select("doc_id", "text", "digits", "hit.*")
    if where is not None:
        hits = hits.where(where)
    shown = F.when(F.col("view") == "line", F.col("text")).otherwise(F.col("digits"))
    decided, detector, score = F.lit(None), F.lit(None).cast("string"), F.lit(1.0)
    for name in names:
        rule = RULES[name]
        mine = F.col("name") == name
        decided = F.when(mine, rule.decide(F.col("value"), line_prefix(shown, F.col("start"), rule.width))).otherwise(decided)
        detector = F.when(mine, F.lit(rule.detector)).otherwise(detector)
        score = F.when(mine, F.lit(rule.score)).otherwise(score)
    # by a generator, so that the rules' expression stands in the plan once
    found = F.struct(decided.alias("by"), detector.alias("detector"), score.alias("score"))
    rows = hits.select("doc_id", "view", "start", "end", "value", F.explode(F.filter(F.array(found), lambda x: x["by"].isNotNull())).alias("found"))
    # an age begins at its number
    begin = F.when(F.col("found.by.rule") == "age.aged", F.col("end") - F.length(F.regexp_extract("value", "([0-9]+)$", 1))).otherwise(F.col("start"))
    return rows.select(
        "doc_id", "view", "found.by.entity_type", begin.alias("start"), "end", F.substr("value", begin - F.col("start") + 1).alias("value"), "found.detector", "found.by.rule", "found.by.strength", "found.score"
    )
