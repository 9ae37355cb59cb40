"""Values next to a label: on its line, in the cell to the right, or on the line below."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

from .names import read_name
from .view import View, trimmed, union

# The labels' rule names, patterns, types, kinds of value, and whether a separator has to follow.
_W = "[ \\t]"
_NO = rf"(?:{_W}*(?:no\.?|number|num\.?|#))"
LABELS = (
    ("label.name.party", rf"(?:patient|client|claimant|worker|injured{_W}+worker|employee|insured|applicant|plaintiff|defendant|respondent|appellant|deceased|examinee|participant|resident|veteran)(?:'?s)?(?:{_W}+(?:full{_W}+)?name)?", "person", "name", True),
    ("label.name", rf"(?:(?:full|given|first|last|family|middle|maiden|preferred|previous|other|christian){_W}+)?names?|surname|forenames?|also{_W}+known{_W}+as|a\.?k\.?a\.?|n[ée]e|formerly", "person", "name", True),
    ("label.re", rf"re|regarding|subject|our{_W}+client|your{_W}+client|in{_W}+the{_W}+matter{_W}+of", "person", "name", True),
    ("label.kin", rf"next{_W}+of{_W}+kin|nok|emergency{_W}+contact|spouse|partner|mother|father|guardian|parent|husband|wife|carer", "person", "name", True),
    ("label.professional", rf"(?:(?:referring|treating|attending|usual|nominated|reporting|requesting|examining){_W}+)?(?:doctor|dr|gp|practitioner|specialist|surgeon|physician|psychiatrist|psychologist|physiotherapist|case{_W}+manager|claims?{_W}+(?:officer|manager|consultant)|solicitor|lawyer|barrister|counsel|contact(?:{_W}+person)?|attention|attn|signed|witness|interpreter|author|reported{_W}+by|dictated{_W}+by|prepared{_W}+by|referred{_W}+by|copy{_W}+to|cc)", "person", "name", True),
    ("label.claim", rf"claim(?:{_NO}|{_W}*ref(?:erence)?)", "reference", "id", False),
    ("label.claim_colon", r"claim", "reference", "id", True),
    ("label.policy", rf"policy{_NO}?", "reference", "id", True),
    ("label.ref", rf"(?:our|your|my|insurer'?s?|file|matter|case|job|client|scheme|agent'?s?){_W}*ref(?:erence)?\.?{_NO}?", "reference", "id", False),
    ("label.ref_generic", rf"ref(?:erence)?\.?{_NO}?", "reference", "id", True),
    ("label.file", rf"(?:file|matter|case|job|invoice|account){_NO}", "reference", "id", False),
    ("label.court", rf"(?:court|tribunal|commission|proceedings?|registry){_W}*(?:file{_W}*)?{_NO}", "court_file", "id", False),
    ("label.mrn", rf"(?:u\.?r\.?n?\.?|mrn|m\.r\.n\.?|medical{_W}+record|patient{_W}+(?:id|no\.?|number)|hospital{_W}+(?:no\.?|number|id)){_NO}?", "clinical_id", "id", True),
    ("label.episode", rf"(?:episode|admission|encounter|visit|accession|lab|specimen|request|study|order|sample)(?:{_NO}|{_W}*id)", "clinical_id", "id", False),
    ("label.medicare", rf"medicare(?:{_W}*card)?{_NO}?", "medicare", "id", False),
    ("label.dva", rf"(?:dva|veterans?'?{_W}+affairs)(?:{_W}*file)?{_NO}?", "dva_file", "id", False),
    ("label.crn", rf"crn|centrelink(?:{_W}*crn|{_NO})?|customer{_W}+reference{_NO}?", "crn", "id", False),
    ("label.tfn", rf"tfn|tax{_W}+file{_NO}", "tfn", "id", False),
    ("label.ndis", rf"ndis{_NO}?", "ndis", "id", False),
    ("label.licence", rf"(?:driver'?s?{_W}+)?licen[cs]e{_NO}|dl{_W}*(?:no\.?|#)|licen[cs]e{_W}+card{_NO}", "driver_licence", "id", False),
    ("label.passport", rf"passport{_NO}?", "passport", "id", False),
    ("label.provider", rf"provider{_NO}|prov\.?{_W}*no\.?|prescriber{_NO}", "provider_number", "id", False),
    ("label.ahpra", rf"ahpra(?:{_W}*reg(?:istration)?\.?)?{_NO}?|registration{_NO}", "ahpra", "id", False),
    ("label.ihi", rf"ihi|hpi-?[io]|healthcare{_W}+identifier", "ihi", "id", False),
    ("label.employee", rf"(?:employee|staff|payroll|member(?:ship)?|student|customer)(?:{_NO}|{_W}*id)", "employee_id", "id", False),
    ("label.bsb", r"bsb", "bank_account", "id", False),
    ("label.account", rf"(?:bank{_W}+)?(?:account|acc|a/c){_NO}", "bank_account", "id", False),
    ("label.vehicle", rf"(?:vehicle{_W}+)?(?:rego|registration{_W}+plate|reg\.?{_W}*no\.?|number{_W}+plate|plate{_NO}?)", "vehicle_reg", "id", False),
    ("label.abn", r"abn", "abn", "id", False),
    ("label.acn", r"acn", "acn", "id", False),
    ("label.dob", rf"d\.?{_W}?o\.?{_W}?b\.?|date{_W}+of{_W}+birth|birth{_W}*date", "date_of_birth", "date", False),
    ("label.dod", rf"d\.?{_W}?o\.?{_W}?d\.?|date{_W}+of{_W}+death", "date_of_death", "date", False),
    ("label.address", rf"(?:(?:residential|postal|home|street|mailing|current|previous|work|business|correspondence){_W}+)?address|addr\.?", "street_address", "address", True),
    ("label.phone", rf"(?:(?:home|work|business|contact|after{_W}+hours){_W}+)?(?:phone|ph|tel|telephone|mobile|mob|cell|fax|facsimile)\.?{_NO}?|contact{_NO}", "phone", "phone", False),
    ("label.email", rf"e-?mail(?:{_W}+address)?", "email", "email", False),
    ("label.employer", rf"employer|place{_W}+of{_W}+(?:employment|work)|employed{_W}+(?:by|at|with)|works?{_W}+(?:at|for)|working{_W}+(?:at|for)", "organisation", "org", False),
    ("label.org", r"company|workplace|school|university|college|tafe", "organisation", "org", True),
    ("label.locality", r"suburb|town|city|locality", "locality", "free", True),
    ("label.postcode", r"post[ \t]?code|p/code|pcode", "postcode", "id", False),
)
_ID_WORDS, _ORG_WORDS, _FREE_WORDS, _NAME_WORDS = 4, 8, 6, 6
_LINKS = frozenset("& and of the pty ltd p/l inc limited co (aust) t/as t/a".split())
_COMPANY = frozenset("pty ltd co inc".split())
_PHONE = re.compile(r"[+(]?\d[\d ()+\-]{4,}\d")
_EMAIL = re.compile(r"[A-Za-z0-9._%+'\-]+[ \t]?@[ \t]?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
_MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE = re.compile(
    rf"(?i)(?<![0-9/\-])(?:\d{{1,2}}[ \t]?(?P<s>[/.\-])[ \t]?\d{{1,2}}[ \t]?(?P=s)[ \t]?(?:\d{{4}}|\d{{2}})(?![0-9/\-])|(?:18|19|20)\d{{2}}-\d{{2}}-\d{{2}}(?![0-9])"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?(?:[ \t]+of)?[ \t]*[\-.,]?[ \t]*{_MONTHS}\.?,?[ \t\-.]*(?:(?:18|19|20)\d{{2}}|'?\d{{2}})(?![0-9])|{_MONTHS}\.?[ \t]+\d{{1,2}}(?:st|nd|rd|th)?,?[ \t]+(?:18|19|20)\d{{2}}(?![0-9]))"
)

_SEPARATORS = {True: r"[ \t]*[:#\-–][ \t]*", False: r"[ \t]*[:#\-–]?[ \t]*"}
_FORMS = [(rule, re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z])" + _SEPARATORS[needs]), entity, kind) for rule, pattern, entity, kind, needs in LABELS]
#: Letters that each label's match has one of, whatever its form; a text without them isn't searched for the label.
_HEADS = {
    "label.name.party": "patient client claimant worker employee insured applicant plaintiff defendant respondent appellant deceased examinee participant resident veteran",
    "label.name": "name known a.k aka née nee formerly", "label.re": "re subject client matter", "label.kin": "kin nok emergency spouse partner mother father guardian parent husband wife carer",
    "label.professional": "doctor dr gp practitioner specialist surgeon physician psychiatrist psychologist physiotherapist manager officer consultant solicitor lawyer barrister counsel contact att signed witness interpreter author by copy cc",
    "label.claim": "claim", "label.claim_colon": "claim", "label.policy": "policy", "label.ref": "ref", "label.ref_generic": "ref", "label.file": "file matter case job invoice account",
    "label.court": "court tribunal commission proceeding registry", "label.mrn": "ur u.r mr m.r medical patient hospital", "label.episode": "episode admission encounter visit accession lab specimen request study order sample",
    "label.medicare": "medicare", "label.dva": "dva affairs", "label.crn": "crn centrelink customer", "label.tfn": "tfn tax", "label.ndis": "ndis", "label.licence": "licen dl", "label.passport": "passport",
    "label.provider": "prov prescriber", "label.ahpra": "ahpra registration", "label.ihi": "ihi hpi healthcare", "label.employee": "employee staff payroll member student customer", "label.bsb": "bsb",
    "label.account": "acc a/c", "label.vehicle": "reg plate", "label.abn": "abn", "label.acn": "acn", "label.dob": "d birth", "label.dod": "d death", "label.address": "addr",
    "label.phone": "ph tel mob cell fax facsimile contact", "label.email": "mail", "label.employer": "employ place work", "label.org": "company workplace school university college tafe",
    "label.locality": "suburb town city locality", "label.postcode": "post p/code pcode",
}
_HEADS = {rule: frozenset(heads.split(" ")) for rule, heads in _HEADS.items()}
_ALL_HEADS = sorted(frozenset().union(*_HEADS.values()))
#: Letters that each label's match begins with one of.
_FIRST = {
    "label.name.party": "pcwieadrv", "label.name": "fglmpocnsa", "label.re": "rsoyi", "label.kin": "nespmfghwc", "label.professional": "rtaunedgpsclbwi", "label.claim": "c", "label.claim_colon": "c", "label.policy": "p",
    "label.ref": "oymifcjsa", "label.ref_generic": "r", "label.file": "fmcjia", "label.court": "ctpr", "label.mrn": "umph", "label.episode": "eavlsro", "label.medicare": "m", "label.dva": "dv", "label.crn": "c", "label.tfn": "t",
    "label.ndis": "n", "label.licence": "dl", "label.passport": "p", "label.provider": "p", "label.ahpra": "ar", "label.ihi": "ih", "label.employee": "espmc", "label.bsb": "b", "label.account": "ba", "label.vehicle": "vrnp",
    "label.abn": "a", "label.acn": "a", "label.dob": "db", "label.dod": "d", "label.address": "rphsmcwba", "label.phone": "hwbcaptmf", "label.email": "e", "label.employer": "epw", "label.org": "cwsut",
    "label.locality": "stcl", "label.postcode": "p",
}
#: A word's first letter, and what stands for one where case is ignored.
_START, _SAME = re.compile(r"(?<![A-Za-z0-9])[A-Za-zſıİ]"), {"ſ": "s", "ı": "i", "İ": "i"}
#: Characters that a form is searched through in the time in which it is tried at one place.
_A_TRY = 6
_WORD = re.compile(r"[^ \t\n]+")


def _label_matches(text: str) -> Iterator[tuple[re.Match, str, str, str]]:
    """All matches of the labels' forms, with rule, type and kind of value: tried at the words that begin like one, or
    where these are many searched for."""
    low, starts = text.lower(), {}
    for m in _START.finditer(text):
        starts.setdefault(_SAME.get(m[0]) or m[0].lower(), []).append(m.start())
    held = {h for h in _ALL_HEADS if h in low}
    for rule, form, entity, kind in _FORMS:
        if held.isdisjoint(_HEADS[rule]):
            continue
        places = [starts[c] for c in _FIRST[rule] if c in starts]
        if _A_TRY * sum(map(len, places)) > len(text):
            yield from ((m, rule, entity, kind) for m in form.finditer(text))
            continue
        end = 0
        for at in sorted(itertools.chain.from_iterable(places)):
            m = form.match(text, at) if at >= end else None
            if m:
                end = m.end()
                yield m, rule, entity, kind


class Found(NamedTuple):
    start: int
    end: int
    entity_type: str
    rule: str


def read_id(text: str, start: int, limit: int) -> tuple[int, int] | None:
    """Up to four words with digits, or short capitals before one, or capitals with a slash."""
    words = list(_WORD.finditer(text, start, limit))
    digits = [any(c.isdigit() for c in m[0]) for m in words]
    last = -1
    for i, m in enumerate(words[:_ID_WORDS]):
        bare = m[0].strip(",;()[]")
        leads = bare.isalnum() and bare.isupper() and len(bare) <= 4 and i + 1 < len(words) and digits[i + 1]
        if not (any(c.isdigit() for c in bare) or leads or (bare.isupper() and len(bare) >= 4 and "/" in bare)):
            break
        last = i
    return trimmed(text, words[0].start(), words[last].end()) if last >= 0 else None


def read_organisation(text: str, start: int, limit: int) -> tuple[int, int] | None:
    """Up to eight capitalised or linking words, to the end of the phrase; it doesn't end in a linking word."""
    taken: list[re.Match] = []
    for m in _WORD.finditer(text, start, limit):
        core = m[0].strip(",;:()")
        if not core or not (core[0].isupper() or core[0].isdigit() or core.lower() in _LINKS):
            break
        taken.append(m)
        if len(taken) == _ORG_WORDS or (m[0][-1] in ",;." and core.lower() not in _COMPANY):
            break
    while taken and taken[-1][0].strip(",;:.").lower() in ("&", "and", "of", "the"):
        taken.pop()
    return trimmed(text, taken[0].start(), taken[-1].end()) if taken else None


def read_value(kind: str, text: str, start: int, limit: int) -> tuple[int, int] | None:
    """The span of a value of ``kind`` that begins at ``start``; None if there is none."""
    if start >= limit:
        return None
    span: tuple[int, int] | None = None
    if kind == "name":
        span = read_name(text, start, limit, _NAME_WORDS)
    elif kind == "id":
        span = read_id(text, start, limit)
    elif kind == "org":
        span = read_organisation(text, start, limit)
    elif kind == "date":
        m = next((m for m in _DATE.finditer(text[start:limit]) if m.start() <= 3), None)
        span = (start + m.start(), start + m.end()) if m else None
    elif kind == "phone":
        m = _PHONE.match(text, start, limit)
        span = trimmed(text, *m.span()) if m and sum(c.isdigit() for c in m[0]) >= 6 else None
    elif kind == "email":
        m = _EMAIL.match(text, start, limit)
        span = m.span() if m else None
    else:  # address, free
        low, high = trimmed(text, start, limit)
        span = (low, high) if high - low >= 2 and (kind == "address" or len(text[low:high].split()) <= _FREE_WORDS) else None
    return span if span and span[1] > span[0] else None


class _Row(NamedTuple):
    first: int
    last: int
    box: tuple[float, float, float, float]


def _cell(view: View, row: _Row, x: float, gap: float) -> tuple[int, int] | None:
    """Tokens of a row from ``x`` on, up to a wider gap than ``gap``: a table's cell."""
    tokens = view.tokens
    first = next((i for i in range(row.first, row.last + 1) if tokens[i].box[2] > x), None)
    if first is None:
        return None
    last = first
    while last < row.last and tokens[last + 1].box[0] - tokens[last].box[2] <= gap:
        last += 1
    return first, last


class LabelReader:
    """Finds the values of a view's labels."""

    def __init__(self, view: View):
        self.view = view
        self.rows = [_Row(a, b - 1, union(t.box for t in view.tokens[a:b])) for a, b in view.line_runs()]
        self.row_of = [k for k, r in enumerate(self.rows) for _ in range(r.first, r.last + 1)]
        self.by_top = sorted(range(len(self.rows)), key=lambda k: (view.tokens[self.rows[k].first].page, self.rows[k].box[1]))
        self.tops = [(view.tokens[self.rows[k].first].page, self.rows[k].box[1]) for k in self.by_top]
        self.tallest = max((r.box[3] - r.box[1] for r in self.rows), default=0)

    def _rows_between(self, page: int, low: float, high: float) -> list[_Row]:
        """Rows of the page whose top lies in [low, high]."""
        a, b = bisect.bisect_left(self.tops, (page, low)), bisect.bisect_right(self.tops, (page, high))
        return [self.rows[k] for k in self.by_top[a:b]]

    def beside(self, first: int, last: int) -> list[tuple[int, int, str]]:
        """Spans to the right of the label's tokens and below them, nearest first."""
        view, tokens = self.view, self.view.tokens
        x0, y0, x1, y1 = union((tokens[first].box, tokens[last].box))
        high, here, page = max(1, y1 - y0), self.rows[self.row_of[last]], tokens[last].page
        out = []
        right = [
            r for r in self._rows_between(page, y0 - self.tallest, y1)
            if r is not here and r.box[0] >= x1 - 0.5 * high and min(r.box[3], y1) - max(r.box[1], y0) >= 0.5 * min(r.box[3] - r.box[1], high)
        ]
        if right:
            row = min(right, key=lambda r: (r.box[0], r.first))
            out.append((row, row.box[0] - 1, "right"))
        below = [r for r in self._rows_between(page, y1 - 0.3 * high, y1 + 1.8 * high) if r is not here and r.box[2] > x0 - high and r.box[0] < x1 + 4 * high]
        if below:
            out.append((min(below, key=lambda r: (r.box[1], r.box[0], r.first)), x0 - high, "below"))
        cells = [(_cell(view, row, x, 2 * high), where) for row, x, where in out]
        return [(view.starts[c[0]], view.ends[c[1]], where) for c, where in cells if c]

    def find(self) -> list[Found]:
        """Values of all labels; a label's value ends where the next label begins."""
        view, text = self.view, self.view.text
        hits = sorted((m.start(), -m.end(), rule, entity, kind) for m, rule, entity, kind in _label_matches(text))
        starts = sorted({h[0] for h in hits})
        out = []
        for begin, minus_end, rule, entity, kind in hits:
            at = -minus_end
            line = view.line_end(at)
            after = bisect.bisect_left(starts, at + 1)
            limit = min(line, starts[after]) if after < len(starts) else line
            span = read_value(kind, text, at, limit)
            if span:
                out.append(Found(*span, entity, rule))
                continue
            # a form's label with nothing after it: its value stands beside
            tokens = view.range(begin, at)
            if tokens is None or limit != line or text[at:limit].strip(" \t:#-–_."):
                continue
            row = self.rows[self.row_of[tokens[1]]]
            if row.last - row.first > 5 and not text[begin:at].rstrip().endswith((":", "#")):
                continue
            for left, right, where in self.beside(*tokens):
                value = read_value(kind, text, left, right)
                if value:
                    out.append(Found(*value, entity, f"{rule}.{where}"))
        return out
