"""What models take for names and isn't: statistical evidence only is refined by it."""

from __future__ import annotations

import re

from .names import is_title
from .persons import split_token
from .view import View, match_key
from .words import CLINICAL_NOUNS, DOSE_WORDS, DRUGS, EPONYMS, MEDICAL, NEEDS_DIGIT, NON_NAMES, PLACES, POST_NOMINALS, PUBLIC_BODIES

_LINKS = frozenset(("and", "&", "or", "/", "+", "-"))
_DOSE = re.compile(r"(?i)[\d.,/]+(?:mg|mcg|g|ml|%)?")
AHEAD = 6


def _clinical_after(view: View, last: int) -> bool:
    """Do further eponyms and a clinical noun follow on the line?"""
    for i in range(last + 1, min(len(view.tokens), last + 1 + AHEAD)):
        word = split_token(view.tokens[i].text).core.lower()
        if not view.same_line(last, i) or (word not in CLINICAL_NOUNS and word not in EPONYMS and word not in _LINKS):
            return False
        if word in CLINICAL_NOUNS:
            return True
    return False


def allowlisted(view: View, first: int, last: int, entity: str) -> bool:
    """Public bodies, capitals and states, medicines with doses, and eponyms of signs and tests."""
    if entity not in ("person", "organisation", "locality"):
        return False
    words = [w for t in view.tokens[first : last + 1] if match_key(w := split_token(t.text).core)]
    low = [w.lower() for w in words]
    key = match_key(" ".join(words))
    if all(w in NON_NAMES or w in MEDICAL or w in POST_NOMINALS for w in low) or key in PUBLIC_BODIES or (entity == "locality" and key in PLACES):
        return True
    if any(w in DRUGS for w in low) and all(w in DRUGS or w in DOSE_WORDS or _DOSE.fullmatch(w) for w in low):
        return True
    names = [w for w in low if w not in _LINKS]
    inside = bool(names) and names[-1] in CLINICAL_NOUNS
    names = names[:-1] if inside else names
    return bool(names) and all(w in EPONYMS for w in names) and (inside or _clinical_after(view, last))


def plausible_type(text: str, entity: str) -> str | None:
    """Numbers have a digit, else capitalised words are an organisation; addresses of e-mail have their sign."""
    if entity in NEEDS_DIGIT and not any(c.isdigit() for c in text):
        return "organisation" if any(w[:1].isupper() for w in text.split()) else None
    return None if entity == "email" and "@" not in text else entity


def refine(view: View, first: int, last: int, entity: str) -> tuple[int, int, str] | None:
    """A model's hit without titles and qualifications, with a plausible type; None if nothing is left."""
    core = lambda i: split_token(view.tokens[i].text).core
    if entity == "person":
        while first <= last and is_title(core(first)):
            first += 1
        while first <= last and (core(last).lower() in POST_NOMINALS or not any(c.isalnum() for c in core(last))):
            last -= 1
    kind = plausible_type(view.value(first, last), entity) if first <= last else None
    return None if kind is None or allowlisted(view, first, last, kind) else (first, last, kind)
