"""Who the persons of a document are: parts of names, genders, clusters of mentions, and roles."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from .names import is_title
from .pools import FEMALE, MALE
from .view import View, match_key
from .words import CLINICAL_NOUNS, EDGES, EPONYMS, FEMALE_TITLES, MALE_TITLES, MEDICAL, NON_NAMES, PARTICLE, POST_NOMINALS, PROFESSIONAL_TITLES, PROFESSIONS, SUBJECTS

_PARTICLE = re.compile(PARTICLE)
_INITIALS = re.compile(r"(?:[A-Z]\.?){1,3}")
_POSSESSIVE = re.compile(r"(?:['’]s|['’])$")
_HE, _SHE = re.compile(r"(?i)\b(?:he|him|his|himself)\b"), re.compile(r"(?i)\b(?:she|her|hers|herself)\b")
#: Characters after a mention among which pronouns count, and tokens beside it among which roles do.
PRONOUNS, BEFORE, AFTER = 240, 3, 4
_PROFESSION, _SUBJECT = re.compile(PROFESSIONS), re.compile(SUBJECTS)
SUBJECT_TYPES = frozenset(("date_of_birth", "street_address", "medicare", "ihi"))
GIVEN, SURNAME, INITIAL, LINK, OTHER = "given", "surname", "initial", "particle", "other"


@dataclass(slots=True)
class Part:
    prefix: str
    core: str
    suffix: str
    role: str = OTHER

    @property
    def key(self) -> str:
        return match_key(self.core)


def split_token(text: str) -> Part:
    """'(Smith's,' is '(', 'Smith' and "'s,": a possessive and a final stop aren't the name's."""
    left = text.lstrip(EDGES)
    core = left.rstrip(EDGES)
    prefix, suffix = text[: len(text) - len(left)], left[len(core) :]
    owner = _POSSESSIVE.search(core)
    if owner and owner.start() > 1:
        core, suffix = core[: owner.start()], owner[0] + suffix
    if core.endswith(".") and not _INITIALS.fullmatch(core):
        core, suffix = core[:-1], "." + suffix
    return Part(prefix, core, suffix)


def parse_name(words: list[str], title: str | None = None) -> list[Part]:
    """The words' roles: "SURNAME, Given", "Given SURNAME", "Given Surname" or a lone word, initials and particles."""
    parts = [split_token(w) for w in words]
    names: list[Part] = []
    for p in parts:
        if not p.core or (not names and is_title(p.core)):
            continue
        if _INITIALS.fullmatch(p.core) and (p.core.endswith(".") or len(p.core) == 1 or (len(parts) > 1 and len(p.core) <= 2)):
            p.role = INITIAL
        elif _PARTICLE.fullmatch(p.core):
            p.role = LINK
        else:
            names.append(p)
    capitals = [p for p in names if len(p.core) > 1 and p.core.isupper()]
    if len(names) == 1:
        last = names if title or any(p.role == INITIAL for p in parts) else []
    elif names and "," in names[0].suffix:
        last = names[:1]
    elif capitals and len(capitals) < len(names):
        last = capitals
    else:
        last = names[-1:]
    for p in names:
        p.role = SURNAME if any(p is x for x in last) else GIVEN
    for a, b in zip(parts[-2::-1], parts[:0:-1], strict=True):  # "van der Berg" is one surname
        if a.role == LINK and b.role == SURNAME:
            a.role = SURNAME
    return parts


def majority(genders) -> str:
    """m or f by more votes, else u."""
    votes = Counter(genders)
    return "m" if votes["m"] > votes["f"] else "f" if votes["f"] > votes["m"] else "u"


@dataclass(slots=True)
class Person:
    """One mention of a person."""

    first: int
    last: int
    parts: list[Part]
    title: str | None
    gender: str
    cluster: str | None = None

    def keys(self, role: str) -> list[str]:
        return [p.key for p in self.parts if p.role == role and p.key]


@dataclass(slots=True)
class Persons:
    mentions: list[Person] = field(default_factory=list)
    given_gender: dict[str, str] = field(default_factory=dict)

    def parts(self, role: str) -> set[str]:
        return {k for m in self.mentions for k in m.keys(role)}


def _read(view: View, first: int, last: int) -> Person:
    title = None
    if first and view.same_line(first - 1, first):
        word = view.tokens[first - 1].text.strip(EDGES)
        title = word if is_title(word) else None
    bare = (title or "").lower().rstrip(".")
    gender = "m" if bare in MALE_TITLES else "f" if bare in FEMALE_TITLES else "u"
    if gender == "u":
        after = view.text[view.ends[last] : view.ends[last] + PRONOUNS]
        he, she = len(_HE.findall(after)), len(_SHE.findall(after))
        gender = "m" if he > she else "f" if she > he else "u"
    return Person(first, last, parse_name([t.text for t in view.tokens[first : last + 1]], title), title, gender)


def resolve(view: View, mentions: list[tuple[int, int]]) -> Persons:
    """Persons of the mentions (first and last token).

    Full names are clusters of a surname and a first given name.  Others belong to the only cluster that fits them by
    surname and initial, or by given name, and by gender where several fit; else to none.
    """
    people = [_read(view, *m) for m in sorted(mentions)]
    full = [p for p in people if p.keys(SURNAME) and p.keys(GIVEN)]
    surnames, givens = ({k for p in full for k in p.keys(role)} for role in (SURNAME, GIVEN))
    for p in people:
        names = [x for x in p.parts if x.role in (GIVEN, SURNAME)]
        if len(names) == 1 and names[0].role == GIVEN and names[0].key in surnames - givens:
            names[0].role = SURNAME
        given = p.keys(GIVEN)[:1]
        if p.gender == "u" and given and (given[0] in MALE) != (given[0] in FEMALE):
            p.gender = "m" if given[0] in MALE else "f"
    clusters: dict[tuple[str, str], list[Person]] = defaultdict(list)
    by_surname, by_given = defaultdict(set), defaultdict(set)
    for p in people:
        if p.keys(SURNAME) and p.keys(GIVEN):
            name = ("".join(p.keys(SURNAME)), p.keys(GIVEN)[0])
            clusters[name].append(p)
            by_surname[name[0]].add(name)
            by_given[name[1]].add(name)
    genders = {name: majority(p.gender for p in members) for name, members in clusters.items()}
    numbers = {name: f"P{i:03d}" for i, name in enumerate(sorted(clusters))}
    for name, members in clusters.items():
        for p in members:
            p.cluster = numbers[name]
    for p in people:
        if p.cluster:
            continue
        fits: set = set()
        if p.keys(SURNAME):
            initials = [x.core[0].lower() for x in p.parts if x.role == INITIAL]
            fits = {n for n in by_surname["".join(p.keys(SURNAME))] if not initials or n[1].startswith(initials[0])}
        elif p.keys(GIVEN):
            fits = set(by_given[p.keys(GIVEN)[0]])
        if p.gender != "u" and len(fits) > 1:
            fits = {n for n in fits if genders[n] in (p.gender, "u")} or fits
        if len(fits) == 1:
            p.cluster = numbers[next(iter(fits))]
    in_cluster: dict[str, list[str]] = defaultdict(list)
    for p in people:
        if p.cluster:
            in_cluster[p.cluster].append(p.gender)
    votes: dict[str, list[str]] = defaultdict(list)
    for p in people:
        for key in p.keys(GIVEN):
            votes[key].append(majority(in_cluster[p.cluster]) if p.cluster else p.gender)
    return Persons(people, {k: majority(v) for k, v in votes.items()})


def lone_parts(view: View, persons: Persons, shortest: int) -> list[tuple[int, int, str]]:
    """(first, last, role) of capitalised words that are a known person's surname, with initials and given names right
    before it, or given name; not of an eponym before a clinical noun."""
    known = {role: {p.key for m in persons.mentions for p in m.parts if p.role == role and len(p.key) >= shortest and p.core.lower() not in NON_NAMES} for role in (SURNAME, GIVEN)}
    if not known[SURNAME] and not known[GIVEN]:
        return []
    out, tokens = [], view.tokens
    for i, token in enumerate(tokens):
        if view.keys[i] and not token.text.strip(EDGES)[:1].isupper():
            continue
        core = split_token(token.text).core
        key = match_key(core)
        role = SURNAME if key in known[SURNAME] else GIVEN if key in known[GIVEN] else None
        if role is None or not core[0].isupper():
            continue
        clinical = i + 1 < len(tokens) and view.same_line(i, i + 1) and tokens[i + 1].text.strip(EDGES + ".").lower() in CLINICAL_NOUNS
        if clinical and core.lower() in EPONYMS:
            continue
        first = i
        while role == SURNAME and first and view.same_line(first - 1, i):
            before = split_token(tokens[first - 1].text).core
            if is_title(before) or before.rstrip(".").lower() in MEDICAL or not (_INITIALS.fullmatch(before) or match_key(before) in known[GIVEN]):
                break
            first -= 1
        out.append((first, i, role))
    return out


def professionals(view: View, persons: Persons, others: list[tuple[int, str]]) -> set[str]:
    """Clusters of persons who act in their profession: a mention has a title, a qualification or a profession's name
    beside it, none stands in a line about the document's subject, and nobody else has the surname.

    ``others``: first token and type of the document's other mentions.
    """
    line = {i: k for k, (low, high) in enumerate(view.line_runs()) for i in range(low, high)}
    runs = view.line_runs()
    about = {line[i] for i, entity in others if entity in SUBJECT_TYPES}
    acting, subject = set(), set()
    for m in persons.mentions:
        if m.cluster is None:
            continue
        low, high = runs[line[m.first]]
        before = view.value(max(low, m.first - BEFORE), m.first - 1)
        after = view.value(m.last + 1, min(runs[line[m.last]][1], m.last + 1 + AFTER) - 1)
        following = split_token(after.split(" ")[0]).core.lower() if after else ""
        if (m.title or "").lower().rstrip(".") in PROFESSIONAL_TITLES or following in POST_NOMINALS or _PROFESSION.search(before) or _PROFESSION.search(after):
            acting.add(m.cluster)
        if line[m.first] in about or _SUBJECT.search(view.value(low, high - 1)):
            subject.add(m.cluster)
    acting -= subject
    bearers: dict[str, set[str]] = defaultdict(set)
    for m in persons.mentions:
        if m.cluster:
            for key in m.keys(SURNAME):
                bearers[key].add(m.cluster)
    shared = {c for clusters in bearers.values() if clusters - acting for c in clusters}
    return acting - shared
