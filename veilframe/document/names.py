"""Reading a person's name from a place in the text on, word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .words import EDGES, LABEL_WORDS, MEDICAL, NAME_TOKEN, NON_NAMES, PARTICLE, POST_NOMINALS, TITLES

_WORD = re.compile(r"[^ \t\n]+")
_NAME = re.compile(rf"(?:{NAME_TOKEN}|(?:[A-Z]\.){{2,3}})")
_PARTICLE = re.compile(PARTICLE)
_TITLE = re.compile(rf"(?i:{TITLES})\.?")
_LONG_TITLE = re.compile(rf"(?i:{TITLES})\.?(?=[ \t]|$)")
_INITIALS = re.compile(r"(?:[A-Z]\.)+")


class Word(NamedTuple):
    """A word without the punctuation around it, and what a name can make of it."""

    start: int
    end: int
    low: str
    kind: str  # name, particle, lower, stop
    closes: bool  # the name is over after it
    inverts: bool  # a comma follows: a surname before the given names


def _words(text: str, start: int, limit: int, lower: bool) -> Iterator[Word]:
    for m in _WORD.finditer(text, start, limit):
        raw = m[0]
        core = raw.strip(EDGES)
        begin = m.start() + len(raw) - len(raw.lstrip(EDGES))
        after = raw[raw.rfind(core) + len(core) :] if core else raw
        sentence = core.endswith(".") and len(core) > 2 and not _INITIALS.fullmatch(core)  # its stop isn't part of it
        word = core[:-1] if sentence else core
        low = core.lower().rstrip(".")
        if not core or raw.endswith(":") or low in LABEL_WORDS or low in POST_NOMINALS or low in NON_NAMES or (len(core) <= 3 and core.isupper() and low in MEDICAL):
            kind = "stop"
        elif _NAME.fullmatch(word):
            kind = "name"
        elif _PARTICLE.fullmatch(word):
            kind = "particle"
        else:
            kind = "lower" if lower and word.isalpha() and len(word) > 1 else "stop"
        comma = "," in after
        yield Word(begin, begin + len(word), low, kind, sentence or (core.endswith(".") and len(core) > 2) or any(c in ",;:)" for c in after), comma)


def read_name(text: str, start: int, limit: int, most: int = 6, titles: bool = True, lower: bool = False) -> tuple[int, int] | None:
    """The name that begins at ``start``, without titles before it; not past ``limit`` or the line.

    Names are capitalised words, words in capitals and initials, particles between them, and "SURNAME, Given".  Labels,
    post-nominals, other words and the sentence's end are not part of one.
    """
    end = text.find("\n", start)
    limit = limit if end < 0 else min(limit, end)
    if titles:
        lead = start
        while lead < limit and text[lead] in " \t" + EDGES:
            lead += 1
        title = _LONG_TITLE.match(text, lead, limit)
        if title:
            start = title.end()
    taken: list[Word] = []
    for w in _words(text, start, limit, lower):
        if w.kind == "stop" or (w.kind == "particle" and not taken):
            break
        taken.append(w)
        if len(taken) == most or (w.closes and not (w.inverts and len(taken) == 1)):
            break
    while taken and taken[-1].kind == "particle":
        taken.pop()
    return (taken[0].start, taken[-1].end) if taken else None


def is_title(word: str) -> bool:
    return _TITLE.fullmatch(word) is not None
