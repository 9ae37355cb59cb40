"""Persons after a title, a salutation or a sign-off, and paths and names of files."""

from __future__ import annotations

import re

from .labels import Found
from .names import read_name
from .view import View, trimmed
from .words import TITLES

_TITLED = re.compile(rf"(?<![A-Za-z])(?:{TITLES})\.?[ \t]+(?=[A-Z(])")
_DEAR = re.compile(r"(?<![A-Za-z])(?:Dear|DEAR)[ \t]+")
_CLOSING = re.compile(r"(?im)^[ \t]*(?:yours[ \t]+(?:sincerely|faithfully|truly)|(?:(?:kind|best|warm)[ \t]+)?regards)[ \t,.]*$")
#: Lines after a closing among which the name is looked for.
_SIGNED_WITHIN = 4

# Extensions, roots and shapes of paths.
EXTENSIONS = "docx?|dotx?|pdf|rtf|txt|odt|xlsx?|csv|pptx?|msg|eml|jpe?g|png|tiff?|heic|bmp|gif|zip|wpd|html?|xml"
_TAIL = r"(?: +[A-Z0-9][^\s\"'<>/\\,;]*)*"
_SEGMENT = r"[^\s\"'<>/]+"
_WINDOWS = re.compile(r"(?<![\w\\])(?:[A-Za-z]:|\\\\[\w.$\-]+)\\[^\n<>|\"*?]*")
_POSIX = re.compile(
    rf"(?<![\w/.:])(?:/(?i:home|Users|mnt|media|srv|data|shares?|Volumes|var|tmp|opt)(?:/{_SEGMENT}(?: +{_SEGMENT})*(?=/))*"
    rf"(?:/{_SEGMENT}(?: +{_SEGMENT})*\.(?i:{EXTENSIONS})(?![A-Za-z0-9])|/{_SEGMENT}{_TAIL})|/(?:[\w.\-]+(?: +[\w.\-]+)*/)+[\w.\-]+\.(?i:{EXTENSIONS}))(?![\w])"
)
_BARE = re.compile(rf"(?i)(?<![\w.\\/@\-])\w[\w\-.()]*\.(?:{EXTENSIONS})(?![\w\\/]|\.\w)")
_EXTENSION = re.compile(rf"(?i)\.(?:{EXTENSIONS})(?![A-Za-z0-9])")
_LAST = re.compile(rf"[^\s\"'<>/\\,;]*{_TAIL}")


def find_persons(view: View) -> list[Found]:
    text, out = view.text, []
    for rule, cue, most in (("person.title", _TITLED, 5), ("person.salutation", _DEAR, 4)):
        for m in cue.finditer(text):
            span = read_name(text, m.end(), len(text), most)
            if span:
                out.append(Found(*span, "person", rule))
    for m in _CLOSING.finditer(text):
        at = m.end() + 1
        for _ in range(_SIGNED_WITHIN):
            end = view.line_end(at)
            if at >= len(text) or text[at:end].strip():
                break
            at = end + 1
        span = read_name(text, at, len(text), 5) if at < len(text) else None
        if span:
            out.append(Found(*span, "person", "person.signoff"))
    return out


def find_files(view: View) -> list[Found]:
    text, out = view.text, []
    for m in _WINDOWS.finditer(text):
        # spaces are part of a path: it ends after its last extension or, without one, its last folder
        ends = [e.end() for e in _EXTENSION.finditer(m[0])]
        end = ends[-1] if ends else _LAST.match(m[0], m[0].rfind("\\") + 1).end()
        out.append((m.start(), m.start() + end, "file.windows"))
    out += [(*m.span(), "file.posix") for m in _POSIX.finditer(text)]
    out += [(*m.span(), "file.name") for m in _BARE.finditer(text)]
    spans = [(*trimmed(text, a, b, " \t,;:()[]{}\"'"), rule) for a, b, rule in out]
    return [Found(a, b, "file_path", rule) for a, b, rule in spans if b > a]
