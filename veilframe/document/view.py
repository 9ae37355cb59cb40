"""A document as tokens: text, place in the line view, place in the original text, line, box, confidence."""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from dataclasses import dataclass

#: White space is ASCII white space, as in the column expressions.
_WORD = re.compile(r"\S+", re.ASCII)
_NOT_WORD = re.compile(r"[\W_]+")
#: The grid that plain text is set in: left edge, width of a character, gap between words, first row, rows' distance, height.
X0, CHAR, GAP, Y0, LINE, HEIGHT = 100, 25, 20, 100, 60, 50


@functools.lru_cache(maxsize=1 << 16)
def match_key(text: str) -> str:
    """What values are compared by: compatibility forms folded, letters in one case, letters and digits only."""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).casefold())


@functools.lru_cache(maxsize=1 << 16)
def plain_key(text: str) -> str:
    """Letters and digits only, each in its own small letter; nothing is folded or composed."""
    return "".join(c.lower()[0] for c in text if unicodedata.category(c)[0] in "LN")


def digits_only(text: str) -> str:
    return "".join(filter(str.isdigit, text))


@dataclass(slots=True)
class Token:
    text: str
    start: int
    end: int
    raw_start: int
    raw_end: int
    page: int
    line: int
    box: tuple[float, float, float, float]
    confidence: float = 0.99
    alternates: tuple[str, ...] = ()


class View:
    """Tokens joined by spaces, lines by newlines, pages by two; blank lines leave a gap on the page and no line."""

    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.starts, self.ends = [t.start for t in tokens], [t.end for t in tokens]
        out, last = [], None
        for t in tokens:
            if last is not None:
                out.append(" " if (last.page, last.line) == (t.page, t.line) else "\n" if last.page == t.page else "\n\n")
            out.append(t.text)
            last = t
        self.text = "".join(out)
        self.keys = [match_key(t.text) for t in tokens]
        #: What was found of values looked for one by one.
        self.known_hits: dict = {}
        #: Who the persons of a set of mentions are.
        self.known_persons: dict = {}

    @classmethod
    def of_text(cls, text: str) -> View:
        tokens: list[Token] = []
        at = raw = line = 0
        for row, body in enumerate(text.split("\n")):
            x, found = X0, False
            for m in _WORD.finditer(body):
                word = m[0]
                size = len(word)
                tokens.append(Token(word, at, at + size, raw + m.start(), raw + m.end(), 0, line, (x, Y0 + LINE * row, x + CHAR * size, Y0 + LINE * row + HEIGHT)))
                at += size + 1
                x += CHAR * size + GAP
                found = True
            raw += len(body) + 1
            line += found
        return cls(tokens)

    @classmethod
    def of_rows(cls, rows: list[dict]) -> View:
        """Tokens with text, page, line_no, box (x0, y0, x1, y1), confidence and alternates, in reading order."""
        tokens: list[Token] = []
        at = 0
        for r in rows:
            if tokens and tokens[-1].page != r["page"]:
                at += 1  # pages are two newlines apart
            text = r["text"]
            box = (r["x0"], r["y0"], r["x1"], r["y1"])
            tokens.append(Token(text, at, at + len(text), at, at + len(text), r["page"], r["line_no"], box, r.get("confidence") or 0.99, tuple(r.get("alternates") or ())))
            at += len(text) + 1
        return cls(tokens)

    def range(self, start: int, end: int) -> tuple[int, int] | None:
        """First and last token that overlap [start, end)."""
        first, last = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end) - 1
        return (first, last) if first <= last else None

    def same_line(self, i: int, j: int) -> bool:
        a, b = self.tokens[i], self.tokens[j]
        return a.page == b.page and a.line == b.line

    def value(self, first: int, last: int) -> str:
        return " ".join(t.text for t in self.tokens[first : last + 1])

    def line_end(self, at: int) -> int:
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    @functools.cached_property
    def runs(self) -> list[tuple[int, int]]:
        """Half-open runs of tokens of a line."""
        out: list[tuple[int, int]] = []
        for i in range(len(self.tokens)):
            if out and self.same_line(i, i - 1):
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
        return out

    def line_runs(self) -> list[tuple[int, int]]:
        return self.runs

    @functools.cached_property
    def read_otherwise(self) -> bool:
        return any(t.alternates for t in self.tokens)

    @functools.cached_property
    def line_keys(self) -> str:
        """The tokens' keys, a line's without anything between them, and a newline after each line."""
        return "".join("".join(self.keys[a:b]) + "\n" for a, b in self.runs)

    @functools.cached_property
    def line_starts(self) -> list[int]:
        """Where each line begins in ``line_keys``."""
        return [self.key_starts[a] for a, _ in self.runs]

    @functools.cached_property
    def key_starts(self) -> list[int]:
        """Where each token's key begins in ``line_keys``."""
        out, at = [], 0
        for a, b in self.runs:
            for key in self.keys[a:b]:
                out.append(at)
                at += len(key)
            at += 1
        return out

    def run_of(self, token: int) -> tuple[int, int]:
        """The run of the token's line."""
        return self.runs[bisect.bisect_right(self.runs, (token, len(self.tokens) + 1)) - 1]


def union(boxes) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return min(x0), min(y0), max(x1), max(y1)


def trimmed(text: str, start: int, end: int, edge: str = " \t,;:.()[]{}\"'") -> tuple[int, int]:
    """The span without punctuation at its ends."""
    inner = text[start:end]
    start += len(inner) - len(inner.lstrip(edge))
    return (start, start + len(inner.strip(edge))) if inner.strip(edge) else (start, start)
