"""Byte-pair merges as a finite-state problem.

A merge list decides, for two neighbouring tokens, whether the merges of their concatenation leave the
border between them alone.  A sequence of tokens is what the merges produce exactly if each neighbouring
pair leaves its border alone, and each prefix of a text has exactly one such sequence.  The last token of
each prefix is therefore a function of the last tokens of the prefixes where it can begin, of which only
those matter that a token can still grow out of.  ``MergeTable`` answers the border question and holds
the prefix tree; the transducers in ``tokencount`` and ``bytebpe`` are determinised from it on demand.

Tokens are ``str``; byte vocabularies map byte *b* to ``chr(b)``.
"""

from __future__ import annotations

import bisect
import math


class Derivations:
    """By token, one of its derivations; tokens that no merges lead to aren't in it.  Made when asked for."""

    def __init__(self, table: MergeTable, side: int):
        self._table, self._side = table, side

    def __contains__(self, token: str) -> bool:
        return self._table.derivation(token) is not None

    def get(self, token: str):
        found = self._table.derivation(token)
        return None if found is None else found[self._side]

    def __getitem__(self, token: str):
        return self._table.derivation(token)[self._side]

    def __iter__(self):
        return (t for t in self._table.ranks if t in self)


class MergeTable:
    """Border test and prefixes for a vocabulary whose rank order is its merge order."""

    def __init__(self, ranks: dict[str, float], pairs: dict[tuple[str, str], float] | None = None):
        """``pairs``: the rank of each pair that merges; None: two tokens merge where their concatenation is one."""
        self.ranks = ranks
        self.rank_of = (lambda a, b: pairs.get((a, b), math.inf)) if pairs is not None else (lambda a, b: ranks.get(a + b, math.inf))
        self.prefixes: set[str] = {token[:i] for token in ranks for i in range(len(token))}  # proper ones, "" included
        self.prefixes.add("")
        self.right, self.left = Derivations(self, 1), Derivations(self, 0)
        self._derived: dict[str, tuple | None] = {}
        self._whole: dict[tuple[str, str], bool] = {}
        self._sorted: list[str] | None = None

    def derivation(self, token: str) -> tuple | None:
        """Left and right edges of a token after each of its merges; None where no merges lead to it."""
        if token not in self._derived:
            self._derived[token] = self._derive(token) if token in self.ranks else None
        return self._derived[token]

    def _derive(self, token: str):
        """Left and right edge of ``token`` after each merge, with the merge's rank; None if unreachable."""
        parts, rank_of = list(token), self.rank_of
        left, right = [(-1, parts[0])], [(-1, parts[-1])]
        while len(parts) > 1:
            best = min(((rank_of(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1)))
            if best[0] == math.inf:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            left.append((best[0], parts[0]))
            right.append((best[0], parts[-1]))
        return left, right

    def merge(self, text: str) -> list[str]:
        """The textbook merge loop; the transducers are tested against it."""
        parts, rank_of = list(text), self.rank_of
        while len(parts) > 1:
            best = min(((rank_of(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1)))
            if best[0] == math.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def border_holds(self, a: str, b: str) -> bool:
        """Do the merges of ``a + b`` never join across the border of ``a`` and ``b``?"""
        known = self._whole.get((a, b))
        if known is None:
            known = self._whole[a, b] = self._replay(self.right.get(a), self.left.get(b))
        return known

    def _replay(self, right, left) -> bool:
        """Run both derivations in merge order; lower ranks go first, and of equal ranks the leftmost."""
        if right is None or left is None:
            return True  # an atom outside the vocabulary never merges
        rank_of, i, j, far = self.rank_of, 0, 0, math.inf
        while True:
            across = rank_of(right[i][1], left[j][1])
            a = right[i + 1][0] if i + 1 < len(right) else far
            b = left[j + 1][0] if j + 1 < len(left) else far
            if across < a and across <= b and across < far:
                return False
            if a == far and b == far:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def follows(self, edge: str, begun: str) -> bool:
        """Can ``edge`` grow, within some token, by something that agrees with ``begun`` as far as both go?"""
        if self._sorted is None:
            self._sorted = sorted(self.ranks)
        at = bisect.bisect_right(self._sorted, edge)
        while at < len(self._sorted) and self._sorted[at].startswith(edge):
            rest = self._sorted[at][len(edge) :]
            if rest.startswith(begun) or begun.startswith(rest):
                return True
            # the next that could agree
            at = max(at + 1, bisect.bisect_left(self._sorted, edge + begun[: _agreement(rest, begun) + 1], at + 1)) if rest < begun else len(self._sorted)
        return False


def _agreement(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


#: Entries of each of the caches that only save time; they are emptied when full.
MOST_CACHED = 60_000
#: No character of a text.
NEVER = "\U0010ffff\U0010ffff"


class BorderClasses:
    """What of the token before a place matters to the tokens that may begin there; classes are numbers, 0: nothing."""

    def __init__(self, table: MergeTable):
        self.table = table
        self._relevant: dict = {}
        self.clear()

    def clear(self) -> None:
        self._steps: list[tuple] = [()]
        self._numbers: dict[tuple, int] = {(): 0}
        self._narrowed: dict = {}
        self._borders: dict = {}
        self._after: dict[str, int] = {}
        self._shapes: dict = {}

    def _number(self, steps: tuple) -> int:
        n = self._numbers.setdefault(steps, len(self._steps))
        if n == len(self._steps):
            self._steps.append(steps)
        return n

    def after(self, token: str) -> int:
        """The class of a place that ``token`` ends at, before it is known what begins there."""
        n = self._after.get(token)
        if n is None:
            n = self._after[token] = self.narrow(self._number(tuple(self.table.right[token])), "")
        return n

    def narrow(self, number: int, begun: str) -> int:
        """The class for tokens that begin with ``begun``."""
        key = (number, begun)
        if len(self._narrowed) > MOST_CACHED:
            self._narrowed.clear()
        known = self._narrowed.get(key)
        if known is None:
            out = []
            for rank, edge in self._steps[number]:
                pair = (edge, begun)
                if len(self._relevant) > MOST_CACHED:
                    self._relevant.clear()
                fits = self._relevant.get(pair)
                if fits is None:
                    fits = self._relevant[pair] = self.table.follows(edge, begun)
                out.append((rank, edge if fits else NEVER))
            last = max((i for i, x in enumerate(out) if x[1] != NEVER), default=-1)
            known = self._narrowed[key] = self._number(tuple(out[: last + 2]) if last >= 0 else ())
        return known

    def hold(self, number: int, token: str) -> bool:
        key = (number, token)
        if len(self._borders) > MOST_CACHED:
            self._borders.clear()
        known = self._borders.get(key)
        if known is None:
            known = self._borders[key] = self.table._replay(self._steps[number], self.table.left.get(token))
        return known

    def shape(self, suffix: str, char: str) -> tuple[list, list, str]:
        """Reading ``char`` after ``suffix``: by place the token that would end now or None, (place, what has begun)
        for the places that stay, and the new suffix.  Places are the suffixes of ``suffix`` that begin tokens,
        the shortest, "", first."""
        if len(self._shapes) > MOST_CACHED // 2:
            self._shapes.clear()
        known = self._shapes.get((suffix, char))
        if known is None:
            right, prefixes, text = self.table.right, self.table.prefixes, suffix + char
            begun = [text[i:] for i in range(len(suffix), -1, -1) if suffix[i:] in prefixes]
            stay = [(i, x) for i, x in enumerate(begun) if x in prefixes]
            known = self._shapes[suffix, char] = ([x if x in right else None for x in begun], stay, stay[-1][1] if stay else "")
        return known
