"""Known values looked for in a view: exactly, in other readings of a token, and within an edit budget."""

from __future__ import annotations

import bisect
import functools
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from .view import View, match_key

# Shortest keys, rounds, similarity floors and combinations of readings.
MIN_KEY, FLOOR, ROUNDS, COMBINATIONS = 4, 0.88, 4, 64
RESIDUAL_MIN_KEY, RESIDUAL_FLOOR = 5, 0.9


class Target(NamedTuple):
    key: str
    size: int
    entity_type: str
    source: str = "mention"


class Hit(NamedTuple):
    first: int
    last: int
    entity_type: str
    rule: str
    score: float


def edit_budget(length: int) -> int:
    return 0 if length < 6 else 1 if length < 10 else 2 if length < 16 else 3


def within(a: str, b: str, most: int) -> int | None:
    """Edit distance of ``a`` and ``b`` if it is at most ``most``: a band of the table around its diagonal."""
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    if most <= 1:
        at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        one = a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at + 1 :] == b[at:] if len(a) > len(b) else a[at:] == b[at + 1 :]
        return 1 if most and one else None
    row = {j: j for j in range(most + 1)}
    for i, c in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            best = row.get(j - 1, most + 1) + (c != b[j - 1])
            new[j] = min(best, row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1)
        if min(new.values()) > most:
            return None
        row = new
    return row[len(b)] if row.get(len(b), most + 1) <= most else None


def pieces(key: str, most: int) -> list[str]:
    """The key in ``most + 1`` parts; whatever is within ``most`` edits of it has one of them."""
    cuts = [len(key) * i // (most + 1) for i in range(most + 2)]
    return [key[x:y] for x, y in itertools.pairwise(cuts)]


#: Characters that may be compared, values by letters of a text, in looking for parts of the values one by one; else all windows are looked up.
ONE_BY_ONE = 1 << 22


def _sizes(target: Target) -> set[int]:
    """Tokens that what is equal to the target may have."""
    return {max(1, target.size - 1), target.size, target.size + 1}


@functools.lru_cache(maxsize=1 << 12)
def _edits(length: int, floor: float) -> int:
    """Edits that budget and similarity floor leave for a key; the other may be longer by as many."""
    return max((d for d in range(edit_budget(length) + 1) if 1 - d / (length + d) >= floor), default=0)


class Targets:
    """Values by size and key, and those that may be found within an edit budget with parts of their key."""

    def __init__(self, targets: Iterable[Target], floor: float = FLOOR):
        self.floor = floor
        self.targets = sorted(set(targets))

    @functools.cached_property
    def exact(self) -> dict[tuple[int, str], list[int]]:
        exact: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, t in enumerate(self.targets):
            for size in _sizes(t):
                exact[size, t.key].append(i)
        return exact

    @functools.cached_property
    def near(self) -> dict[int, dict[int, dict[str, list[tuple[int, int]]]]]:
        """By size and length of a part, the parts with their targets and the edits these may be found within."""
        near: dict[int, dict[int, dict[str, list[tuple[int, int]]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for i, t in enumerate(self.targets):
            most = self._most(t.key)
            for piece in pieces(t.key, most) if most else ():
                near[t.size][len(piece)][piece].append((i, most))
        return near

    @functools.cached_property
    def near_lengths(self) -> dict[int, set[int]]:
        """By size, the lengths that keys may have which are within a target's edits."""
        lengths: dict[int, set[int]] = defaultdict(set)
        for t in self.targets:
            most = self._most(t.key)
            if most:
                lengths[t.size].update(range(len(t.key) - most, len(t.key) + most + 1))
        return lengths

    @functools.cached_property
    def lengths(self) -> dict[int, set[int]]:
        """By size, the lengths that keys may have which are a target's or within its edits."""
        lengths: dict[int, set[int]] = defaultdict(set)
        for size, key in self.exact:
            lengths[size].add(len(key))
        for size, near in self.near_lengths.items():
            lengths[size] |= near
        return lengths

    def _most(self, key: str) -> int:
        return _edits(len(key), self.floor)

    def _fuzzy(self, size: int, key: str) -> list[tuple[int, float]]:
        index = self.near.get(size) if len(key) in self.near_lengths.get(size, ()) else None
        may: dict[int, int] = {}
        for length, parts in index.items() if index else ():
            for at in range(len(key) - length + 1):
                may.update(parts.get(key[at : at + length], ()))
        out = []
        for i, most in may.items():
            other = self.targets[i].key
            d = within(key, other, most)
            if d is not None and 1 - d / max(len(key), len(other)) >= self.floor:
                out.append((i, 1 - d / max(len(key), len(other))))
        return out

    def find(self, view: View) -> list[Hit]:
        """Windows of one line that are a target's; none that holds a smaller one of the same target."""
        if not self.targets:
            return []
        if not view.read_otherwise and sum(1 + self._most(t.key) for t in self.targets) * len(view.line_keys) <= ONE_BY_ONE:
            found = [(*at, k, hit) for k, t in enumerate(self.targets) for *at, hit in self._found(view, t)]
            found.sort(key=lambda f: f[:4])
            return [hit for *_, hit in found]
        return self._find_by_windows(view)

    def _found(self, view: View, target: Target) -> list[tuple[int, int, int, Hit]]:
        """(line, size, first, hit) of one target: around the places in a line where its key or a part of it stands."""
        known = view.known_hits.get((target, self.floor))
        if known is None:
            known = view.known_hits[target, self.floor] = list(self._search(view, target)) if target.key else []
        return known

    def _search(self, view: View, target: Target) -> Iterator[tuple[int, int, int, Hit]]:
        key, text, keys, ends = target.key, view.line_keys, view.keys, view.key_starts
        most = self._most(key)
        parts = set(pieces(key, most)) if most else {key}
        windows: dict[tuple[int, int, int], float] = {}  # line, size and first token, and how alike it is
        for part in parts:
            at = text.find(part)
            while at >= 0:
                line = bisect.bisect_right(view.line_starts, at) - 1
                low, high = view.line_runs()[line]
                # tokens from the one in which the part begins on; before it those that a window may begin with
                inner = bisect.bisect_right(ends, at, low, high) - 1
                for size in _sizes(target):
                    near = most if size == target.size else 0
                    for i in range(max(low, inner - size + 1), min(inner, high - size) + 1):
                        j = i + size
                        length = ends[j - 1] + len(keys[j - 1]) - ends[i]
                        if (line, size, i) in windows or abs(length - len(key)) > near or ends[i] + length < at + len(part):
                            continue
                        found = text[ends[i] : ends[i] + length]
                        if found == key:
                            windows[line, size, i] = 1.0
                        elif near:
                            d = within(found, key, near)
                            if d is not None and 1 - d / max(len(found), len(key)) >= self.floor:
                                windows[line, size, i] = 1 - d / max(len(found), len(key))
                at = text.find(part, at + 1)
        taken: list[tuple[int, int, int]] = []
        for (line, size, i), score in sorted(windows.items()):
            j = i + size
            if any(k == line and s >= i and e <= j for k, s, e in taken) or (size != target.size and not all(keys[i:j])):
                continue
            taken.append((line, i, j))
            rule = "exact" if text[ends[i] : ends[j - 1] + len(keys[j - 1])] == key else "fuzzy"
            yield line, size, i, Hit(i, j - 1, target.entity_type, f"{target.source}.{rule}", round(score, 4))

    def _find_by_windows(self, view: View) -> list[Hit]:
        """``find``, looking up each window; what tokens are read as otherwise counts as well."""
        out: list[Hit] = []
        keys, tokens = view.keys, view.tokens
        ends = list(itertools.accumulate(map(len, keys), initial=0))
        read_otherwise = view.read_otherwise
        sizes = sorted({size for size, _ in self.exact})
        for low, high in view.line_runs():
            taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for size in sizes:
                lengths = self.lengths[size]
                for i in range(low, high - size + 1):
                    j = i + size
                    if not read_otherwise and ends[j] - ends[i] not in lengths:
                        continue
                    key = "".join(keys[i:j])
                    hits = {t: ("exact", 1.0) for t in self.exact.get((size, key), ())}
                    if read_otherwise and any(t.alternates for t in tokens[i:j]):
                        readings = itertools.product(*[(t.text, *t.alternates) for t in tokens[i:j]])
                        for r in itertools.islice(readings, COMBINATIONS):
                            for t in self.exact.get((size, match_key(" ".join(r))), ()):
                                hits.setdefault(t, ("alternate", 1.0))
                    for t, similarity in self._fuzzy(size, key):
                        hits.setdefault(t, ("fuzzy", similarity))
                    for t, (rule, score) in sorted(hits.items()):
                        target = self.targets[t]
                        if any(s >= i and e <= j for s, e in taken[t]) or (size != target.size and not all(keys[i:j])):
                            continue
                        taken[t].append((i, j))
                        out.append(Hit(i, j - 1, target.entity_type, f"{target.source}.{rule}", round(score, 4)))
        return out
