"""Token ids of whole batches by a lazily determinised transducer.

The batch is one stream of bytes with marks where pieces of the pre-tokenizer begin.  For each byte the
transducer outputs the last token of the piece read so far; its state is the longest suffix that a token can
still grow out of and, for each place in it where a token may begin, the class of the token before it.  The
stream is cut into blocks that advance in lockstep, each from a state guessed by reading the end of the block
before; blocks whose guess was wrong are read again.  A token is final as soon as all open places lead back
through it, at the end of its piece at the latest; ids are read off from there.  Results don't depend on cuts.
"""

from __future__ import annotations

import base64
import json

import numpy as np

from .mergetable import BorderClasses, MergeTable

BLOCK, WARM_UP = 384, 24
#: States kept; with their transitions below 1 KB each. Fewer would be made again and again on text of many words.
MOST_STATES = 220_000
SPREAD = 0x9E3779B97F4A7C15


class TokenTransducer:
    """``ids``: token -> id over symbols 0 to 511 (a byte, or 256 + a byte that ends a word)."""

    def __init__(self, ids: dict[str, int], table: MergeTable, most_states: int = MOST_STATES):
        self.ids, self.table, self.most_states = ids, table, most_states
        self.borders = BorderClasses(table)
        self.lengths = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            self.lengths[i] = len(token)
        self.column = np.full(512, -1, np.int16)
        self.symbols = [""]
        self._clear()

    def _clear(self) -> None:
        self.borders.clear()
        self.states: list = []
        self.numbers: dict = {}
        self.known = 0
        self._rehash(18)
        self._number(("", (0,)))

    def _rehash(self, bits: int) -> None:
        old = (self.keys, self.values) if self.known else (np.zeros(0, np.int64),) * 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        used = old[0] >= 0
        for key, value in zip(old[0][used].tolist(), old[1][used].tolist(), strict=True):
            self._insert(key, value)

    def _insert(self, key: int, value: int) -> None:
        slot = (key * SPREAD & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = slot + 1 & self.mask
        self.keys[slot], self.values[slot] = key, value

    def _number(self, state) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """Transitions by (state, column), open addressing with linear probing; unknown ones are made."""
        slot = ((key.view(np.uint64) * np.uint64(SPREAD)) >> self.shift).astype(np.int64)
        value = self.values.take(slot)
        left = np.flatnonzero(self.keys.take(slot) != key)
        new = []
        while len(left):
            there = self.keys[slot[left]]
            hit, free = there == key[left], there < 0
            value[left[hit]] = self.values[slot[left[hit]]]
            if free.any():
                new.append(left[free])
            left = left[~(hit | free)]
            slot[left] = slot[left] + 1 & self.mask
        if new:
            missing = np.concatenate(new)
            for k in np.unique(key[missing]).tolist():
                self._insert(k, self._advance(k >> 10, k & 1023))
                self.known += 1
            if 3 * self.known > self.mask:
                self._rehash(int(self.mask).bit_length() + 1)
            value[missing] = self._look_up(key[missing])
        return value

    def _advance(self, number: int, column: int) -> int:
        """Next state << 32 | last token."""
        if column == 0:
            return number << 32
        suffix, classes = self.states[number]
        borders = self.borders
        tokens, stay, to = borders.shape(suffix, self.symbols[column])
        for token, before in zip(tokens, classes, strict=True):
            if token is not None and (before == 0 or borders.hold(before, token)):
                break
        kept = (borders.after(token), *[classes[i] and borders.narrow(classes[i], begun) for i, begun in stay])
        return self._number((to, kept)) << 32 | self.ids[token]

    def _run(self, columns: np.ndarray, begins: np.ndarray, entry: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Columns and piece begins by (step, lane); writes the last tokens to ``out``, returns the exit states."""
        state = entry
        for i, row in enumerate(columns):
            cell = self._look_up(np.where(begins[i], 0, state) << 10 | row)
            state = cell >> 32
            if out is not None:
                out[i] = cell & 0xFFFFFFFF
        return state

    def last_tokens(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each symbol of the stream, the id of the last token of its piece up to there."""
        if len(self.states) > self.most_states:
            self._clear()
        columns = self.column[symbols]
        if columns.size and columns.min() < 0:
            for s in np.unique(symbols[columns < 0]).tolist():
                self.column[s] = len(self.symbols)
                self.symbols.append(chr(s))
            columns = self.column[symbols]
        lanes = -(-len(symbols) // BLOCK)
        spare = lanes * BLOCK - len(symbols)
        columns = np.ascontiguousarray(np.concatenate([columns, np.zeros(spare, np.int16)]).reshape(lanes, BLOCK).T)
        starts = np.ascontiguousarray(np.concatenate([begins, np.zeros(spare, bool)]).reshape(lanes, BLOCK).T)
        out = np.empty((BLOCK, lanes), np.int32)
        entry = np.zeros(lanes, np.int64)
        entry[1:] = self._run(columns[-WARM_UP:, :-1], starts[-WARM_UP:, :-1], entry[1:], None)
        leave = self._run(columns, starts, entry, out)
        while len(wrong := 1 + np.flatnonzero((entry[1:] != leave[:-1]) & ~starts[0, 1:])):
            entry[wrong] = leave[wrong - 1]
            again = np.empty((BLOCK, len(wrong)), np.int32)
            leave[wrong] = self._run(np.ascontiguousarray(columns[:, wrong]), np.ascontiguousarray(starts[:, wrong]), entry[wrong], again)
            out[:, wrong] = again
        return out.T.ravel()[: len(symbols)]

    def tokens(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens in order, and where in the stream each begins."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        last = self.last_tokens(symbols, begins)
        first = np.flatnonzero(begins)
        at = np.append(first[1:], n)
        here = np.full(n, -1, np.int32)
        while len(at):
            i = last[at - 1]
            at = at - self.lengths[i]
            here[at] = i
            open_ = at > first
            at, first = at[open_], first[open_]
        where = np.flatnonzero(here >= 0)
        return here[where], where


#: Character kinds.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of each code point as the pre-tokenizers' classes have it."""
    if not _KINDS:
        import regex

        every = "".join(map(chr, range(0x110000)))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _KINDS.append(table)
    return _KINDS[0]


#: What is cut off at an apostrophe that begins a piece. Fixed values of both pre-tokenizers.
CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")


def _clitics(codes: np.ndarray, may: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes of ``may`` that begin a clitic, and its length with the apostrophe; not past ``limit``."""
    at, padded = np.flatnonzero(may), np.concatenate([codes, np.zeros(4, codes.dtype)])
    size = np.zeros(len(at), np.int64)
    for clitic in CLITICS:  # no clitic begins as another
        fits = np.ones(len(at), bool)
        for k, c in enumerate(clitic, 1):
            fits &= padded[at + k] == ord(c)
        size[fits & (at + len(clitic) < limit[at])] = len(clitic) + 1
    return at[size > 0], size[size > 0]


def kinds_of(library) -> np.ndarray:
    """``kinds`` as the library's pre-tokenizer sees them: versions of Unicode differ, so code points outside the
    old and common part of the planes in use are tried out, each twice in a row between two letters."""
    import unicodedata

    table = kinds().copy()
    doubtful = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) == "Cn" or (table[c] == OTHER) == (unicodedata.category(chr(c))[0] in "LN"))]
    pieces = library.pre_tokenizer.pre_tokenize_str("".join(f" x{chr(c)}{chr(c)}x" for c in doubtful))
    counts = np.zeros(5 * len(doubtful) + 1, np.int64)
    for _, (low, _high) in pieces:
        counts[low] = 1
    by = counts[:-1].reshape(len(doubtful), 5).sum(axis=1)
    table[doubtful] = np.select([by == 1, by == 3, by == 4], [LETTER, OTHER, NUMBER], SPACE)
    return table


def piece_begins(codes: np.ndarray, ends: np.ndarray, spaces_join: bool, single_numbers: bool, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the code points of texts that end at ``ends``, and which code points belong to none.

    ``spaces_join``: a space goes with the piece after it and other white space forms pieces; else white space
    only separates.  ``single_numbers``: each number is a piece.
    """
    n = len(codes)
    kind = (kinds() if table is None else table)[codes]
    sizes = np.diff(ends, prepend=0)
    heads = np.zeros(n + 1, bool)
    heads[(ends - sizes)[sizes > 0]] = True
    heads = heads[:n]
    last = np.repeat(ends, sizes)  # by code point, where its text ends
    before = np.concatenate([kind[:1], kind[:-1]])
    begins = heads | (kind != before)
    if single_numbers:
        begins |= kind == NUMBER
    space = kind == SPACE
    joined = np.zeros(n, bool)
    if spaces_join:
        final = np.append(heads[1:], True)
        follows = np.append(kind[1:] != SPACE, False) & ~final
        begins |= space & follows  # the last white space before something else stands apart from the run
        joined[1:] = (space & follows & (codes == 32))[:-1]
        begins &= ~joined
    apostrophe = (codes == 39) & begins
    at, size = _clitics(codes, apostrophe, last)
    if len(at):
        # within a clitic nothing begins, and right after it something does
        for k in (1, 2):
            inside = at[size > k] + k
            begins[inside] = False
        after = at + size
        after = after[after < n]
        begins[after[~joined[after]]] = True
    outside = np.zeros(n, bool) if spaces_join else space
    return begins & ~outside, outside


class ByteVocabulary:
    """Texts to ids for a byte vocabulary and the common pre-tokenizer that joins a space to what follows."""

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int] | None = None):
        to = lambda b: b.decode("latin-1")
        self.ids = {to(k): v for k, v in ids.items()}
        table = MergeTable({k: float(v) for k, v in self.ids.items()}, None if pairs is None else {(to(a), to(b)): float(r) for (a, b), r in pairs.items()})
        self.transducer = TokenTransducer(self.ids, table)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins, _ = piece_begins(codes, ends, True, False)
        data = np.frombuffer(joined.encode(), np.uint8)
        heads = (data & 0xC0) != 0x80  # first bytes of code points
        starts = np.zeros(len(data), bool)
        starts[heads] = begins
        ids, where = self.transducer.tokens(data, starts)
        at = np.append(np.flatnonzero(heads), len(data))[ends] if len(texts) else ends
        return ids, np.searchsorted(where, at)


def rank_vocabulary(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: itself, or the next free one past U+00FF."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class LibraryVocabulary:
    """A file of the tokenizers library: ids as ``encode_batch(texts, add_special_tokens=False)`` gives them.

    Takes the file's own normalizer and merges; a text that holds an added token's string goes to the library.
    ``joins``: the pre-tokenizer joins a space to what follows and has no word ends; else words end in a suffix.
    """

    def __init__(self, data: bytes):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        spec = json.loads(data)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.joins = not suffix
        self.kinds = kinds() if self.joins else kinds_of(self.library)
        letters = byte_letters()

        def symbols(token: str) -> str | None:
            ended = bool(suffix) and token.endswith(suffix)
            try:
                parts = [letters[c] for c in (token[: -len(suffix)] if ended else token)]
            except KeyError:
                return None  # not made of bytes: an added token
            if ended and parts:
                parts[-1] += 256
            return "".join(map(chr, parts))

        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        ids = {s: i for t, i in model["vocab"].items() if t not in added and (s := symbols(t))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = {(symbols(a), symbols(b)): float(r) for r, (a, b) in enumerate(merges)}
        self.transducer = TokenTransducer(ids, MergeTable({k: float(v) for k, v in ids.items()}, pairs))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        whole = {i: self.library.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts) if self.special is not None and self.special.search(x)}
        if whole:
            texts = ["" if i in whole else x for i, x in enumerate(texts)]
        if self.library.normalizer is not None:
            normal = self.library.normalizer.normalize_str
            texts = [x.lower() if x.isascii() else normal(x) for x in texts]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins, outside = piece_begins(codes, ends, self.joins, not self.joins, self.kinds)
        data = np.frombuffer(joined.encode(), np.uint8)
        heads = (data & 0xC0) != 0x80
        starts = np.zeros(len(data), bool)
        starts[heads] = begins
        at = np.append(np.flatnonzero(heads), len(data))
        if not self.joins:
            keep = ~np.repeat(outside, np.diff(at))
            at = np.append(0, np.cumsum(keep))[at]
            data, starts = data[keep].astype(np.int16), starts[keep]
            if len(data):
                data[np.append(np.flatnonzero(starts)[1:], len(data)) - 1] += 256
        ids, where = self.transducer.tokens(data, starts)
        ends = np.searchsorted(where, at[ends]) if len(texts) else ends
        if whole:
            parts, low = [], 0
            for i, high in enumerate(ends.tolist()):
                parts.append(np.asarray(whole[i], np.int32) if i in whole else ids[low:high])
                low = high
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends
