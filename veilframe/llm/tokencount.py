"""Operator 1, token counts: a transducer whose transitions carry the number of tokens they add.

The vocabulary is a SentencePiece BPE model.  Reading a text character by character, the number of tokens
of the prefix read so far changes by a small, possibly negative, number that depends on a finite state:
the longest suffix that a token can still grow out of and, for each place in it where a token may begin,
the class of the token before it.  States are determinised on demand into one dense table whose cells hold
the next state and the count; the table is emptied when it reaches ``MOST_CELLS`` and fills anew.

Texts are cut into chunks that advance in lockstep.  Mostly all states meet within a few characters, so a chunk's
map is constant and the entry state found by reading the end of the chunk before is right.  Where it isn't, as in runs
of one character, the text's chunks are read from up to ``ENTRIES`` states, and these state maps are composed by a
parallel prefix scan.  The result doesn't depend on the cuts.

Defined results: null and empty texts have 0 tokens; repeated rows and ties each get their own row; a
character outside the vocabulary counts as its UTF-8 bytes; an empty table gives an empty table; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, compiled, documents, map_batches, texts_of
from .mergetable import BorderClasses, MergeTable

MARK = "▁"
CHUNK, WARM_UP = 512, 24
#: States that a chunk's map is made for where one doesn't do.
ENTRIES = 32
#: Cells of the table, 4 bytes each.
MOST_CELLS = 24 << 20
MISSING, SHIFT, BIAS = -1, 8, 128


class CountingTransducer:
    """Counts tokens of texts as the SentencePiece library does for a BPE model with byte fallback."""

    def __init__(self, model: bytes, chunk: int = CHUNK, most_cells: int = MOST_CELLS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a higher score merges first; equal scores, as runs of marks have, merge from the left
        ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.table = MergeTable(ranks)
        self.chunk, self.most_cells = chunk, most_cells
        #: No token holds a mark after another character: what comes before a mark then doesn't matter.
        self.splits_at_mark = not any(MARK in t.lstrip(MARK) for t in self.table.right)
        atoms = {c for t in self.table.right for c in t}
        self.borders = BorderClasses(self.table)
        # one column for padding, four for characters outside the vocabulary by their UTF-8 length, then one for each character met
        self.column = np.full(0x110000, -1, np.int32)
        for low, high, n in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.column[low:high] = n
        for c in atoms:
            self.column[ord(c)] = -1
        self.column[ord(" ")] = -1
        self.characters = [None, 1, 2, 3, 4]
        self._clear()

    def _clear(self) -> None:
        self.borders.clear()
        self.width = max(64, len(self.characters))
        self.cells = np.full((1024, self.width), MISSING, np.int32)
        self.states: list = []
        self.numbers: dict = {}
        self.start = self._number(("", ((0, 0),)))
        self.begun = self._advance(self.start, self._column_of(MARK))[0]

    def _column_of(self, char: str) -> int:
        at = self.column[ord(char)]
        if at < 0:
            at = len(self.characters)
            self.characters.append(char)
            self.column[ord(char)] = at
            if char in (" ", MARK):
                self.column[ord(" ")] = self.column[ord(MARK)] = at
                self.characters[at] = MARK
        if at >= self.width:
            wider = np.full((len(self.cells), 2 * self.width), MISSING, np.int32)
            wider[:, : self.width] = self.cells
            self.cells, self.width = wider, 2 * self.width
        return int(at)

    def _number(self, state) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.cells):
                more = np.full((2 * len(self.cells), self.width), MISSING, np.int32)
                more[: len(self.cells)] = self.cells
                self.cells = more
            self.cells[n, 0] = n << SHIFT | BIAS
        return n

    def _advance(self, number: int, column: int) -> tuple[int, int]:
        """Next state and added tokens; written into the table."""
        suffix, places = self.states[number]
        char = self.characters[column]
        if isinstance(char, int):  # outside the vocabulary: its bytes, and nothing reaches across
            to, added = 0, char
        else:
            borders = self.borders
            if self.splits_at_mark and char == MARK and suffix[-1:] != MARK:
                suffix, places = "", ((0, 0),)
            tokens, stay, longest = borders.shape(suffix, char)
            for token, (before, count) in zip(tokens, places, strict=True):
                if token is not None and (before == 0 or borders.hold(before, token)):
                    added = count + 1
                    break
            kept = [(places[i][0] and borders.narrow(places[i][0], begun), places[i][1] - added) for i, begun in stay]
            to = self._number((longest, ((borders.after(token), 0), *kept)))
        self.cells[number, column] = to << SHIFT | added + BIAS
        return to, added

    def _run(self, columns: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes of ``columns`` (step, lane) from their ``entry`` states: exit states and counts."""
        state, count = entry.astype(np.int64), np.zeros(len(entry), np.int64)
        for row in columns:
            cell = self.cells.ravel().take(state * self.width + row)
            if cell.min(initial=0) < 0:
                missed = np.flatnonzero(cell < 0)
                for pair in np.unique(state[missed] << 32 | row[missed]).tolist():
                    self._advance(pair >> 32, pair & 0xFFFFFFFF)
                cell = self.cells.ravel().take(state * self.width + row)
            state = (cell >> SHIFT).astype(np.int64)
            count += (cell & 0xFF) - BIAS
        return state, count

    def count(self, texts: list[str]) -> np.ndarray:
        if self.cells.size > self.most_cells and len(self.states) > 1024:
            self._clear()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = np.zeros(len(texts), np.int64)
        if not lengths.sum():
            return counts
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        columns = self.column[codes]
        if columns.min() < 0:
            for c in np.unique(codes[columns < 0]).tolist():
                self._column_of(chr(c))
            columns = self.column[codes]
        c = self.chunk
        blocks = -(-lengths // c)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        begins = (np.cumsum(lengths) - lengths)[owner] + (np.arange(len(owner)) - first[owner]) * c
        sizes = np.minimum(c, np.cumsum(lengths)[owner] - begins)
        heads = np.arange(len(owner)) == first[owner]
        padded = np.concatenate([columns, np.zeros(c, columns.dtype)])
        lanes = padded[begins[None, :] + np.arange(c)[:, None]]
        lanes[np.arange(c)[:, None] >= sizes[None, :]] = 0
        entry = np.full(len(owner), self.begun, np.int64)
        inner = np.flatnonzero(~heads)
        if len(inner):
            entry[inner] = self._run(padded[begins[inner][None, :] + np.arange(-WARM_UP, 0)[:, None]], np.zeros(len(inner), np.int64))[0]
        leave, added = self._run(lanes, entry)
        while len(wrong := inner[entry[inner] != leave[inner - 1]]):
            # the texts concerned once more, from several states at a time
            chunks = np.flatnonzero(np.isin(owner, owner[wrong]))
            among, often = np.unique(np.concatenate([entry[chunks], leave[chunks]]), return_counts=True)
            among = np.sort(among[np.argsort(-often, kind="stable")[:ENTRIES]])
            to = self._maps(lanes, chunks, among)
            into = compose(to.index, heads[chunks], int(np.searchsorted(among, self.begun)) if self.begun in among else -1)
            fits = into >= 0
            fixed, by = chunks[fits], into[fits]
            leave[fixed], added[fixed], entry[fixed] = to.states[fits, by], to.added[fits, by], among[by]
            wrong = inner[entry[inner] != leave[inner - 1]]
            if len(wrong):  # states beyond the map's: each goes on from its neighbour
                entry[wrong] = leave[wrong - 1]
                leave[wrong], added[wrong] = self._run(np.ascontiguousarray(lanes[:, wrong]), entry[wrong])
        ends = (first + blocks - 1)[lengths > 0]
        total = np.cumsum(added)
        # the mark before each text, which ``begun`` has read, counts too
        counts[lengths > 0] = total[ends] - (total - added)[first[lengths > 0]] + 1
        return counts

    def _maps(self, lanes: np.ndarray, chunks: np.ndarray, among: np.ndarray) -> StateMaps:
        """The chunks' maps on the states ``among``."""
        states, added = np.empty((len(chunks), len(among)), np.int64), np.empty((len(chunks), len(among)), np.int64)
        columns = np.ascontiguousarray(lanes[:, chunks])
        for k, state in enumerate(among.tolist()):
            states[:, k], added[:, k] = self._run(columns, np.full(len(chunks), state, np.int64))
        at = np.searchsorted(among, states)
        at[at == len(among)] = 0
        return StateMaps(states, np.where(among[at] == states, at, -1), added)


class StateMaps:
    """By chunk and entry state: the exit state, which of the entry states that is (-1: none), and the tokens added."""

    def __init__(self, states: np.ndarray, index: np.ndarray, added: np.ndarray):
        self.states, self.index, self.added = states, index, added


def compose(index: np.ndarray, heads: np.ndarray, begun: int) -> np.ndarray:
    """By chunk, the entry state that the chunks before it lead to from ``begun``; -1: unknown.

    A parallel prefix scan: maps are composed with those 1, 2, 4, ... chunks before them within a text, until each
    reaches back to its text's first chunk.
    """
    n = len(heads)
    index, closed = index.copy(), heads.copy()
    step = 1
    while step < n and not closed.all():
        late = np.flatnonzero(~closed[step:]) + step
        before, after = index[late - step], index[late]
        joined = np.take_along_axis(after, np.maximum(before, 0), 1)
        done = closed[late - step]
        index[late] = np.where(before >= 0, joined, -1)
        closed[late] = done
        step *= 2
    into = np.full(n, begun, np.int64)
    inner = np.flatnonzero(~heads)
    into[inner] = index[inner - 1, begun] if begun >= 0 else -1
    return into


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens without begin, end or added tokens, over_limit.  No shuffle."""
    model = Shipped(docs.sparkSession, model_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = compiled(("count", model.key), lambda: CountingTransducer(model.bytes()))
        counts = machine.count(texts_of(batch.column(2)))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_batches(rows, each, "doc_id long, n_bytes long, n_tokens long", 4 << 20).withColumn("over_limit", F.col("n_tokens") > limit)
