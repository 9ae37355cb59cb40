"""Operator 5, byte-level BPE: encoding by a transducer, decoding by a UTF-8 machine.

Encoding: the matches of the pre-tokenizer's pattern are read byte by byte.  A state holds the class of the last token
already emitted and the bytes after it whose tokens are still open; a transition emits the tokens on which every way to go on
agrees, so the lookahead is bounded by the bytes that a token can still grow out of.  States and transitions are
determinised when first met and dropped together when ``MOST_STATES`` is reached; dropping changes no result.  The
ids of short pieces are kept, so that a frequent word is read once a batch of words.

Decoding: a machine whose state is the incomplete UTF-8 sequence read so far (at most three bytes) and whose
input is a token id; ids may arrive in pieces of any size, and ill-formed bytes become U+FFFD as usual.

Defined results: null and empty texts give no ids, whose digest is that of the empty string; repeated rows
each get their row; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shipped, compiled, documents, map_batches, texts_of, without_collection
from .mergetable import BorderClasses, MergeTable
from .tokenstream import rank_vocabulary

MOST_STATES = 400_000
MOST_MOVES = 400_000
#: Pieces of at most ``SHORT`` characters whose ids are kept, and how many in each of two generations.
SHORT, MOST_PIECES = 24, 250_000


class State(dict):
    """Transitions by byte: (next state, ids emitted)."""

    __slots__ = ("before", "pending", "lasts", "flush")

    def __init__(self, before: int, pending: str, lasts: tuple[int, ...]):
        self.before, self.pending, self.lasts, self.flush = before, pending, lasts, None


class EmittingTransducer:
    """Emits the ids of pre-tokenized pieces as their bytes are read."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.table = MergeTable(self.ids)
        self.borders = BorderClasses(self.table)
        #: In the vocabulary, but no merges lead there: as whole pieces they are looked up.
        self.unreachable = {k.encode("latin-1"): [v] for k, v in self.ids.items() if k not in self.table.right}
        self.most_states = most_states
        self._clear()

    def _clear(self) -> None:
        self.borders.clear()
        self.states: dict[tuple, State] = {}
        self.start = self._state(0, "", ())

    def _state(self, before: int, pending: str, lasts: tuple[int, ...]) -> State:
        """``before``: the class of the last token emitted, as far as it matters to tokens that begin with ``pending``;
        ``lasts``: lengths of the last tokens of each prefix of ``pending``, 0 where they can't matter."""
        key = (before, pending, lasts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(*key)
        return found

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Read one byte: the next state and the ids emitted."""
        before, lasts, borders = state.before, state.lasts, self.borders
        right, prefixes, holds = self.table.right, self.table.prefixes, self.table.border_holds
        text = state.pending + chr(byte)
        n = len(text)
        for at in range(n):
            if at and not lasts[at - 1]:
                continue
            token = text[at:]
            if token in right or at == n - 1:
                if (before == 0 or borders.hold(before, token)) if at == 0 else holds(text[at - lasts[at - 1] : at], token):
                    break
        lasts = (*lasts, n - at)
        alive = [p for p in range(n + 1) if text[p:] in prefixes and (p == 0 or lasts[p - 1])]
        chains = [self._chain(lasts, p) for p in alive]
        common = 0
        while all(len(c) > common for c in chains) and len({c[common] for c in chains}) == 1:
            common += 1
        cut = chains[0][common - 1] if common else 0
        emitted, at = [], 0
        for end in chains[0][:common]:
            token = text[at:end]
            emitted.append(self.ids[token])
            at = end
        if common:
            before = borders.after(token)
        kept = {q for c in chains for q in c}
        lasts = tuple(lasts[i] if i + 1 in kept else 0 for i in range(cut, n))
        pending = text[cut:]
        before = borders.narrow(before, pending) if before and cut in alive else 0
        move = state[byte] = self._state(before, pending, lasts), tuple(emitted)
        return move

    @staticmethod
    def _chain(lasts, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(at)
            at -= lasts[at - 1]
        return out[::-1]

    def _flush(self, state: State) -> tuple[int, ...]:
        out, at = [], 0
        for end in self._chain(state.lasts, len(state.pending)):
            out.append(self.ids[state.pending[at:end]])
            at = end
        state.flush = tuple(out)
        return state.flush

    def emit(self, pieces: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of one piece whose bytes arrive in parts, as soon as they are certain; the rest at the end."""
        state = self.start
        for part in pieces:
            out: list[int] = []
            for byte in part:
                state, ids = state.get(byte) or self._move(state, byte)
                out += ids
            yield tuple(out)
        yield state.flush or self._flush(state)

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.unreachable:
            return self.unreachable[piece]
        if len(self.states) > self.most_states:
            self._clear()
        state, out = self.start, []
        for byte in piece:
            move = state.get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        out += state.flush or self._flush(state)
        return out


class KnownPieces(dict):
    """Ids by piece, read by the transducer when first asked for; pieces that weren't asked for in a while are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._older = encode, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self._older.get(piece)
        if ids is None:
            ids = self._encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= SHORT:
            if len(self) >= MOST_PIECES:
                self._older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _whole(token: bytes) -> str | None:
    text, left = advance_utf8(b"", token)
    return None if left or "�" in text else text


class ByteBPE:
    """A rank file with the common byte-level pre-tokenizer."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = rank_vocabulary(rank_file)
        self.encoder = EmittingTransducer(self.ranks)
        self.pieces_of = regex.compile(pattern).findall
        self.vocabulary = {i: k for k, i in self.ranks.items()}
        #: By state, the incomplete sequence: id -> (text, next state, its table).
        self.decoder_moves: dict[bytes, dict] = {}
        self.decoder_size = 0
        #: Text of tokens that are whole characters, which leave the machine as it was; None for others.
        self.whole = {i: _whole(k) for k, i in self.ranks.items()}
        self.decimal = [str(i) for i in range(max(self.vocabulary) + 1)].__getitem__
        self.known = KnownPieces(self.encoder.encode_piece)

    def encode_text(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, self.pieces_of(text))))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_text(t) for t in texts]

    def decode_stream(self, pieces: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of ids that arrive in pieces; each piece's complete characters are yielded with it."""
        tables = self.decoder_moves
        if self.decoder_size > MOST_MOVES:
            tables.clear()
            self.decoder_size = 0
        table, state = tables.setdefault(b"", {}), b""
        for ids in pieces:
            out = []
            for i in ids:
                move = table.get(i)
                if move is None:
                    text, to = advance_utf8(state, self.vocabulary[i])
                    move = table[i] = text, to, tables.setdefault(to, {})
                    self.decoder_size += 1
                text, state, table = move
                out.append(text)
            yield "".join(out)
        if state:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        whole = list(map(self.whole.__getitem__, ids))
        return "".join(self.decode_stream([ids])) if None in whole else "".join(whole)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def advance_utf8(state: bytes, more: bytes) -> tuple[str, bytes]:
    """The UTF-8 machine: characters completed by ``more`` after the incomplete sequence ``state``, and the new one.

    The lead byte fixes how many bytes follow and the range of the first of them (no overlong forms, no
    surrogates, nothing past U+10FFFF); a byte that can't follow ends the sequence as U+FFFD and is read anew.
    """
    out, open_ = [], state
    for b in more:
        while True:
            if not open_:
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xF4:
                    open_ = bytes([b])
                else:
                    out.append("�")
                break
            lead = open_[0]
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            low, high = 0x80, 0xBF
            if len(open_) == 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
            if low <= b <= high:
                open_ += bytes([b])
                if len(open_) == need:
                    out.append(open_.decode())
                    open_ = b""
                break
            out.append("�")
            open_ = b""
    return "".join(out), open_


def _codec(ranks: Shipped, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    return compiled(("bytes", ranks.key, pattern), lambda: ByteBPE(ranks.bytes(), pattern))


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its ids.  No shuffle."""
    ranks = Shipped(docs.sparkSession, rank_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks)
        return pa.record_batch([batch.column(0), pa.array(codec.encode(texts_of(batch.column(1))), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(documents(docs, id_col, text_col), each, "doc_id long, ids array<int>", 1 << 20)


def decode(rows: DataFrame, rank_path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text.  No shuffle; null ids give an empty text."""
    ranks = Shipped(rows.sparkSession, rank_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks)
        return pa.record_batch([batch.column(0), pa.array([codec.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(rows.select("doc_id", "ids"), each, "doc_id long, text string", 4 << 20)


def round_trip_digests(docs: DataFrame, rank_path: str) -> DataFrame:
    """Encode, decode, and keep digests only: doc_id, n_tokens, ids_sha256, decoded_sha256.  One pass, no shuffle."""
    ranks = Shipped(docs.sparkSession, rank_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks)
        n, a, b = [], [], []
        with without_collection():
            for ids in codec.encode(texts_of(batch.column(1))):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(codec.decimal, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents(docs), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1 << 20)
