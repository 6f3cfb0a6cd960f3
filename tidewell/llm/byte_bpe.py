"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

The merges are compiled into a transducer over bytes.  Its nondeterministic form guesses, at every
token boundary, which vocabulary token comes next; a guess survives only if the pair (previous
token, token) is *stable*, that is if merging the bytes of the two tokens yields exactly that pair.
A token sequence is the result of the merges if and only if all its adjacent pairs are stable, so
exactly one path survives.  Determinisation is lazy: a state is the set of live guesses with the
output each still owes; the common part of what they owe is emitted at once, so output comes after
a lookahead of at most the longest token's bytes beyond the point where the guesses agree.

Input columns used: the id column and the text column; all others are ignored, so clashing names do
no harm.  A text of any length takes time in proportion to it.  A null text counts as empty and gives no
tokens; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array as words
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Idle

ROOT = 0
#: Rows whose texts a worker holds as Python strings at a time.
ROWS = 500
#: Entries of a memo's young half, and of the transducer's moves before it starts anew: a worker's memory stays
#: bounded, at about 1.2 KB for each.
MEMO = 450_000
#: Longer pieces are rare and may be very long: they are encoded each time, so that a memo's bytes are bounded too.
LONG = 64
#: Bytes of a piece after which the transducer's size is looked at again.
STRETCH = 1 << 14
#: A live guess is one number: the trie node below this bit, the token before it plus one above.
NODE_BITS = 24
NODE_MASK = (1 << NODE_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a line is a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 40) -> list[int]:
    """Ids by applying the merges of ranks under ``below`` to one piece, lowest first; what the transducer compiles."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min([(ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)])
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class MergeTransducer:
    """Deterministic states are built when first reached. ``encode`` runs one piece through them."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.memo = ranks, memo
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.arcs: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                following = self.arcs.get(node << 8 | byte)
                if following is None:
                    following = self.arcs[node << 8 | byte] = len(self.accepts)
                    self.accepts.append(-1)
                node = following
            self.accepts[node] = rank
        self.inner = bytearray(len(self.accepts))
        for arc in self.arcs:
            self.inner[arc >> 8] = 1
        self.pairs: dict[int, bool] = {}
        self.undo()
        self.reset()

    def reset(self) -> None:
        """Forget the deterministic states. A state is (live guesses, output each owes or None if none does)."""
        start = ((ROOT,), None)
        self.states, self.number, self.moves = [start], {start: 0}, {}
        self.final: list[tuple[int, ...]] = [()]

    def undo(self) -> None:
        """The two tokens that each token's last merge joined; -1 for bytes and for what no merge makes."""
        size = max(self.token_bytes) + 1
        self.left_of, self.right_of = words("i", [-1]) * size, words("i", [-1]) * size
        for token, whole in self.token_bytes.items():
            parts = merge(whole, self.ranks, token)
            if len(parts) == 2:
                self.left_of[token], self.right_of[token] = parts

    def stable(self, before: int, token: int) -> bool:
        """Whether the merges keep the boundary. ``before`` is a token plus one, 0 at the start of a piece.

        Merges are undone from the last to the first on both sides of the boundary.  While two parts
        stand next to it they would be joined across it if their merge came before ``until``, when one of
        them is used up by its own side; of equal merges the left one comes first.
        """
        if len(self.pairs) > self.memo:
            self.pairs.clear()
        if not before:
            known = merge(self.token_bytes[token], self.ranks) == [token]
        else:
            ranks, whole, left_of, right_of = self.ranks, self.token_bytes, self.left_of, self.right_of
            left, right, until = before - 1, token, len(self.ranks) + 1
            while True:
                if ranks.get(whole[left] + whole[right], until) < until:
                    known = False
                    break
                inner, outer = right_of[left], left_of[right]
                if inner >= 0 and (outer < 0 or left > right):
                    left, until = inner, left
                elif outer >= 0:
                    right, until = outer, right + 1
                else:
                    known = True
                    break
        self.pairs[before << 20 | token] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        guesses, owing = self.states[state]
        arcs, accepts, inner, pairs = self.arcs, self.accepts, self.inner, self.pairs
        live, owed, end, n = [], [], (), 0
        for i, guess in enumerate(guesses):
            node = arcs.get((guess & NODE_MASK) << 8 | byte)
            if node is None:
                continue
            token = accepts[node]
            if token >= 0:
                before = guess >> NODE_BITS
                fits = pairs.get(before << 20 | token)
                if fits or (fits is None and self.stable(before, token)):
                    end = (*owing[i], token) if owing else (token,)
                    live.append((token + 1) << NODE_BITS | ROOT)
                    owed.append(end)
            if inner[node]:
                live.append(guess & ~NODE_MASK | node)
                owed.append(owing[i] if owing else ())
        if len(live) == 1:
            n = len(owed[0])
        elif owing:  # else somebody owes nothing yet
            common = min(owed, key=len)
            n = len(common)
            while n and any([o[:n] != common[:n] for o in owed]):
                n -= 1
        out = owed[0][:n]
        if n:
            owed = [o[n:] for o in owed]
            end = end[n:]
        reached = tuple(live), tuple(owed) if any(owed) else None
        target = self.number.get(reached)
        if target is None:
            target = self.number[reached] = len(self.states)
            self.states.append(reached)
            self.final.append(end)
        move = self.moves[state << 8 | byte] = target, out
        return move

    def forget(self, state: int) -> int:
        """Start anew but for one state; returns its new number."""
        kept, end = self.states[state], self.final[state]
        self.reset()
        if kept not in self.number:
            self.number[kept] = len(self.states)
            self.states.append(kept)
            self.final.append(end)
        return self.number[kept]

    def encode(self, piece: bytes) -> list[int]:
        state, out = 0, []
        for at in range(0, len(piece), STRETCH):
            if len(self.moves) > self.memo:
                state = self.forget(state)
            moves = self.moves
            for byte in piece[at : at + STRETCH]:
                move = moves.get(state << 8 | byte) or self.step(state, byte)
                state = move[0]
                if move[1]:
                    out += move[1]
        out += self.final[state]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoder: bytes in any split, text out as soon as a character is whole.

    The state is the unfinished character's bytes (three at most).  Malformed input becomes U+FFFD.
    """

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                return back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self.unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.waiting = self.waiting, b""
        return left.decode("utf-8", "replace")


class Memo(dict):
    """Two generations: when the young one is full it becomes the old one; what is used again moves back. Pieces over LONG characters aren't kept."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > LONG:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class Codec:
    """Whole texts to ids and back. Each match of ``pattern`` is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.transducer = MergeTransducer(ranks, memo)
        self.split = regex.compile(pattern).findall
        encode = self.transducer.encode
        self.memo = Memo(lambda piece: words("I", encode(piece.encode("utf-8"))).tobytes(), memo)
        self.bytes_of = [self.transducer.token_bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]
        #: Text of the tokens that are whole characters; the others need the byte state.
        self.text_of: list[str | None] = []
        for token in self.bytes_of:
            try:
                self.text_of.append(token.decode("utf-8"))
            except UnicodeDecodeError:
                self.text_of.append(None)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        return b"".join([memo[piece] for piece in self.split(text)])

    def decode(self, ids: bytes) -> str:
        tokens = words("I", ids)
        text_of = self.text_of
        try:
            return "".join([text_of[t] for t in tokens])  # no character is split between tokens
        except TypeError:
            pass
        stream, out = Utf8Stream(), []
        for t in tokens:
            text = text_of[t]
            out.append(text if text is not None and not stream.waiting else stream.feed(self.bytes_of[t]))
        return "".join(out) + stream.close()


_codecs: dict[tuple[str, str, int], Codec] = {}
_idle = Idle(_codecs.clear)


def busy():
    return _idle.busy()


def codec(path: str, pattern: str, memo: int) -> Codec:
    """One codec a worker; its memos serve all the worker's tasks."""
    if (path, pattern, memo) not in _codecs:
        _codecs[path, pattern, memo] = Codec(read_ranks(path), pattern, memo)
    return _codecs[path, pattern, memo]


def _mapped(rows: DataFrame, path: str, pattern: str, work, columns: str, memo: int = MEMO) -> DataFrame:
    """Adds ``columns``, which ``work(codec, values of the second column)`` gives for each batch; drops that column. No shuffle.

    ``path`` must be readable on the executors, as an installed vocabulary package is.
    """
    kept = [f for i, f in enumerate(rows.schema.fields) if i != 1]
    schema = T.StructType(kept + T._parse_datatype_string(columns).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with busy():
            yield from coded(batches)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, memo)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                same = [part.column(i) for i in range(part.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*same, *work(own, part.column(1).to_pylist())], schema.names)

    return rows.mapInArrow(run, schema)


def _encoded(own: Codec, values: list[str | None]) -> list[pa.Array]:
    return [pa.array([own.encode(t) if t else b"" for t in values], pa.binary())]


def _decoded(own: Codec, values: list[bytes | None]) -> list[pa.Array]:
    return [pa.array(values, pa.binary()), pa.array([own.decode(ids) if ids else "" for ids in values], pa.string())]


def _both(own: Codec, values: list[str | None]) -> list[pa.Array]:
    return _decoded(own, _encoded(own, values)[0].to_pylist())


def _texts(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, ids_le): the token ids as little-endian unsigned 32-bit integers."""
    return _mapped(_texts(docs, id_col, text_col), ranks_path, pattern, _encoded, "ids_le binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Takes the result of encode() and returns (id, ids_le, decoded). Null ids decode to the empty text."""
    return _mapped(tokens.select(F.col(id_col), F.col("ids_le")), ranks_path, pattern, _decoded, "ids_le binary, decoded string")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), memo: int = MEMO
) -> DataFrame:
    """decode(encode(docs)) in one pass, the columns in ``carry`` after the id: one worker encodes the texts and decodes their ids."""
    return _mapped(_texts(docs, id_col, text_col, carry), ranks_path, pattern, _both, "ids_le binary, decoded string", memo)
