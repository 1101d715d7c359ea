"""Byte-level BPE as a finite-state transducer that is determinised lazily.

After every byte of a piece, the tokens of the prefix read so far are one chain, and a prefix of length i extends the chain
of a shorter prefix by one token that is compatible with that chain's last one. A state of the transducer holds, for each
place where a token could still begin (the bytes since then start some token), the last token before it and the tokens that
are not common to all such places. What is common is final and is emitted, so lookahead is bounded by the longest token.
Short pieces do without these: the last token of each prefix is in its state, and the tokens are read off the path backwards.
States and transitions are made when first met and shared by all texts of a task.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview.llm.common import slices, small_batches, table, whole

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_TRANSITIONS = 150_000
"""Transitions of long pieces kept, and pairs of tokens; dropped and filled again beyond, which changes no result."""
MAX_SHORT_TRANSITIONS = 400_000
"""The same for short pieces, whose states are smaller."""
MAX_PIECES = 60_000
"""Tokens of short pieces kept per task process, and as many older ones. About 30 MB."""
LONG_PIECE, LONG_TEXT, STEP = 64, 1 << 20, 1 << 16
PLACES, TOKEN = -1, -2
"""Keys of a state of short pieces beside the bytes."""


class Transducer:
    """`tokens(piece)` gives the ids of one piece as the merges by ascending rank would.

    The transducer comes in two forms. A piece of up to LONG_PIECE bytes keeps its path, so the tokens can be read off it
    backwards, by the last token of each prefix; its states hold no pending tokens and are shared by far more pieces. A longer
    piece runs through states that hold them, and emits its tokens while it is read.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        # Beginnings of tokens as numbers: 0 for none read, `nexts` from number * 256 + byte to the next one.
        self.nexts: dict[int, int] = {}
        nexts, ends, grows = self.nexts, array("i", (-1,)), bytearray(1)
        for token, i in ranks.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                after = nexts.get(key)
                if after is None:
                    grows[at] = 1
                    after = nexts[key] = len(ends)
                    ends.append(-1)
                    grows.append(0)
                at = after
            ends[at] = i
        self.ends, self.grows = ends, grows
        """The token that a beginning is, or -1; whether a longer token begins so."""
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.reset()
        self.reset_short()

    def reset(self) -> None:
        # a place: (bytes since it, its last token, tokens before it that are not emitted); the last place is "here"
        start = ((0, -1, ()),)
        self.ids, self.states = {start: 0}, [start]
        self.moves: dict[int, int] = {}
        """state * 256 + byte -> next state, or ~i for the next state and tokens of `emitting[i]`."""
        self.emitting: list[tuple[int, tuple[int, ...]]] = []

    def reset_short(self) -> None:
        for state in getattr(self, "short_states", {}).values():
            state.clear()  # states refer to each other
        # a place: bytes since it << 32 | its last token + 1; the last place is "here"
        self.start = {PLACES: (0,)}
        self.short_states = {(0,): self.start}
        """places -> state: the next state by byte, its places and the last token of the prefix read."""
        self.short_moves = 0

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a single byte. (-1, -1) where no merges lead to it."""
        if token not in self.splits:
            data = self.bytes_of[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = None if len(data) == 1 else (-1, -1)
            if len(parts) == 2:
                left, right = self.ranks[parts[0]], self.ranks[parts[1]]
                if all(x < token and self.halves(x) != (-1, -1) for x in (left, right)):
                    found = left, right
            self.splits[token] = found
        return self.splits[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with exactly these two.

        Time is run backwards: of the two tokens that touch, the one merged last is taken apart, until an earlier merge
        across the border shows up or only bytes are left.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_TRANSITIONS:
                self.pairs.clear()
            known, x, y, before = self.halves(right) != (-1, -1), left, right, 1 << 60
            ranks, bytes_of, splits = self.ranks, self.bytes_of, self.splits
            while known and left >= 0:
                if ranks.get(bytes_of[x] + bytes_of[y], 1 << 61) < before:
                    known = False
                    break
                a = splits[x] if x in splits else self.halves(x)
                if a and x > y:
                    before, x = x, a[1]  # at equal ranks the merge further left comes first
                    continue
                b = splits[y] if y in splits else self.halves(y)
                if a and not b:
                    before, x = x, a[1]
                elif b:
                    before, y = y + 1, b[0]
                else:
                    break
            self.pairs[key] = known
        return known

    def move(self, state: int, byte: int) -> int:
        """Makes a transition, to the next state with the tokens that have become final; returns its entry in `moves`."""
        places, here = [], None
        for since, last, pending in self.states[state]:
            grown = self.nexts.get(since << 8 | byte)
            if grown is None:
                continue
            token = self.ends[grown]
            if token >= 0 and here is None and self.compatible(last, token):
                here = (0, token, (*pending, token))
            if self.grows[grown]:
                places.append((grown, last, pending))
        places.append(here)
        first, shared = here[2], 0
        if places[0][2] is not first and places[0][2][:1] == first[:1]:
            shared = min(len(p[2]) for p in places)
            for p in places:
                while p[2][:shared] != first[:shared]:
                    shared -= 1
        elif len(places) == 1:
            shared = len(first)
        if shared:
            places = [(since, last, pending[shared:]) for since, last, pending in places]
        target = tuple(places)
        known = self.ids.setdefault(target, len(self.states))
        if known == len(self.states):
            self.states.append(target)
        if shared:
            self.emitting.append((known, first[:shared]))
            known = ~(len(self.emitting) - 1)
        self.moves[state << 8 | byte] = known
        return known

    def short_move(self, state: dict, byte: int) -> dict:
        """Makes a transition without pending tokens; returns the next state."""
        places, here, nexts, ends, grows, pairs = [], -1, self.nexts, self.ends, self.grows, self.pairs
        for place in state[PLACES]:
            grown = nexts.get(place >> 32 << 8 | byte)
            if grown is None:
                continue
            last = place & 0xFFFFFFFF
            if here < 0 and (token := ends[grown]) >= 0:
                fits = pairs.get(last - 1 << 32 | token)
                if self.compatible(last - 1, token) if fits is None else fits:
                    here = token
            if grows[grown]:
                places.append(grown << 32 | last)
        places.append(here + 1)
        target = tuple(places)
        after = self.short_states.get(target)
        if after is None:
            after = self.short_states[target] = {PLACES: target, TOKEN: here}
        state[byte] = after
        self.short_moves += 1
        return after

    def tokens(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= LONG_PIECE:
            return self.short_tokens(piece)
        if len(self.moves) > MAX_TRANSITIONS:
            self.reset()
        state, out, get = 0, [], self.moves.get
        for byte in piece:
            entry = get(state << 8 | byte)
            if entry is None:
                if len(self.moves) > 2 * MAX_TRANSITIONS:  # one endless piece: keep only the state it is in
                    kept = self.states[state]
                    self.reset()
                    get = self.moves.get
                    state = self.ids.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                entry = self.move(state, byte)
            if entry >= 0:
                state = entry
            else:
                state, emitted = self.emitting[~entry]
                out += emitted
        out += self.states[state][-1][2]
        return out

    def short_tokens(self, piece: bytes) -> list[int]:
        if self.short_moves > MAX_SHORT_TRANSITIONS:
            self.reset_short()
        state, path = self.start, []
        for byte in piece:
            after = state.get(byte)
            state = self.short_move(state, byte) if after is None else after
            path.append(state)
        out, at = [], len(path)
        while at:
            token = path[at - 1][TOKEN]
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        return out


class Pieces(dict):
    """Tokens of short pieces by text, filled by the transducer; what has not been asked for lately is dropped."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.older: dict = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.transducer.tokens(piece.encode()))
        if len(piece) <= LONG_PIECE:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(Transducer(ranks))
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))), np.int32)
        found, parts = (m.group() for m in self.pattern.finditer(text)), []  # the pieces of a very long text, some at a time
        while some := list(islice(found, STEP)):
            parts.append(np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, some)), np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


#: Follow-up bytes that a UTF-8 lead byte announces: fixed by the encoding.
_FOLLOWERS = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11


class Utf8Stream:
    """Incremental UTF-8 decoding: feeds of bytes that may end inside a character.

    The state is the unfinished character, three bytes at most; malformed bytes become U+FFFD as in `bytes.decode`.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            byte = data[end - back]
            if byte & 0xC0 == 0x80:
                continue
            if _FOLLOWERS[byte] >= back:  # a lead byte that waits for more
                end -= back
            break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text in parts of STEP tokens, none of which ends inside a character."""
        utf8 = Utf8Stream()
        for at in range(0, len(ids), STEP):
            yield utf8.feed(b"".join([self.tokens[i] for i in ids[at:at + STEP].tolist()]))
        yield utf8.finish()

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(data), pattern)


@lru_cache(maxsize=2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(read_ranks(data))


@contextmanager
def _tables():
    """The tables of tokens and transitions end with the task: a worker process that goes on to other work keeps none.

    Meanwhile cycles are not looked for: there are none but in the tables, which would be gone through again and again.
    """
    gc.disable()
    try:
        yield
    finally:
        _encoder.cache_clear()
        _decoder.cache_clear()
        gc.enable()
        gc.collect()


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file, read on the driver and broadcast: its size is that of the vocabulary, under 1 MB here."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("_none")]
    return docs.select(F.struct(*others).alias("row"), whole(text_col).alias("text"))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, text_col: str = "text", ranks=None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(row, ids): `row` is a struct of all columns but the text, so no name can clash; ids array<int>.

    Each match of `pattern` is encoded on its own, special tokens are ordinary text. A null text is empty and has no ids.
    """
    held = ranks or vocabulary(docs.sparkSession)
    work = _rows(docs, text_col)

    def run(batches):
        with _tables():
            encoder = _encoder(held.value, pattern)
            for batch in (part for b in batches for part in slices(b, 1)):
                ids = [encoder.encode(text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["row", "ids"])
            del encoder

    return work.mapInArrow(run, f"row {work.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks=None) -> DataFrame:
    """(row, ids, text) of `encoded(row, ids)`; null ids give an empty text."""
    held = ranks or vocabulary(encoded.sparkSession)

    def run(batches):
        with _tables():
            decoder = _decoder(held.value)
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                texts = [decoder.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), pa.array(texts, pa.string())], ["row", "ids", "text"])
            del decoder

    kept = encoded.select("row", "ids")
    return kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, text_col: str = "text", ranks=None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`decode(encode(docs))` in one pass of the same process: (row, ids, text)."""
    held = ranks or vocabulary(docs.sparkSession)
    work = _rows(docs, text_col)

    def run(batches):
        with _tables():
            encoder, decoder = _encoder(held.value, pattern), _decoder(held.value)
            for batch in (part for b in batches for part in slices(b, 1)):
                ids = [encoder.encode(text.as_py()) for text in batch.column(1)]
                texts = pa.array([decoder.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), texts], ["row", "ids", "text"])
            del encoder, decoder

    return work.mapInArrow(run, f"row {work.schema['row'].dataType.simpleString()}, ids array<int>, text string")


def op1_byte_bpe(spark, sf_dir):
    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
