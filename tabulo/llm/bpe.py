"""Byte-level BPE encoding and decoding (operator 3).

A vocabulary of ranked byte strings is compiled into a finite-state transducer.  It rests on two facts
about BPE: the encoding of a text is the one segmentation in which every two neighbouring tokens stay as
they are when encoded together, and the encoding of every prefix is fixed by that prefix.  After some
bytes the hypotheses are "the encoding of a prefix, then the beginning of one more token"; the machine is
determinised lazily, only for the inputs that occur: a state is the set of beginnings, which the longest of
them determines, so there are no more states than beginnings of tokens.  Entering a state fixes the last
token of the encoding so far: the one of the tokens that end here which stays beside the token before it.
What all live hypotheses share is emitted, every LOOKAHEAD bytes and at the end of a piece.

Decoding concatenates the bytes of the tokens and turns them into text with a UTF-8 state machine that
keeps an unfinished character (three bytes at most) between calls; malformed bytes become U+FFFD.

Both run inside Arrow UDFs: no shuffle, memory bounded by the batch, the vocabulary, and the memos of pieces
and of token pairs (pairs start afresh at a fixed number of entries; pieces that come again outlive it, or a corpus of more distinct
pieces than that would have its frequent ones encoded again and again), all of which go when another operator takes the
worker; any task can be run again.

Edge cases: a null text or null id list is read as empty (no tokens, empty text); other columns are kept
as they are, whatever their names; an id outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import functools
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take_worker

#: bound of a rank file that is sent to the executors
MAX_RANK_BYTES = 64 << 20
#: entries of the memos of a worker; of pieces, those of two generations
MAX_PAIRS = 500_000
MAX_PIECES = 400_000
#: bytes after which a long piece emits what is settled
LOOKAHEAD = 4096


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class Transducer:
    """bytes -> token ids, one piece at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"not byte-level: no token for the byte {missing[0]}")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.width = {i: len(b) for b, i in ranks.items()}
        self.beginnings = {b[:i + 1] for b in ranks for i in range(len(b))}
        self.shift = max(ranks.values()).bit_length() + 1
        self.start = 1 << (self.shift - 1)  # stands before the first token; no id is that large
        self._together: dict[int, bool] = {}
        self.states = [b""]
        self.number = {b"": 0}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.arcs: list[dict[int, int]] = [{}]

    def _merged(self, data: bytes) -> list[int]:
        """BPE by definition: merge the leftmost pair of the lowest rank until none is left."""
        parts, none, rank = [data[i:i + 1] for i in range(len(data))], len(self.ranks), self.ranks.get
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def _stay(self, a: int, b: int) -> bool:
        """Whether the token b stays as it is behind a, or at the start."""
        if a == self.start:
            return self._merged(self.bytes_of[b]) == [b]
        return self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _arc(self, state: int, byte: int) -> int:
        """The state after the byte: the longest beginning of a token that ends there."""
        begun = self.states[state] + bytes([byte])
        while begun not in self.beginnings:
            begun = begun[1:]
        target = self.number.get(begun)
        if target is None:
            target = self.number[begun] = len(self.states)
            self.states.append(begun)
            ends = (begun[i:] for i in range(len(begun)))
            self.ends.append(tuple((len(e), self.ranks[e]) for e in ends if e in self.ranks))
            self.arcs.append({})
        self.arcs[state][byte] = target
        return target

    def _settled(self, last: list[int], state: int) -> int:
        """The position up to which all live hypotheses have the same tokens."""
        at = len(last) - 1
        live = set(range(at - len(self.states[state]), at + 1))
        while len(live) > 1:  # back to where they meet
            far = max(live)
            live.remove(far)
            live.add(far - self.width[last[far]])
        return live.pop()

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens up to a position, from the last token of every prefix."""
        out = []
        while at:
            out.append(last[at])
            at -= self.width[last[at]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        together, arcs, ends, shift, settle = self._together, self.arcs, self.ends, self.shift, LOOKAHEAD
        if len(together) > MAX_PAIRS:
            together.clear()
        out: list[int] = []
        state, last, at = 0, [self.start], 0
        for byte in piece:
            at += 1
            state = arcs[state].get(byte) or self._arc(state, byte)
            for width, token in ends[state]:
                before = last[at - width]
                pair = before << shift | token
                stays = together.get(pair)
                if stays is None:
                    stays = together[pair] = self._stay(before, token)
                if stays:
                    break
            last.append(token)
            if at >= settle and at >= settle + len(self.states[state]):
                meet = self._settled(last, state)
                if meet:
                    out += self._back(last, meet)
                    del last[:meet]
                    at -= meet
        return out + self._back(last, at)


class StreamDecoder:
    """Token ids -> text, in any number of calls.  States of the machine are the lead bytes' demands:
    how many continuation bytes are still due and the range of the next one."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.pending = bytes_of, b""

    @staticmethod
    def _due(lead: int) -> tuple[int, int, int]:
        """Continuation bytes due after this byte, and the range of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0x80, 0xBF

    def _cut(self, data: bytes) -> int:
        """Where an unfinished character at the end begins, or the length."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            due, low, high = self._due(lead)
            tail = data[len(data) - back + 1:]
            unfinished = len(tail) < due and (not tail or low <= tail[0] <= high)
            return len(data) - back if unfinished else len(data)
        return len(data)

    def feed(self, ids) -> str:
        try:
            data = self.pending + b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None
        cut = self._cut(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


class _Pieces(dict):
    """piece -> its ids as int32 bytes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def age(self) -> None:
        """A new generation once this one is full; what the last one held and this one did not ask for goes."""
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()


@functools.lru_cache(maxsize=2)
def _pieces(blob: bytes) -> _Pieces:
    return _Pieces(Transducer(read_ranks(blob)))


@functools.lru_cache(maxsize=2)
def _bytes_of(blob: bytes) -> dict[int, bytes]:
    return {i: b for b, i in read_ranks(blob).items()}


class Tokenizer:
    """Column functions of one vocabulary.  `path` is a file of base64 tokens and ranks that the driver
    can read; its bytes (size checked) go to the executors, which need no file."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            blob = f.read(MAX_RANK_BYTES + 1)
        if len(blob) > MAX_RANK_BYTES:
            raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes")
        sent = spark.sparkContext.broadcast(blob)

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            take_worker("bpe", _pieces.cache_clear, _bytes_of.cache_clear)
            pieces = _pieces(sent.value)
            split, of = regex.compile(pattern).findall, pieces.__getitem__
            found = []
            for text in texts:
                pieces.age()
                found.append(b"".join(map(of, split(text.as_py()))))
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            take_worker("bpe", _pieces.cache_clear, _bytes_of.cache_clear)
            bytes_of = _bytes_of(sent.value)
            out = []
            for row in ids:
                stream = StreamDecoder(bytes_of)
                out.append(stream.feed(row.values.to_numpy(zero_copy_only=False).tolist()) + stream.end())
            return pa.array(out, pa.string())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Ids of the whole text (null: empty); each match of the pattern is encoded by itself."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """Text of an id list (null: empty)."""
        return self._decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of their texts in a further column (replaced if it is there)."""
    tokenizer = Tokenizer(docs.sparkSession, path, pattern)
    return docs.withColumn(ids, tokenizer.encode(F.col(text)))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    tokenizer = Tokenizer(docs.sparkSession, path, pattern)
    return docs.withColumn(text, tokenizer.decode(F.col(ids)))
