"""Byte-level BPE: encoding and decoding by a table of ranked byte strings.

Encoding has two tiers.  A minimal perfect hash over the vocabulary resolves a pre-token
that is a token itself, in one probe and one comparison.  Any other pre-token goes through
the merges: its bytes are a linked list, and a heap yields the adjacent pair of least rank,
leftmost first, until no pair is a token.  The cost is n log n in the length of a
pre-token, so texts of one unbroken run are no special case.

Pre-tokens repeat, so each worker keeps a bounded memo from space-led pieces of text and from pre-tokens to
their ids, and one of pairs to their ranks; they change no result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

_MASK = (1 << 64) - 1
MEMO_PIECES = 300_000
MEMO_PAIRS = 100_000
#: Spaces beside other white space keep a text from being cut at its spaces.
_UNEVEN = regex.compile(r" \s|\s ")


class PerfectHash:
    """Minimal perfect hash over n distinct byte strings, by hashing and displacing.

    Strings fall into buckets; the fullest buckets first choose the displacement that sends
    all their strings to free slots.  A bucket of one string takes a free slot by number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("the strings are not distinct")
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.n_buckets, []).append(i)
        self.displace = [0] * self.n_buckets
        self.order = [-1] * n  # slot -> position of its string
        singles = []
        for at, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((at, members[0]))
                continue
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in members}
                if len(slots) == len(members) and all(self.order[s] < 0 for s in slots):
                    break
                d += 1
            self.displace[at] = d
            for i in members:
                self.order[self._slot(hashes[i], d)] = i
        free = (s for s in range(n) if self.order[s] < 0)
        for at, i in singles:
            slot = next(free)
            self.displace[at] = -slot - 1
            self.order[slot] = i

    def _slot(self, h: int, d: int) -> int:
        h = ((h >> 7) + d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & _MASK
        return (h ^ h >> 31) % self.n

    def position(self, key: bytes) -> int:
        """The position of ``key``, if it is one of the strings; else that of some string."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        return self.order[-d - 1 if d < 0 else self._slot(h, d)]


class Memo:
    """A bounded memo of two generations: what is met again outlives what is not."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class BytePairCodec:
    """Encoder and decoder of one rank table; picklable, so that it can be broadcast."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        self.pattern = pattern
        self.tokens = [t for t, _ in pairs]
        self.ranks = [r for _, r in pairs]
        self.hash = PerfectHash(self.tokens)
        self.by_rank = dict(zip(self.ranks, self.tokens))
        self._ready()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self._split = regex.compile(self.pattern)
        self._bytes = [self.rank(bytes([b])) for b in range(256)]
        self._two = [-1] * 65536
        for token, r in zip(self.tokens, self.ranks):
            if len(token) == 2:
                self._two[token[0] << 8 | token[1]] = r
        self._flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        length = np.array([len(t) for t in self.tokens])
        self._length, self._place = np.zeros(max(self.ranks) + 1, np.int64), np.zeros(max(self.ranks) + 1, np.int64)
        self._length[self.ranks], self._place[self.ranks] = length, np.cumsum(length) - length
        self._pieces = Memo(MEMO_PIECES)
        self._pairs = Memo(MEMO_PAIRS)

    def rank(self, word: bytes) -> int:
        """The rank of ``word``, or -1 if it is no token: one probe of the perfect hash."""
        at = self.hash.position(word)
        return self.ranks[at] if self.tokens[at] == word else -1

    def _pair(self, key: int, word: bytes) -> int:
        """The rank of ``word``, which joins the parts whose ids ``key`` packs."""
        found = self._pairs.get(key)
        if found is None:
            found = self.rank(word)
            self._pairs.put(key, found)
        return found

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging: a heap of pairs over linked bytes.

        ``stop[i]`` is where the part that starts at byte i ends, which is where the next one
        starts; 0 marks bytes inside a part.  A heap entry packs rank, start and end of a pair.
        """
        n = len(word)
        bits = n.bit_length()
        low = (1 << bits) - 1
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(map(self._bytes.__getitem__, word))
        get, pair, two = self._pairs.new.get, self._pair, self._two
        heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(word, word[1:])) if (r := two[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end, i = entry & low, entry >> bits & low
            j = stop[i]
            if not j or j >= n or stop[j] != end:  # a part of it has merged since
                continue
            own = ids[i] = entry >> bits >> bits
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
                key = own << 32 | ids[end]
                r = get(key)
                if r is None:
                    r = pair(key, word[i : stop[end]])
                if r >= 0:
                    heappush(heap, (r << bits | i) << bits | stop[end])
            h = before[i]
            if h >= 0:
                key = ids[h] << 32 | own
                r = get(key)
                if r is None:
                    r = pair(key, word[h:end])
                if r >= 0:
                    heappush(heap, (r << bits | h) << bits | end)
        return [k for k, end in zip(ids, stop) if end]

    def _pretoken(self, text: str) -> bytes:
        found = self._pieces.get(text)
        if found is None:
            raw = text.encode("utf-8")
            whole = self.rank(raw)
            found = pack(f"<{len(ids)}i", *ids) if whole < 0 and (ids := self.merge(raw)) else pack("<i", whole)
            if len(text) < 64:
                self._pieces.put(text, found)
        return found

    def _piece(self, text: str) -> bytes:
        parts = self._split.findall(text)
        if len(parts) == 1:  # a pre-token, which the same memo keeps
            return self._pretoken(text)
        found = b"".join(map(self._pretoken, parts))
        if len(text) < 64:
            self._pieces.put(text, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers.

        A single space between other characters always begins a pre-token, so a text in
        which spaces stand so can be cut before each of them.
        """
        if _UNEVEN.search(text) or text[:1] == " " or text[-1:] == " ":
            return b"".join(map(self._pretoken, self._split.findall(text)))
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        new, get = self._pieces.new.get, self._pieces.get
        return b"".join([new(p) or get(p) or self._piece(p) for p in parts])

    def decode(self, ids) -> bytes:
        """The bytes of the ids; an id that no token has raises KeyError."""
        return b"".join(map(self.by_rank.__getitem__, ids))

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where those of each row ids[at[i]:at[i+1]] start; as ``decode``, for many rows."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._length) or (self._length[ids] == 0).any()):
            raise KeyError("an id that no token has")
        length = self._length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat(self._place[ids] - ends[:-1], length) + np.arange(ends[-1])
        return self._flat[place], ends[at]


def list_array(parts: list[bytes]) -> pa.Array:
    """A list<int32> column from the bytes of each row's integers."""
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _ids(codec: BytePairCodec, texts: pa.Array) -> pa.Array:
    return list_array([codec.encode(t) if t else b"" for t in texts.to_pylist()])


def _decoded(codec: BytePairCodec, lists: pa.Array) -> pa.Array:
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[at[0] : at[-1]]
    data, ends = codec.decode_rows(flat, at - at[0])
    out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return out.cast(pa.binary())


def encode(docs: DataFrame, codec: BytePairCodec) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, one row for each row of ``docs``.

    Null texts count as empty and have no ids; a null doc_id stays null; repeated rows
    stay repeated; columns other than ``doc_id`` and ``text`` are ignored.  Marks of special
    tokens are ordinary text.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in _slices(batch):
                yield pa.record_batch([part.column("doc_id"), _ids(own, part.column("text"))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, codec: BytePairCodec) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of its ids; null ids count as none."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in _slices(batch):
                lists = part.column("ids")
                yield pa.record_batch([part.column("doc_id"), lists, _decoded(own, lists)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, codec: BytePairCodec) -> DataFrame:
    """``decode(encode(docs))`` in one pass: a task has one Python worker with the codec's tables and memo in place of two."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in _slices(batch):
                lists = _ids(own, part.column("text"))
                yield pa.record_batch([part.column("doc_id"), lists, _decoded(own, lists)], ["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
