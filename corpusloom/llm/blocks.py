"""Word and shingle hashing over Arrow string buffers, vectorised with numpy.

A *word* is a maximal run of ASCII letters and digits and of characters beyond
ASCII, without the general punctuation, Latin-1 punctuation and ideographic space
blocks.  Callers lower-case the text first (``F.lower``, in the JVM).  A *shingle*
is ``n`` consecutive words; a text with fewer words, but at least one, has its
whole word sequence as its only shingle, and a text without words has none.

Texts are processed in chunks of about a megabyte, so memory does not follow the
size of an Arrow batch; one text is never cut, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, np.bool_)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _WORD[_low : _high + 1] = True
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = base**s times the polynomial hash of data[s:e]."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return total


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    lead = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF
    if len(lead):
        lead = lead[lead + 1 < len(data)]
        mask[lead] = mask[lead + 1] = False
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        lead = np.flatnonzero(data == first)
        lead = lead[lead + 2 < len(data)]
        if len(lead):
            ok = np.isin(data[lead + 1], seconds)
            if first == 0xE3:
                ok &= data[lead + 2] < 0x84
            lead = lead[ok]
            mask[lead] = mask[lead + 1] = mask[lead + 2] = False
    return mask


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of each word of the texts data[at[i]:at[i+1]]; at[0] is 0."""
    mask = word_mask(data)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[: len(data)] = mask
    before = np.zeros(len(data) + 1, np.bool_)
    before[1:] = mask
    before[at[:-1]] = False  # a word never crosses texts
    starts = np.flatnonzero(edge.astype(np.bool_) & ~before)
    after = np.zeros(len(data) + 1, np.bool_)
    after[: len(data)] = mask
    after[at[1:]] = False
    ends = np.flatnonzero(~after[1:] & mask) + 1
    total = prefix_hash(data)
    _, down = powers(len(data) + 1)
    hashes = mix((total[ends] - total[starts]) * down[starts])
    row = np.searchsorted(at, starts, "right") - 1
    return starts, ends, row, hashes


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and, for each row, where its shingles start (n_rows + 1 offsets)."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))
    out_count = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(out_count)))
    up, _ = powers(n + 1)
    full = len(hashes) - n + 1
    out = np.zeros(out_first[-1], np.uint64)
    if full > 0:
        rolled = hashes[:full] * up[1]
        for j in range(1, n):
            rolled = rolled + hashes[j : j + full] * up[j + 1]
        out_pos = np.repeat(first[:-1] - out_first[:-1], out_count) + np.arange(out_first[-1])
        long = np.repeat(count >= n, out_count)
        out[long] = rolled[out_pos[long]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = hashes[first[i] : first[i + 1]]
        out[out_first[i]] = (own * up[1 : len(own) + 1]).sum(dtype=np.uint64) ^ np.uint64(len(own))
    return mix(out), out_first


def word_strings(text: str) -> list[str]:
    """The words of one lower-cased text, by the rule above; for exact checks of few candidates."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts, ends, _, _ = words(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends)]


def shingle_strings(text: str, n: int = 5) -> set[str]:
    found = word_strings(text)
    if not found:
        return set()
    if len(found) < n:
        return {" ".join(found)}
    return {" ".join(found[i : i + n]) for i in range(len(found) - n + 1)}
