"""Chroma audio fingerprints: packed integers of a recording, and alignment by offset histograms.

A recording is 8-bit unsigned PCM of ``RATE`` samples a second.  Overlapping frames are windowed and
transformed; the power of each spectral bin goes to the pitch class of its frequency, and twelve
classes, smoothed over time and scaled to unit length, make a frame of the chroma image.  Sixteen box
filters slide over that image, each a contrast of sums that an integral image gives in four look-ups;
each answer is quantised to two bits in Gray code, and sixteen answers pack into one 32-bit code
for each frame.

Two recordings align where many of their codes are equal at one offset.  Of a query's codes, those with one or two of
the ``WEAK_BITS`` weakest bits turned, whose answers lay nearest to a threshold, are looked up too.  Offsets with ``LEAST_VOTES`` or more in the
histogram are tried by falling votes until one aligns, and the share of differing bits decides how long a stretch agrees there.
A stretch with fewer such code changes is not found.  Recordings with equal fingerprints are one class, named by its least doc_id,
and only classes are compared.

Queries are written to the shared folder in blocks of about ``BLOCK_BYTES``; each batch of recordings is read once and
compared with one block after another, so the plan doesn't grow with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks
from .files import open_input
from .shared import materialise, small_batches

#: A frame parts semitones from ``LOWEST`` on: two of its bins, the width of the window's main lobe from its middle, lie between them.
RATE, FRAME, HOP = 4000, 512, 32
WIDTH = 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
LOWEST, HIGHEST = 440 * 2 ** (-9 / 12), 1900.0
LEAST_VOTES = 1
LEAST_OVERLAP = 8
MOST_ERRORS = 0.08
WEAK_BITS = 4
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 16 << 20


def pitch_classes() -> np.ndarray:
    """Matrix from spectral bins to the twelve pitch classes."""
    frequency = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(frequency), 12), np.float32)
    heard = np.flatnonzero((frequency >= LOWEST) & (frequency <= HIGHEST))
    out[heard, np.round(12 * np.log2(frequency[heard] / 440)).astype(int) % 12] = 1
    return out


def _areas(kind: int, y: int, height: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """Signed boxes (sign, first frame, last frame, first class, last class) of one filter."""
    h2, w2, h3, w3 = height // 2, width // 2, height // 3, width // 3
    top, whole = y + height, (0, width)
    if kind == 0:
        return [(1, *whole, y, top)]
    if kind == 1:
        return [(1, *whole, y + h2, top), (-1, *whole, y, y + h2)]
    if kind == 2:
        return [(1, w2, width, y, top), (-1, 0, w2, y, top)]
    if kind == 3:
        return [(1, 0, w2, y + h2, top), (1, w2, width, y, y + h2), (-1, 0, w2, y, y + h2), (-1, w2, width, y + h2, top)]
    if kind == 4:
        return [(1, *whole, y + h3, top - h3), (-1, *whole, y, y + h3), (-1, *whole, top - h3, top)]
    return [(1, w3, width - w3, y, top), (-1, 0, w3, y, top), (-1, width - w3, width, y, top)]


#: Kinds, places and sizes of the filters by rule: all kinds, each on several bands and time spans.
FILTERS = [_areas(i % 6, (i * 7) % (12 - (3 + i * 5 % 9) + 1), 3 + i * 5 % 9, (4, 8, 12, 16)[i % 4]) for i in range(16)]
_CLASSES = pitch_classes()
_WINDOW = np.hanning(FRAME).astype(np.float32)
LEAST_SAMPLES = FRAME + HOP * (WIDTH + len(SMOOTH) - 2)


def _answers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes x 16 filter answers, number of codes of each recording data[at[i]:at[i+1]])."""
    size = np.diff(at)
    frames = np.where(size >= FRAME, (size - FRAME) // HOP + 1, 0)
    n_codes = np.maximum(frames - (WIDTH - 1) - (len(SMOOTH) - 1), 0)
    frames = np.where(n_codes > 0, frames, 0)
    first = np.concatenate(([0], np.cumsum(frames)))
    if not first[-1]:
        return np.zeros((0, 16)), n_codes
    start = np.repeat(at[:-1] - HOP * first[:-1], frames) + HOP * np.arange(first[-1])
    windows = np.lib.stride_tricks.sliding_window_view(data, FRAME)
    chroma = np.empty((first[-1] + len(SMOOTH) + WIDTH, 12), np.float32)
    chroma[first[-1] :] = 0
    for k in range(0, first[-1], 4096):
        spectrum = np.fft.rfft((windows[start[k : k + 4096]].astype(np.float32) - 128) * _WINDOW, axis=1)
        chroma[k : min(k + 4096, first[-1])] = (spectrum.real**2 + spectrum.imag**2) @ _CLASSES
    n = len(chroma) - len(SMOOTH) + 1
    smooth = sum(c * chroma[j : j + n] for j, c in enumerate(SMOOTH))
    norm = np.sqrt((smooth * smooth).sum(1, keepdims=True))
    smooth = np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-3), 0)
    image = np.zeros((n + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(smooth, 0, np.float64), 1)
    t = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n_codes)))[:-1], n_codes) + np.arange(n_codes.sum())
    out = np.empty((len(t), 16))
    for f, boxes in enumerate(FILTERS):
        side = {1: 1.0, -1: 1.0}
        for sign, a, b, y, z in boxes:
            side[sign] = side[sign] + image[t + b, z] - image[t + a, z] - image[t + b, y] + image[t + a, y]
        out[:, f] = np.log(side[1]) - np.log(side[-1])
    return out, n_codes


def _levels() -> np.ndarray:
    """Quartiles of each filter's answers to white noise: the three thresholds between its four levels."""
    noise = np.random.default_rng(5).integers(0, 256, 1 << 18, dtype=np.uint8)
    return np.quantile(_answers(noise, np.array([0, len(noise)]))[0], (0.25, 0.5, 0.75), axis=0)


_cached: list[np.ndarray] = []


def fingerprints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes, the places of the weakest bits of each, and the number of codes of each recording."""
    if not _cached:
        _cached.append(_levels())
    levels = _cached[0]
    answers, n_codes = _answers(data, at)
    level = (answers[:, None, :] > levels[None]).sum(1)
    gray = (level ^ level >> 1).astype(np.uint32)
    codes = np.zeros(len(level), np.uint32)
    for f in range(16):
        codes |= gray[:, f] << np.uint32(2 * f)
    # The bit that a Gray code changes at the middle threshold is its upper one, at the others its lower one.
    distance = np.abs(answers[:, None, :] - levels[None]) / (levels[2] - levels[0])
    nearest = distance.argmin(1)
    weakest = np.argsort(distance.min(1), axis=1, kind="stable")[:, :WEAK_BITS]
    weak = (2 * weakest + (np.take_along_axis(nearest, weakest, 1) == 1)).astype(np.uint8)
    return codes, weak, n_codes


_TURNED = [(), *combinations(range(WEAK_BITS), 1), *combinations(range(WEAK_BITS), 2)]


def probes(codes: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Each code, and what it is with one or two of its weakest bits turned."""
    bit = np.uint32(1) << weak.astype(np.uint32)
    out = np.repeat(codes[:, None], len(_TURNED), 1)
    for k, turned in enumerate(_TURNED):
        for j in turned:
            out[:, k] ^= bit[:, j]
    return out


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where the codes change: a held sound counts once in a histogram."""
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)


def aligned(a: np.ndarray, b: np.ndarray, offset: int, least: int = LEAST_OVERLAP, most: float = MOST_ERRORS) -> tuple[int, int, int]:
    """The longest segment that agrees if code i of ``a`` stands beside code i - offset of ``b``.

    (first code in ``a``, length, differing bits) of the longest stretch of which every ``least`` consecutive codes
    differ in at most the share ``most`` of their bits; the first of equals, and length 0 if there is none.
    """
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high - low < least:
        return low, 0, 0
    errors = np.concatenate(([0], np.cumsum(np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]), dtype=np.int64)))
    good = np.concatenate(([False], errors[least:] - errors[:-least] <= most * 32 * least, [False]))
    edge = np.flatnonzero(good[1:] != good[:-1])
    if not len(edge):
        return low, 0, 0
    first, last = edge[::2], edge[1::2]
    k = int(np.argmax(last - first))
    first, stop = int(first[k]), int(last[k]) - 1 + least
    return low + first, stop - first, int(errors[stop] - errors[first])


class Block:
    """Queries (id, codes, weakest bits), with an index of their probes."""

    def __init__(self, queries: list[tuple[int, bytes, bytes]]):
        self.ids = [q for q, _, _ in queries]
        self.codes = [np.frombuffer(c, np.uint32) for _, c, _ in queries]
        at = [_runs(c) for c in self.codes]
        found = [probes(c[p], np.frombuffer(w, np.uint8).reshape(-1, WEAK_BITS)[p]) for c, p, (_, _, w) in zip(self.codes, at, queries)]
        code = np.concatenate([x.reshape(-1) for x in found]) if found else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(self.ids)), [len(_TURNED) * len(p) for p in at])
        place = np.repeat(np.concatenate(at), len(_TURNED)) if at else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], owner[order], place[order]

    def matches(self, own_id: int, mine: np.ndarray) -> list[dict]:
        """The queries that align with a recording."""
        starts = _runs(mine)
        low, high = np.searchsorted(self.code, mine[starts]), np.searchsorted(self.code, mine[starts], "right")
        n = high - low
        if not n.sum():
            return []
        hit = np.repeat(low - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        offset = self.place[hit] - np.repeat(starts, n)
        pair, votes = np.unique(self.owner[hit] * (1 << 40) + (offset + (1 << 39)), return_counts=True)
        enough = votes >= LEAST_VOTES
        pair, votes = pair[enough], votes[enough]
        order = np.lexsort((pair, -votes, pair >> 40))
        out, last = [], -1
        for p in pair[order].tolist():
            q = p >> 40
            if q == last or self.ids[q] == own_id:
                continue
            shift = (p & (1 << 40) - 1) - (1 << 39)
            start, overlap, errors = aligned(self.codes[q], mine, shift)
            if overlap:
                last = q
                out.append({"query_id": self.ids[q], "offset": shift, "start": start, "overlap": overlap, "bit_errors": errors})
        return out


def _searcher(paths: list[str]):
    """Recordings (class_id, codes) in, those with matches among the queries of the files out."""
    item = pa.struct([("query_id", pa.int64()), ("offset", pa.int32()), ("start", pa.int32()), ("overlap", pa.int32()), ("bit_errors", pa.int64())])

    def searched(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        found = [[] for _ in rows]
        for path in paths:
            with open_input(path) as f:
                table = pq.read_table(f, columns=["class_id", "codes", "weak"])
            for part in table.to_batches(max_chunksize=256):
                block = Block(list(zip(*(part.column(c).to_pylist() for c in ("class_id", "codes", "weak")))))
                for own, (class_id, codes) in zip(found, rows):
                    own += block.matches(class_id, codes)
        keep = [k for k, f in enumerate(found) if f]
        return pa.record_batch([pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([found[k] for k in keep], pa.list_(item))], ["class_id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for class_id, codes in zip(batch.column("class_id").to_pylist(), batch.column("codes").to_pylist()):
                rows.append((class_id, np.frombuffer(codes, np.uint32)))
                size += len(codes)
                if size >= BATCH_BYTES:
                    yield searched(rows)
                    rows, size = [], 0
        if rows:
            yield searched(rows)

    return run


_MATCH = "array<struct<query_id:long,offset:int,start:int,overlap:int,bit_errors:long>>"


def fingerprint(recordings: DataFrame) -> DataFrame:
    """``doc_id, codes, weak``: the codes of the PCM bytes in column ``pcm``, as little-endian unsigned 32-bit integers, and the
    places of the weakest bits of each, as bytes.

    Null recordings, and those of under ``LEAST_SAMPLES`` samples, have no codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("pcm").fill_null(b"")
            _, offsets, raw = column.buffers()
            wide = pa.types.is_large_binary(column.type)
            at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            for first, last in chunks(at):
                codes, weak, n = fingerprints(data[at[first] : at[last]], at[first : last + 1] - at[first])
                cut = np.concatenate(([0], np.cumsum(n)))
                both = zip(cut[:-1], cut[1:])
                packed = [(codes[a:b].tobytes(), weak[a:b].tobytes()) for a, b in both]
                yield pa.record_batch([batch.column("doc_id").slice(first, last - first), *(pa.array(x, pa.binary()) for x in zip(*packed))], ["doc_id", "codes", "weak"])

    small_batches(recordings.sparkSession)
    return recordings.select("doc_id", "pcm").mapInArrow(run, "doc_id long, codes binary, weak binary")


def align(recordings: DataFrame, is_query) -> DataFrame:
    """``doc_id, class_id, n_codes, codes, matches`` of every recording; those of ``is_query`` are searched for among all.

    ``class_id`` is the least doc_id with equal codes.  ``matches`` stands on the row of that document and lists the
    query classes whose recordings align with it: ``query_id`` (the class), ``offset`` (code i of the query is beside
    code i - offset), ``start``, ``overlap`` and ``bit_errors`` of the longest stretch that agrees at the offset of most votes that has one; the class itself is not
    listed.  A recording without codes is
    alone in its class and aligns with none.  Rows without doc_id are left out, other columns are ignored; rows that share a doc_id are each
    returned.  Of equally tall peaks the least query and offset is tried first.  Silence and other held sounds have one code change and align with nothing.
    """
    marked = recordings.where("doc_id is not null")
    prints = materialise(fingerprint(marked), "fingerprints")
    full = prints.where(F.octet_length("codes") > 0)
    classes = full.groupBy("codes").agg(F.min(F.struct("doc_id", "weak")).alias("least"), F.max(is_query).alias("asked"))
    classes = materialise(classes.select("codes", F.col("least.doc_id").alias("class_id"), F.col("least.weak").alias("weak"), "asked"), "recordings")
    asked = classes.where("asked")
    total = asked.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    blocks = materialise(asked.select("class_id", "codes", "weak").repartition(max(1, -(-total // BLOCK_BYTES))), "queries")
    paths = sorted(r[0] for r in blocks.select(F.input_file_name()).distinct().collect())  # one for each block
    found = classes.select("class_id", "codes").mapInArrow(_searcher(paths), f"class_id long, found {_MATCH}")
    found = found.withColumnRenamed("class_id", "doc_id")
    with_codes = full.drop("weak").join(classes.select("codes", "class_id"), "codes").join(found, "doc_id", "left")
    nothing = F.expr(f"cast(array() as {_MATCH})")
    matches = F.when(F.col("doc_id") == F.col("class_id"), F.coalesce(F.array_sort("found"), nothing)).otherwise(nothing)
    n_codes = (F.octet_length("codes") / 4).cast("long").alias("n_codes")
    without = prints.where(F.octet_length("codes") == 0).select("doc_id", F.col("doc_id").alias("class_id"), n_codes, "codes", nothing.alias("matches"))
    return with_codes.select("doc_id", "class_id", n_codes, "codes", matches.alias("matches")).unionByName(without)
