"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of a whole document says nothing
about one item.  Items are partitioned by the size of their shingle sets, class c holding
the sizes above ``unit * 2**(c-1)`` and up to ``unit * 2**c``; the unit is the power of two
at or above the least size, ``MOST_UNIT`` at most.  For each class, a document is
covered by windows of twice the class's largest size that step by that size, so each run
of shingles as long as an item lies in a window whole.  In such a window the containment
asked for becomes a Jaccard bound that depends on the class alone, and the number of
hashes follows from it and the recall asked for.  The minima of windows are minima of the
unit blocks beneath them, so all classes share one pass over the shingles.  Whole documents
are one more window.

A candidate is verified by exact containment: the strings of the item's shingles are looked
up among those of the document.

Items are written to the shared folder in blocks of about half ``BLOCK_BYTES`` of text, which tasks read one after another,
so nothing is broadcast, documents are read once, and the plan is the same whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, shingle_strings, shingles, utf8_parts, words
from .files import open_input
from .shared import materialise, small_batches, without_ids

NGRAM = 5
CONTAINMENT = 0.8
RECALL = 0.9999
MOST_UNIT = 16
BLOCK_BYTES = 8 << 20
_FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def hashes_needed(containment: float, recall: float) -> int:
    """Hashes for which a window shows an item of its class with probability ``recall``.

    The worst item has just over half the class's largest size U and just that containment
    c in a window of 2U shingles: its Jaccard similarity is (c/2) / (2 + 1/2 - c/2).
    """
    jaccard = (containment / 2) / (2.5 - containment / 2)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - jaccard)))


def _hash_text(text: str, n: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    _, _, row, hashes = words(data, np.array([0, len(data)]))
    return np.unique(shingles(hashes, row, 1, n)[0])


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    scale = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return scale, rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def _index(items: list[tuple[int, str]], n: int, count: int) -> tuple[int, dict]:
    """The unit, and signatures of the items by size class: for each hash, sorted minima and the items they are of."""
    scale, shift = _permutations(count)
    hashed = [_hash_text(text, n) for _, text in items]
    unit = 1 << int(np.ceil(np.log2(min([MOST_UNIT, *(len(x) for x in hashed if len(x))]))))
    by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, x in enumerate(hashed):
        if len(x):
            by_class.setdefault(max(0, int(np.ceil(np.log2(len(x) / unit)))), []).append((k, x))
    out = {}
    for c, members in by_class.items():
        minima = np.stack([((x >> np.uint64(32)).astype(np.uint32)[None, :] * scale[:, None] + shift[:, None]).min(1) for _, x in members], 1)
        order = np.argsort(minima, axis=1, kind="stable")
        out[c] = (np.take_along_axis(minima, order, 1), np.array([k for k, _ in members])[order])
    return unit, out


def _searcher(items: list[tuple[int, str]], n: int, containment: float, count: int):
    unit, index = _index(items, n, count)
    ids = [i for i, _ in items]
    grams = {k: shingle_strings(text, n) for k, (_, text) in enumerate(items)}
    top = max(index, default=0)

    def candidates(x: np.ndarray, start: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) whose windows share a minimum."""
        scale, shift = _permutations(count)
        n_rows = len(start) - 1
        size = np.diff(start)
        n_blocks = -(-size // unit)
        first_block = np.concatenate(([0], np.cumsum(n_blocks)))
        owner = np.repeat(np.arange(n_rows), n_blocks)
        heads = np.repeat(start[:-1], n_blocks) + (np.arange(first_block[-1]) - first_block[:-1][owner]) * unit
        if not len(heads):
            return set()
        short = (x >> np.uint64(32)).astype(np.uint32)
        full = np.flatnonzero(n_blocks)
        found: set[tuple[int, int]] = set()
        for j in range(count):
            level = np.minimum.reduceat(short * scale[j] + shift[j], heads)
            whole = np.minimum.reduceat(level, first_block[full])
            bounds, owners = first_block, owner
            for c in range(top + 1):
                if c:  # two blocks of the level below make one
                    halves = -(-np.diff(bounds) // 2)
                    upper = np.concatenate(([0], np.cumsum(halves)))
                    own = np.repeat(np.arange(n_rows), halves)
                    at = bounds[:-1][own] + 2 * (np.arange(upper[-1]) - upper[:-1][own])
                    level = np.minimum.reduceat(level, at)
                    bounds, owners = upper, own
                if c not in index:
                    continue
                window = level.copy()
                same = owners[1:] == owners[:-1]
                window[:-1][same] = np.minimum(level[:-1][same], level[1:][same])
                minima, of = index[c][0][j], index[c][1][j]
                for values, rows in ((window, owners), (whole, full)):
                    at = np.searchsorted(minima, values)
                    hit = np.flatnonzero(minima[np.minimum(at, len(minima) - 1)] == values)
                    for h in hit:
                        k = at[h]
                        while k < len(minima) and minima[k] == values[h]:
                            found.add((int(rows[h]), int(of[k])))
                            k += 1
        return found

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = utf8_parts(batch.column("text"))
        for first, last in chunks(at):
            own = at[first : last + 1] - at[first]
            piece = data[at[first] : at[last]]
            _, _, row, hashes = words(piece, own)
            x, start = shingles(hashes, row, last - first, n)
            rows = []
            by_row: dict[int, list[int]] = {}
            for i, k in candidates(x, start):
                by_row.setdefault(i, []).append(k)
            for i in sorted(by_row):
                mine = shingle_strings(piece[own[i] : own[i + 1]].tobytes().decode("utf-8"), n)
                for k in sorted(by_row[i]):
                    shared = len(grams[k] & mine)
                    if shared >= containment * len(grams[k]) - 1e-9:
                        rows.append((batch.column("doc_id")[first + i].as_py(), ids[k], shared, len(grams[k])))
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_shared", "n_item"])

    return search


def _in_blocks(paths: list[str], n: int, containment: float, count: int):
    """Documents in; their items out.  Batches gathered to ``BLOCK_BYTES`` meet the blocks of items one after another; a single block is indexed once."""

    def searcher(path: str):
        with open_input(path) as f:
            table = pq.read_table(f, columns=["item_id", "text"])
        return _searcher(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist())), n, containment, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(paths) == 1:
            search = searcher(paths[0])
            for batch in batches:
                yield from search(batch)
            return
        held, size = [], 0

        def all_blocks() -> Iterator[pa.RecordBatch]:
            for path in paths:
                search = searcher(path)
                for batch in held:
                    yield from search(batch)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from all_blocks()
                held, size = [], 0
        yield from all_blocks()

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: items of which a document holds ``containment`` of the shingles or more.

    A document may hold them anywhere; those that stand within about twice the item's length,
    as a passage does, and those of documents not much longer than the item are found with
    probability ``recall`` each.  Null texts count as empty; a text without words holds nothing and an item
    without words is in nothing.  An item of fewer than ``n`` words is its own only shingle, as in the SQL form, so
    a text of ``n`` words or more never holds it; only a text of the same words does.  Rows without an id are left out, repeated rows count once,
    and other columns are ignored.  An empty table on either side gives no rows.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).where("item_id is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = materialise(items.repartition(max(1, -(-total // (BLOCK_BYTES // 2)))), "items")
    paths = sorted(r[0] for r in blocks.select(F.input_file_name()).distinct().collect())  # one for each block
    if not paths:
        return docs.sparkSession.createDataFrame([], _FOUND)
    out = source.mapInArrow(_in_blocks(paths, n, containment, hashes_needed(containment, recall)), _FOUND)
    # A document and an item may each have several rows.
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows without doc_id stay."""
    return without_ids(docs, contained_items(docs, benchmark, **options).select("doc_id").distinct())
