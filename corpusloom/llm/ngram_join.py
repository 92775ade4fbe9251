"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Plan
1. One pass hashes each text's words into shingles and takes its band hashes and a
   128-bit key of its word sequence.  Equal keys are one *node*, named by its least
   doc_id; a partially aggregated minimum finds it, so a third of all rows being
   copies of one text costs no more than other rows.
2. Nodes meet in the buckets (band, hash).  Each bucket links its members to its least
   member, a star, never all pairs.  Components of these links bound where pairs of
   0.8 or more can be.
3. The texts of components with two nodes or more are shingled again and packed in
   blocks of at most ``BLOCK_NODES`` nodes and about ``BLOCK_WORDS`` words.  Blocks of a component with
   several are files of the shared folder, and a task reads one of them and, in turn, up to ``STRIP`` others that it is compared with;
   what is shuffled are their paths.  Pairs within a block are verified where it is packed.  Two blocks are compared by a matrix
   product that counts all shared shingles, so every pair inside a component is verified on its full shingle sets and
   none is ever a row: a task returns each node's number of links and a spanning
   forest of them.
4. Components of the forests are the classes.

Bands and rows come from ``choose_bands``: the fewest hashes that reach the recall asked
for at the threshold.  Recall above the threshold is higher, and nodes that miss each
other in every band still meet if a third text joins them in one component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, mix, powers, shingles, utf8_parts, words
from .files import make_folder, open_output, read_all
from .graph import connected_components
from .shared import join_unique, materialise, shared_path, small_batches, without_ids

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
BLOCK_NODES = 512
BLOCK_WORDS = 1_500_000
STRIP = 16
_COLUMNS = 8192
RANGE_VALUES = 400_000


def choose_bands(threshold: float, recall: float, most_rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the most selective banding with ``1 - (1 - t**rows)**bands >= recall``.

    ``most_rows`` bounds the number of hashes; more rows pass fewer dissimilar pairs
    but need many more bands for the same recall.
    """
    rows = most_rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    scale = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, _ = powers(4096)
        for batch in batches:
            data, at = utf8_parts(batch.column("text"))
            ids = batch.column("doc_id")
            for first, last in chunks(at):
                own = at[first : last + 1] - at[first]
                _, _, row, hashes = words(data[at[first] : at[last]], own)
                x, start = shingles(hashes, row, last - first, n)
                full = np.flatnonzero(np.diff(start))
                n_rows = last - first
                keys = np.zeros((2, n_rows), np.uint64)
                band = np.zeros((n_rows, bands), np.uint64)
                if len(full):
                    heads = start[full]
                    local = np.arange(len(x)) - np.repeat(start[:-1], np.diff(start))
                    weight, _ = powers(int(local.max()) + 2)
                    for k in range(2):
                        keys[k, full] = mix(np.add.reduceat(mix(x ^ np.uint64(k * 977 + 1)) * weight[local + 1], heads))
                    short = (x >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        together = np.zeros(len(full), np.uint64)
                        for r in range(rows):
                            j = b * rows + r
                            least = np.minimum.reduceat(short * scale[j] + shift[j], heads)
                            together = together * up[3] + mix(least.astype(np.uint64) + np.uint64(j))
                        band[full, b] = mix(together)
                count = np.bincount(row, minlength=n_rows)
                flat = pa.array(band.reshape(-1).view(np.int64))
                yield pa.record_batch(
                    [
                        ids.slice(first, n_rows),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1, dtype=np.int32) * bands), flat),
                    ],
                    ["doc_id", "k1", "k2", "n_words", "bands"],
                )

    return sign


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8_parts(batch.column("text"))
            for first, last in chunks(at):
                own = at[first : last + 1] - at[first]
                _, _, row, hashes = words(data[at[first] : at[last]], own)
                x, start = shingles(hashes, row, last - first, n)
                packed = [np.unique(x[start[i] : start[i + 1]]).tobytes() for i in range(last - first)]
                keep = [batch.column(c).slice(first, last - first) for c in ("root", "block", "blocks", "node")]
                yield pa.record_batch([*keep, pa.array(packed, pa.binary())], ["root", "block", "blocks", "node", "grams"])

    return run


def _united(nodes: np.ndarray, grams: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One set for each node; the rows of a repeated node are united."""
    sets: dict[int, np.ndarray] = {}
    for node, raw in zip(nodes.tolist(), grams):
        own = np.frombuffer(raw, np.uint64)
        sets[node] = np.union1d(sets[node], own) if node in sets else own
    order = sorted(sets)
    return np.array(order, np.int64), [sets[k] for k in order]


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of values that the sets of two lists share."""
    size_l, size_r = [len(x) for x in left], [len(x) for x in right]
    value, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(size_l)
    row_l, row_r = np.repeat(np.arange(len(left)), size_l), np.repeat(np.arange(len(right)), size_r)
    in_both = (np.bincount(column[:split], minlength=len(value)) > 0) & (np.bincount(column[split:], minlength=len(value)) > 0)
    dense = np.cumsum(in_both) - 1
    shared = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for rows_, cols in ((row_l, column[:split]), (row_r, column[split:])):
        keep = in_both[cols]
        cols = dense[cols[keep]]
        order = np.argsort(cols, kind="stable")
        sides.append((rows_[keep][order], cols[order]))
    for low in range(0, int(in_both.sum()), _COLUMNS):
        parts = []
        for (rows_, cols), n_side in zip(sides, (len(left), len(right))):
            a, b = np.searchsorted(cols, (low, low + _COLUMNS))
            table = np.zeros((n_side, _COLUMNS), np.float32)
            table[rows_[a:b], cols[a:b] - low] = 1
            parts.append(table)
        shared += parts[0] @ parts[1].T
    return shared


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sorted sets whose Jaccard similarity is at least ``threshold``.

    Shared values are counted over ranges of hashes that hold about ``RANGE_VALUES`` each, so that memory is bounded for texts of any length.
    """
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    n = int(size_l.sum() + size_r.sum()) // RANGE_VALUES + 1
    edges = np.array([k * 2**64 // n for k in range(1, n)], np.uint64)
    cuts_l, cuts_r = ([[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in side] for side in (left, right))
    shared = np.zeros((len(left), len(right)), np.float32)
    for k in range(n):
        shared += _shared([x[c[k] : c[k + 1]] for x, c in zip(left, cuts_l)], [x[c[k] : c[k + 1]] for x, c in zip(right, cuts_r)])
    total = size_l[:, None] + size_r[None, :] - shared
    return shared >= threshold * total - 1e-6


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i]), given as positions in ``nodes``."""
    parent = np.arange(len(nodes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    label = parent.copy()
    while len(a):
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        if not len(a):
            break
        _, firsts = np.unique(a, return_index=True)
        for i in firsts:
            x, y = find(a[i]), find(b[i])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(nodes[a[i]]), int(nodes[b[i]])))
        label = np.array([find(i) for i in range(len(nodes))])
    return out


_FOUND = "node long, links long, other long"


def _verified(left: tuple, right: tuple | None, threshold: float) -> list[tuple]:
    """(node, links, None) for each node with links, and (node, 0, other) for each link of the forest."""
    nodes, sets = left
    if right is None:
        hit = _links(sets, sets, threshold)
        np.fill_diagonal(hit, False)
        links = {int(k): int(c) for k, c in zip(nodes, hit.sum(1)) if c}
        a, b = np.nonzero(np.triu(hit))
        forest = _forest(nodes, a, b)
    else:
        nodes_r, sets_r = right
        hit = _links(sets, sets_r, threshold)
        links = {int(k): int(c) for k, c in zip(nodes, hit.sum(1)) if c} | {int(k): int(c) for k, c in zip(nodes_r, hit.sum(0)) if c}
        a, b = np.nonzero(hit)
        forest = _forest(np.concatenate([nodes, nodes_r]), a, b + len(nodes))
    return [(k, c, None) for k, c in links.items()] + [(a, 0, b) for a, b in forest]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "links", "other"])


_PACKED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("root", pa.int64()), ("block", pa.int32()), ("path", pa.string())])


def _pack(folder: str, threshold: float):
    """Rows sorted by (root, block) in; the links inside each block out, and a row with the path of its file for each block of a component with several."""

    def packed(key: tuple, rows: list) -> pa.RecordBatch:
        root, block, blocks = key
        nodes, sets = _united(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows])
        out = [(*found, None, None, None) for found in _verified((nodes, sets), None, threshold)]
        if blocks > 1:
            path = f"{folder}/{root}-{block}-{uuid.uuid4().hex}"
            sizes = np.array([len(s) for s in sets], np.int64)
            with open_output(path) as file:
                for part in (len(nodes).to_bytes(8, "little"), nodes.tobytes(), sizes.tobytes(), *(x.tobytes() for x in sets)):
                    file.write(part)
            out.append((None, None, None, root, block, path))
        return pa.record_batch([pa.array([r[k] for r in out], field.type) for k, field in enumerate(_PACKED)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for *at, node, grams in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "blocks", "node", "grams"))):
                if tuple(at) != key:
                    if rows:
                        yield packed(key, rows)
                    key, rows = tuple(at), []
                rows.append((node, grams))
        if rows:
            yield packed(key, rows)

    return run


def _unpack(nodes: bytes, sizes: bytes, grams: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.frombuffer(nodes, np.int64), np.split(np.frombuffer(grams, np.uint64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])


def _read_block(path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = read_all(path)
    n = int.from_bytes(raw[:8], "little")
    return _unpack(raw[8 : 8 + 8 * n], raw[8 + 8 * n : 8 + 16 * n], raw[8 + 16 * n :])


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes of texts joined by links of Jaccard similarity ``threshold`` or more.

    Returns ``doc_id, class_id, n_links, n_copies, n_words``: the least doc_id of the class, the number
    of other different word sequences that this text links with, the number of documents
    with its very word sequence, itself included, and its number of words.

    Null texts count as empty.  A text without words is alone in its class, with no links
    and one copy.  Rows without doc_id have no identity and are left out; rows that share
    a doc_id are one document, whose shingles are those of all its rows.  Columns other than
    ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).where("doc_id is not null")
    signed = materialise(
        source.mapInArrow(_signer(n, bands, rows), "doc_id long, k1 long, k2 long, n_words long, bands array<long>"),
        "signatures",
    )
    texts = signed.where("n_words > 0")
    node_of = texts.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands")).alias("least"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"))
    nodes = materialise(node_of.select("k1", "k2", F.col("least.doc_id").alias("node"), "n_copies", "n_words", F.col("least.bands").alias("bands")), "nodes")

    members = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.min("node").alias("a"), F.max("node").alias("most"), F.count("*").alias("n_rows")).where("a < most").select("band", "hash", "a", "n_rows")
    stars = join_unique(members, buckets, ["band", "hash"], bands * nodes.count()).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    near = connected_components(stars)

    sized = near.join(nodes.groupBy("node").agg(F.max("n_words").alias("n_words")), "node")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    placed = near.join(blocks, "root").select("node", "root", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"))
    wanted = source.join(placed, F.col("doc_id") == F.col("node")).select("root", "block", "blocks", "node", "text")
    grams = wanted.mapInArrow(_shingle_sets(n), "root long, block int, blocks int, node long, grams binary")

    folder = shared_path(docs.sparkSession, "gram-files")
    make_folder(folder)
    packed = materialise(
        grams.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(_pack(folder, threshold), "node long, links long, other long, root long, block int, path string"),
        "links-inside",
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, others in zip(batch.column("path").to_pylist(), batch.column("others").to_pylist()):
                own = _read_block(path)
                for other in others:
                    yield _as_batch(_verified(own, _read_block(other), threshold))

    # A block's file is small, so the row of a component's block is its path; a component of b blocks has b (b - 1) / 2 pairs of them.
    several = packed.where("path is not null").select("root", "block", "path")
    others = several.select("root", F.col("block").alias("j"), F.col("path").alias("other"))
    strips = several.join(others, "root").where("block < j").groupBy("path", F.floor(F.col("j") / STRIP).alias("strip")).agg(F.collect_list("other").alias("others"))
    across = materialise(strips.select("path", "others").mapInArrow(pairs, _FOUND), "links-across")
    found = packed.where("path is null").select("node", "links", "other").unionByName(across)

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    by_node = (
        nodes.select("k1", "k2", "node", "n_copies")
        .join(links, "node", "left")
        .join(classes.withColumnRenamed("root", "class"), "node", "left")
        .select("k1", "k2", "n_copies", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    with_words = texts.select("doc_id", "k1", "k2", "n_words").join(by_node, ["k1", "k2"]).select("doc_id", F.col("class").alias("class_id"), "n_links", "n_copies", "n_words")
    without = signed.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "n_words")
    return with_words.unionByName(without).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("n_copies").alias("n_copies"), F.max("n_words").alias("n_words"))


def keep_one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its class, with all its columns.

    Rows without doc_id stay: nothing links them to others.
    """
    classes = ngram_jaccard_join(docs, **options)
    return without_ids(docs, classes.where("class_id <> doc_id").select("doc_id"))
