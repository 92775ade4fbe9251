"""Suffix-array deduplication: cut every byte that a repeated string of ``length`` bytes covers.

Strings that are equal must meet in one shard, and shards must stay small.  A string of 100 bytes holds 69
grams of 32 bytes; its *anchor* is the least of them by hash, the leftmost of equals, so equal
strings have equal anchors at equal places.  Consecutive strings of one anchor form a
*snippet*, about 35 strings in 134 bytes, and each string of a document lies in just one snippet.

1. Anchors are counted by hash with partial aggregation; only those that recur go on.
2. Snippets of equal hashes are one: the earliest represents them, and the others are cut whole, if their
   bytes are those of the earliest.  To see to that, adjoining cuts with the same source are joined to ranges, and
   each range must have the SHA-256 of its source.  A passage that a third of all documents hold is thus a few rows.
3. The different snippets of an anchor are dealt to shards by its hash.  A shard's suffix array is
   built by induced sorting, its common prefixes in text order by the permuted method, and
   each run of suffixes that share ``length`` bytes keeps its earliest start; the others are cut.
   The snippets of an anchor with over ``SHARD_SNIPPETS`` of them are split before: half of what a
   string holds besides its anchor stands on one side of it, so each string's anchor is widened by
   that many bytes to that side, and the strings of equal wide anchors form new, narrower snippets.  Equal strings still meet,
   and each split halves what strings of an anchor can differ in.
4. The cuts of a document are merged and applied to it.

Earlier means a smaller doc_id or, in one document, an earlier start.  The strings are those of
the input, whatever is cut from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, mix, powers, prefix_hash, utf8_parts
from .shared import discard, join_unique, materialise, small_batches
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 100
GRAM = 32
SHARD_BYTES = 4 << 20
SHARD_SNIPPETS = 16_384
_PLACE = np.uint64((1 << 28) - 1)


def snippets(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each snippet: row, first string's start within it, number of strings, anchor's place in the snippet and hash, hash of the whole snippet."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = length - gram + 1
    total = prefix_hash(data)
    _, down = powers(len(data) + 1)
    hashes = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    least = (hashes & ~_PLACE) | (np.arange(len(hashes), dtype=np.uint64) & _PLACE)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    start = np.arange(len(least))
    anchor = start + ((least & _PLACE).astype(np.int64) - start) % (1 << 28)
    whole = np.flatnonzero(start + length <= np.repeat(at[1:], np.diff(at))[: len(start)])
    place = anchor[whole]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)))) if len(whole) else none
    count = np.diff(np.append(first, len(whole)))
    begin = whole[first]
    row = np.searchsorted(at, begin, "right") - 1
    content = mix((total[begin + count + length - 1] - total[begin]) * down[begin] + count.astype(np.uint64))
    return row, begin - at[row], count, place[first] - begin, hashes[place[first]], content


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8_parts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for first, last in chunks(at):
                row, start, count, offset, anchor, content = snippets(data[at[first] : at[last]], at[first : last + 1] - at[first], length, gram)
                columns = [anchor.view(np.int64), content.view(np.int64), ids[first:last][row], start << 16 | offset << 8 | count]
                yield pa.record_batch([pa.array(c) for c in columns], ["anchor", "content", "doc_id", "place"])

    return run


_SCANNED = "anchor long, content long, doc_id long, place long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's copies in; out, as ranges, those that adjoin and whose sources do so too."""
    for batch in batches:
        out = []
        for doc_id, copies in zip(batch.column("doc_id").to_pylist(), batch.column("copies")):
            start, stop, source, first = (x.to_numpy(zero_copy_only=False) for x in copies.values.flatten())
            order = np.lexsort((start, first - start, source))
            start, stop, source, first = (x[order] for x in (start, stop, source, first))
            new = np.ones(len(start), np.bool_)
            new[1:] = (source[1:] != source[:-1]) | (first[1:] - start[1:] != first[:-1] - start[:-1]) | (start[1:] > stop[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start)) - 1
            out.append((np.full(len(head), doc_id), start[head], stop[tail] - start[head], source[head], first[head]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc_id", "start", "size", "source", "source_start"])


_SNIPPET = "anchor long, doc_id long, start long, offset int, strings int, snippet binary"


def _widened(length: int, gram: int):
    """Snippets in, whose anchors have ``gram`` bytes; out those whose anchors are wider by half of the rest."""
    half = (length - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, doc_id, start, offset, strings, raw in zip(*(c.to_pylist() for c in batch.columns)):
                first = min(max(offset - (length - gram - half), 0), strings)  # from this string on, the half stands behind the anchor
                for side, low, high in ((0, 0, first), (1, first, strings)):
                    if high > low:
                        at = offset + gram if side else offset - half
                        seed = anchor.to_bytes(8, "little", signed=True) + bytes([side, gram])
                        wide = hashlib.blake2b(seed + raw[at : at + half], digest_size=8).digest()
                        out.append((int.from_bytes(wide, "little", signed=True), doc_id, start + low, (offset if side else offset - half) - low, high - low, raw[low : high + length - 1]))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "doc_id", "start", "offset", "strings", "snippet"])

    return run


def _split_hot(texts: DataFrame, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(snippets whose anchors fit in a shard, cuts of the copies met on the way)."""
    ready, cuts = [], []
    while gram < length:
        sizes = texts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_SNIPPETS).select("anchor")
        hot = materialise(sizes, "hot-anchors")
        if hot.isEmpty():
            break
        ready.append(texts.join(hot, "anchor", "left_anti"))
        wide = materialise(texts.join(hot, "anchor", "left_semi").select("anchor", "doc_id", "start", "offset", "strings", "snippet").mapInArrow(_widened(length, gram), _SNIPPET), "wide-anchors")
        keys = ["anchor", "offset", "snippet"]
        leads = wide.groupBy(*keys).agg(F.min(F.struct("doc_id", "start", "strings")).alias("lead"), F.count("*").alias("n_rows"))
        leads = materialise(leads, "wide-leads")
        copies = join_unique(wide, leads.where("n_rows > 1"), keys, wide.count()).where("doc_id <> lead.doc_id or start <> lead.start")
        cuts.append(copies.select("doc_id", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("stop")))
        texts = leads.select("anchor", F.col("lead.doc_id").alias("doc_id"), F.col("lead.start").alias("start"), "offset", F.col("lead.strings").alias("strings"), "snippet")
        gram += (length - gram + 1) // 2
    return [*ready, texts], cuts


def _shard(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(doc_id, from, to) to cut, of one shard's rows (anchor, doc_id, start, bytes)."""
    doc = np.array([r[1] for r in rows], np.int64)
    begin = np.array([r[2] for r in rows], np.int64)
    size = np.array([len(r[3]) for r in rows])
    first = np.cumsum(size) - size
    text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    sa = suffix_array(text)
    shared = permuted_lcp(text, sa)[sa]
    run = np.cumsum(shared < length)
    owner = np.repeat(np.arange(len(rows)), size)[sa]
    offset = sa - first[owner]
    inside = offset + length <= size[owner]  # suffixes whose string doesn't leave its snippet
    run, owner, offset = run[inside], owner[inside], offset[inside]
    many = np.bincount(run)[run] > 1
    run, owner, offset = run[many], owner[many], offset[many]
    start = begin[owner] + offset
    order = np.lexsort((start, doc[owner], run))
    run, owner, start = run[order], owner[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    lead = np.repeat(head, np.diff(np.append(head, len(run))))
    later = (doc[owner] != doc[owner[lead]]) | (start != start[lead])
    doc_cut, start = doc[owner[later]], start[later]
    order = np.lexsort((start, doc_cut))
    doc_cut, start = doc_cut[order], start[order]
    new = np.concatenate(([True], (doc_cut[1:] != doc_cut[:-1]) | (start[1:] > start[:-1] + length))) if len(start) else np.zeros(0, np.bool_)
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(start))[: len(heads)] - 1
    return list(zip(doc_cut[heads].tolist(), start[heads].tolist(), (start[ends] + length).tolist()))


def _shards(length: int):
    """Rows sorted by anchor in; cuts out.  Whole anchors are gathered up to ``SHARD_BYTES``."""
    names = ["doc_id", "start", "stop"]

    def cuts(rows: list[tuple]) -> pa.RecordBatch:
        found = _shard(rows, length)
        return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "snippet"))):
                if row[0] != last and size >= SHARD_BYTES:
                    yield cuts(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield cuts(rows)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their cuts in; what remains of them out.  A cut with a hash is made only if its bytes have that hash."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        data, at = utf8_parts(batch.column("text"))
        kept, spans = [], []
        for i, cuts in enumerate(batch.column("cuts")):
            raw = data[at[i] : at[i + 1]]
            if not cuts.is_valid or not len(cuts):
                kept.append(raw.tobytes())
                spans.append([])
                continue
            start, stop, expected = cuts.values.flatten()
            pair = np.stack([x.to_numpy(zero_copy_only=False) for x in (start, stop)], 1)
            same = [e is None or hashlib.sha256(raw[a:b]).digest() == e for (a, b), e in zip(pair.tolist(), expected.to_pylist())]
            pair = pair[np.array(same)]
            if not len(pair):
                kept.append(raw.tobytes())
                spans.append([])
                continue
            pair = np.clip(pair[np.argsort(pair[:, 0], kind="stable")], 0, len(raw))
            reach = np.maximum.accumulate(pair[:, 1])
            head = np.flatnonzero(np.concatenate(([True], pair[1:, 0] > reach[:-1])))
            stop = reach[np.append(head[1:], len(pair)) - 1]
            merged = [(int(a), int(b)) for a, b in zip(pair[head, 0], stop) if b > a]
            keep = np.ones(len(raw), np.bool_)
            for a, b in merged:
                keep[a:b] = False
            kept.append(raw[keep].tobytes())
            spans.append([{"start": a, "stop": b} for a, b in merged])
        size = pa.array((np.diff(at)).astype(np.int64))
        yield pa.record_batch([batch.column("doc_id"), size, pa.array(kept, pa.binary()), pa.array(spans, spans_type)], ["doc_id", "n_bytes", "kept", "spans"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, kept, spans``: each document's size, its remaining bytes, and the maximal removed runs.

    Null texts count as empty, and texts under ``length`` bytes hold no string.  Rows without doc_id
    have no place in the order and are left out.  Rows that share a doc_id are one document and should
    share its text; each is returned, and of rows that don't share it, those keep bytes that differ from what
    would be cut.  What remains may not be valid UTF-8, as cuts go by
    bytes.  Columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    scanned = source.mapInArrow(_scan(length, gram), _SCANNED)

    recurring = materialise(scanned.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = materialise(scanned.join(recurring, "anchor").select("anchor", "content", "doc_id", "place"), "snippets")
    discard(recurring)

    # The order of (doc_id, place) is that of (doc_id, start): a document has one snippet at a start.
    earliest = found.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n_rows"))
    earliest = materialise(earliest.select("anchor", "content", F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"), "n_rows"), "earliest")
    start, count = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(255).cast("long"))
    copies = join_unique(found, earliest.where("n_rows > 1"), ["anchor", "content"], found.count()).where("doc_id <> first_id or place <> first_place")
    copies = copies.select("doc_id", F.struct(start.alias("start"), (start + count + F.lit(length - 1)).alias("stop"), F.col("first_id").alias("source"), F.shiftright("first_place", 16).alias("source_start")).alias("copy"))
    whole = materialise(copies.groupBy("doc_id").agg(F.collect_list("copy").alias("copies")).mapInArrow(_ranges, "doc_id long, start long, size long, source long, source_start long"), "copies")
    discard(found)

    # Bytes of the snippets that go to shards, and hashes of the ranges that are sources of copies, by one join with the texts.
    several = earliest.groupBy("anchor").agg(F.count("*").alias("snippets")).where("snippets > 1").select("anchor")
    place = F.col("first_place")
    low, middle = place.bitwiseAND(F.lit(255).cast("long")), F.shiftright(place, 8).bitwiseAND(F.lit(255).cast("long"))
    sharded = earliest.join(several, "anchor").select("anchor", F.col("first_id").alias("_id"), F.shiftright("first_place", 16).alias("start"), middle.cast("int").alias("offset"), low.cast("int").alias("strings"), (low + (length - 1)).alias("size"), F.lit(1).cast("long").alias("n_rows"))
    sources = whole.groupBy("source", "source_start", "size").agg(F.count("*").alias("n_rows"))
    sources = sources.select(F.lit(None).cast("long").alias("anchor"), F.col("source").alias("_id"), F.col("source_start").alias("start"), F.lit(0).alias("offset"), F.lit(0).alias("strings"), "size", "n_rows")
    raw = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    is_source = F.col("anchor").isNull()
    texts = source.join(sharded.unionByName(sources), F.col("doc_id") == F.col("_id")).select(
        "anchor", "doc_id", "start", "offset", "strings", "size", "n_rows", F.when(is_source, F.unhex(F.sha2(raw, 256))).alias("sha"), F.when(~is_source, raw).alias("snippet")
    )
    texts = materialise(texts, "snippet-texts")
    discard(earliest)

    hashed = texts.where(is_source).groupBy(F.col("doc_id").alias("source"), F.col("start").alias("source_start"), "size").agg(F.min("sha").alias("sha"), F.max("n_rows").alias("n_rows"))
    copied = join_unique(whole, hashed, ["source", "source_start", "size"], whole.count()).select("doc_id", "start", (F.col("start") + F.col("size")).alias("stop"), "sha")

    ready, cuts = _split_hot(texts.where(~is_source).select("anchor", "doc_id", "start", "offset", "strings", "snippet"), length, gram)
    snippets_ = ready[0]
    for more in ready[1:]:
        snippets_ = snippets_.unionByName(more)
    found_cuts = snippets_.select("anchor", "doc_id", "start", "snippet").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length), "doc_id long, start long, stop long")
    for more in cuts:
        found_cuts = found_cuts.unionByName(more)
    every = copied.unionByName(found_cuts.withColumn("sha", F.lit(None).cast("binary")))
    cuts_of = materialise(every.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "stop", "sha")).alias("cuts")), "cuts")
    discard(texts, whole)
    joined = source.join(cuts_of, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(_apply, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
