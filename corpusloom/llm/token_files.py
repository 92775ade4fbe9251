"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder with ``dictionary`` (trained on serialised id arrays) and shards.  A shard is

    magic "CLTOK001" | SHA-256 of the dictionary | frames | index | footer

with one frame for each document, the index rows ``doc_id, offset, frame length, number of ids`` (four
little-endian 64-bit integers) in ascending doc_id order, and the footer ``index offset, rows, ids`` and the
magic again.  A document is read by its index row alone, whatever the size of the others; a reader refuses a
dictionary of another hash.  Shards hold ascending ranges of doc_id, and a shard ends at ``SHARD_BYTES`` of frames or
``SHARD_DOCUMENTS``, which bounds its index.

Tasks name their shards anew on each attempt and the manifest, itself written to the shared
folder, lists those of the attempts that Spark committed; a lost executor leaves at most
files that nothing lists.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo
from .files import RangeReader, make_folder, open_input, open_output, read_all
from .shared import materialise, shared_path, small_batches

MAGIC = b"CLTOK001"
_FOOTER = struct.Struct("<QQQ8s")
END_ID = 2
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on at most so many documents, those with the least hash of
#: doc_id, and at most so many bytes of each; it changes the size of files, never their content.
SAMPLE_DOCUMENTS = 500
SAMPLE_BYTES = 32 << 10
SAMPLE_SLICES = 8
SHARD_BYTES = 256 << 20
SHARD_DOCUMENTS = 1 << 20
MEMO_PIECES = 450_000
#: Small and large letters of Latin-1, and ASCII marks behind them; either may be missing.
_PLAIN = r"^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file whose normaliser and splitter never cross white space.

    Texts are cut at ASCII white space and each different word of a batch is looked at once, in Arrow and NumPy.  A plain word, Latin-1 letters with
    ASCII marks behind them, is two pieces, its letters in small and its marks; any other word is one.  A bounded memo keeps the ids of
    pieces.  Of those not met before, letters go to the library's model, and all others through the library whole, as one
    pre-split sequence.  Texts that hold an added token go through the library as they are.
    """

    def __init__(self, definition: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.memo = Memo(MEMO_PIECES)
        # What the splitter makes of each small letter: a word of such letters is one piece, which the model takes as it is.
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): split(c)[0][0] for c in map(chr, range(256)) if c.isalpha() and c == c.lower()}
        # Only for files that treat plain words so.
        probe = ["the", "Thé", "word.", "Ünd,", "naïveté!", "zzyzxß", "...", "dogs'", "end.%%%", "Ça&&&", "ÀB_-'", "'"]
        self.plain = True
        self.plain = self.encode(probe) == [self._whole(w) for w in probe]
        self.memo = Memo(MEMO_PIECES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_letters(self, pieces: list[str]) -> list[bytes]:
        letters, tokenize, pack = self.letters, self.tokenizer.model.tokenize, struct.pack
        out = []
        for piece in pieces:
            ids = [t.id for t in tokenize(piece if piece.isascii() else piece.translate(letters))]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def _of_any(self, pieces: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            done = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(done.ids, "<u4").tobytes()
            cut = (np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(part) + 1)) * 4).tolist()
            out += [raw[i:j] for i, j in zip(cut, cut[1:])]
        return out

    def _pieces(self, pieces: pa.Array, learn) -> list[bytes]:
        """Ids of different pieces, those not in the memo by ``learn``."""
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.new.get, pieces))
        unknown = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self.memo.get(pieces[i])
            if found[i] is None:
                unknown.append(i)
        for i, ids in zip(unknown, learn([pieces[i] for i in unknown])):
            found[i] = ids
            if len(pieces[i]) <= 64:
                self.memo.put(pieces[i], ids)
        return found

    def _words(self, words: pa.Array) -> "_Rows":
        """Ids of different words."""
        if not self.plain:
            return _Rows.of(self._pieces(words, self._of_any))
        parts = pc.extract_regex(words, _PLAIN)
        stems = pc.utf8_lower(pc.struct_field(parts, "stem")).dictionary_encode()
        marks = pc.struct_field(parts, "marks").dictionary_encode()
        found = [*self._pieces(stems.dictionary, self._of_letters), *self._pieces(marks.dictionary, self._of_any)]
        n_stems, n = len(stems.dictionary), len(found)
        others = pc.is_null(parts).to_numpy(zero_copy_only=False)
        found += self._pieces(words.filter(pa.array(others)), self._of_any)
        found.append(b"")
        pairs = np.empty((len(words), 2), np.int64)
        pairs[:, 0] = pc.fill_null(stems.indices, 0).to_numpy(zero_copy_only=False)
        pairs[:, 1] = pc.fill_null(marks.indices, 0).to_numpy(zero_copy_only=False)
        pairs[:, 1] += n_stems
        pairs[others, 0] = np.arange(n, len(found) - 1)
        pairs[others, 1] = len(found) - 1
        both = _Rows.of(found).take(pairs.ravel())
        return _Rows(both.values, both.ends[1::2])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special ids."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        whole = {}
        for token in self.added:
            held = pc.match_substring(texts, token)
            if pc.any(held).as_py():
                whole |= {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist() if i not in whole}
        if whole:
            texts = pa.array(["" if i in whole else t for i, t in enumerate(texts.to_pylist())], texts.type)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices.to_numpy())
        offsets = split.offsets.to_numpy()
        cut = (np.concatenate(([0], ids.ends))[offsets - offsets[0]] * 4).tolist()
        raw = ids.values.tobytes()
        return [whole[i] if i in whole else raw[a:b] for i, (a, b) in enumerate(zip(cut, cut[1:]))]


@dataclass
class _Rows:
    """Rows of ids behind one another, and where each ends."""

    values: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[bytes]) -> "_Rows":
        return cls(np.frombuffer(b"".join(rows), "<u4"), np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 4))

    def take(self, which: np.ndarray) -> "_Rows":
        lengths = np.diff(self.ends, prepend=0)
        starts, lengths = (self.ends - lengths)[which], lengths[which]
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths)
        at += np.arange(len(at))
        return _Rows(self.values[at], ends)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(definition: str) -> WordEncoder:
    """The worker's own encoder of a definition: its memo outlives a task."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def sampled_text(text: Column) -> Column:
    """A text of at most ``SAMPLE_BYTES`` characters itself; of a longer one, equal slices spread from its start to its end."""
    part = SAMPLE_BYTES // SAMPLE_SLICES
    step = (F.length(text) - part) / (SAMPLE_SLICES - 1)
    slices = (text.substr((step * i).cast("int") + 1, F.lit(part)) for i in range(SAMPLE_SLICES))
    return F.when(F.length(text) <= SAMPLE_BYTES, text).otherwise(F.concat(*slices))


def sampled_ids(ids: bytes) -> bytes:
    """At most ``SAMPLE_BYTES`` of packed ids, as slices spread in the same way."""
    if len(ids) <= SAMPLE_BYTES:
        return ids
    part = SAMPLE_BYTES // SAMPLE_SLICES
    starts = ((len(ids) - part) * i // (SAMPLE_SLICES - 1) // 4 * 4 for i in range(SAMPLE_SLICES))
    return b"".join(ids[a : a + part] for a in starts)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class ShardWriter:
    def __init__(self, uri: str, dictionary: bytes):
        self.uri = uri
        self.out, self.packer, self.index, self.n_ids = open_output(uri), _compressor(dictionary), [], 0
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at = len(MAGIC) + 32

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.index.append((doc_id, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        self.out.write(np.array(self.index, "<i8").tobytes())
        self.out.write(_FOOTER.pack(self.at, len(self.index), self.n_ids, MAGIC))
        self.out.close()


class ShardReader:
    def __init__(self, uri: str, dictionary: bytes):
        self.f = open_input(uri)
        head = self.f.read(len(MAGIC) + 32)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.f.seek(self.f.size() - _FOOTER.size)
        at, rows, self.n_ids, magic = _FOOTER.unpack(self.f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} ends too soon")
        self.f.seek(at)
        self.index = np.frombuffer(self.f.read(rows * 32), "<i8").reshape(rows, 4)
        self.unpacker = _decompressor(dictionary)

    def document(self, doc_id: int) -> bytes | None:
        """Ids of one document, by its index row and one range; None if it isn't here."""
        at = int(np.searchsorted(self.index[:, 0], doc_id))
        if at == len(self.index) or self.index[at, 0] != doc_id:
            return None
        self.f.seek(int(self.index[at, 1]))
        return self.unpacker.decompress(self.f.read(int(self.index[at, 2])))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        ranges = RangeReader(self.f)
        for doc_id, offset, length, _ in self.index.tolist():
            yield doc_id, self.unpacker.decompress(ranges.read(offset, length))


@dataclass
class TokenStore:
    """A written store: its folder, and ``path, start, first_id, last_id, n_docs, n_ids`` of its shards in order."""

    folder: str
    shards: list[tuple]

    def fetch(self, doc_id: int) -> bytes | None:
        """Ids of one document, reading only the index of its shard and its own frame."""
        dictionary = read_all(f"{self.folder}/dictionary")
        for path, _, first, last, _, _ in self.shards:
            if first <= doc_id <= last and (found := ShardReader(path, dictionary).document(doc_id)) is not None:
                return found
        return None


_SHARD = "path string, first_id long, last_id long, part long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, definition: str, folder: str | None = None, end_id: int | None = END_ID, shard_documents: int = SHARD_DOCUMENTS) -> TokenStore:
    """Encode every whole text, append ``end_id``, and write a store in ascending doc_id order.

    Null texts count as empty and hold the end id alone.  Rows without doc_id have no place in
    the order and are left out; rows that share a doc_id stand side by side.  Columns other
    than ``doc_id`` and ``text`` are ignored.  An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_path(spark, "tokens")
    make_folder(folder)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    sample = source.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).withColumnRenamed("doc_id", "_id").distinct()
    texts = [r.text for r in source.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(sampled_text(F.col("text")).alias("text")).limit(2 * SAMPLE_DOCUMENTS).collect()]
    dictionary = train_dictionary([sampled_ids(x) for x in WordEncoder(definition).encode(texts) if x])
    with open_output(f"{folder}/dictionary") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((definition, dictionary))  # bounded by the tokeniser and DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, done = encoder_of(shared.value[0]), None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"path": writer.uri, "first_id": writer.index[0][0], "last_id": writer.index[-1][0], "part": done, "n_docs": len(writer.index), "n_ids": writer.n_ids}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                if writer is None:
                    writer = ShardWriter(f"{folder}/shard-{uuid.uuid4().hex}", shared.value[1])
                writer.add(doc_id, ids + tail)
                if writer.at >= SHARD_BYTES or len(writer.index) >= shard_documents:
                    yield closed()
                    writer, done = None, done + 1
        if writer is not None:
            yield closed()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    rows = sorted(materialise(ordered.mapInArrow(run, _SHARD), "shards").collect(), key=lambda r: (r.first_id, r.last_id, r.part))
    starts = np.concatenate(([0], np.cumsum([r.n_ids for r in rows]))).tolist()
    return TokenStore(folder, [(r.path, int(s), r.first_id, r.last_id, r.n_docs, r.n_ids) for r, s in zip(rows, starts)])


def read_tokens(spark: SparkSession, store: TokenStore) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a store, read from its files.

    ``start`` is the number of ids of all documents before it and ``ids`` the little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    folder = store.folder
    if not store.shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                dictionary = read_all(f"{folder}/dictionary") if dictionary is None else dictionary
                rows, size = [], 0
                for doc_id, ids in ShardReader(path, dictionary):
                    rows.append((doc_id, start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    listed = spark.createDataFrame([(p, s) for p, s, *_ in store.shards], "path string, start long")
    return listed.repartition(len(store.shards), "path").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
