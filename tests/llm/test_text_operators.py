"""Byte-pair encoding, token files, near duplicates, decontamination and suffix deduplication against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import blocks, bpe, decontaminate, graph, ngram_join, suffix_array, suffix_dedup, token_files

from .conftest import EDGES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(codec.tokens, codec.ranks)), special_tokens={})


TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "'s", "'", "É", "ß", "1", "23", "!", "?!", "日本", "́", "😀", "zz", "\r\n", " \n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "İ", "Σ", "Und,", "ª"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_that_of_the_library(codec, oracle, text):
    ids = np.frombuffer(codec.encode(text), np.int32).tolist()
    assert ids == oracle.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_perfect_hash(codec):
    assert sorted(codec.hash.order) == list(range(codec.hash.n))
    assert all(codec.rank(t) == r for t, r in zip(codec.tokens[::97], codec.ranks[::97]))
    assert codec.rank(b"\x00not a token\x00") == -1
    small = bpe.PerfectHash([b"a", b"b", b"c"])
    assert {small.position(k) for k in (b"a", b"b", b"c")} == {0, 1, 2}
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_memo_keeps_to_its_size():
    memo = bpe.Memo(10)
    for i in range(1000):
        memo.put(i, i)
        assert len(memo.new) <= 10 and memo.get(i) == i


def test_encode_and_decode_tables(make_docs, codec, oracle):
    docs = make_docs(EDGES)
    rows = bpe.decode(bpe.encode(docs, codec), codec).collect()
    assert sorted(map(repr, bpe.encode_and_decode(docs, codec).collect())) == sorted(map(repr, rows))
    assert len(rows) == len(EDGES)
    want = sorted((str(i), tuple(oracle.encode_ordinary(t or "")), (t or "").encode()) for i, t in EDGES)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(docs.limit(0), codec), codec).count() == 0
    with pytest.raises(KeyError):
        codec.decode_rows(np.array([60_000]), np.array([0, 1]))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_word_encoder_is_the_library(word_encoder, word_oracle, text):
    assert np.frombuffer(word_encoder.encode([text])[0], "<u4").tolist() == word_oracle.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_oracle():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def word_encoder():
    return token_files.WordEncoder(open(WORDS, encoding="utf-8").read())


ODD_WORDS = st.lists(st.sampled_from([" ", "\n", "\x0b", "\x0c", "\x1f", "\u2028", "\u3000", "word", "ÀÉ", "ÿ", "ŷ", "µ", "º", "×", "÷", "_", "'", "'s", "###", "&&&", ".%%%", "!!", "٣", "²", "e\u0301", "=\u0338", "<|endoftext|>", "x" * 70]), max_size=10).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD_WORDS, max_size=6))
def test_word_encoder_takes_several_texts(word_encoder, word_oracle, texts):
    want = [np.array(word_oracle.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert word_encoder.encode(texts) == want == word_encoder.encode(pa.array(["", *texts])[1:])


def test_forms_of_a_stem_share_its_ids(word_oracle):
    class Counting:
        def __init__(self, tokenizer):
            self.own, self.model, self.n = tokenizer, tokenizer.model, 0

        def encode(self, words, **options):
            self.n += 1 if isinstance(words, str) else len(words)
            return self.own.encode(words, **options)

    encoder = token_files.WordEncoder(open(WORDS, encoding="utf-8").read())
    encoder.tokenizer = Counting(encoder.tokenizer)
    marks = ["###", "&&&", ".%%%", "!!", ",***", "'", "?!"]
    text = " ".join(case(f"st{a}m{b}é") + m for a in "abcdefgh" for b in "uvwxyz" for m in marks for case in (str, str.upper, str.title))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == word_oracle.encode(text, add_special_tokens=False).ids
    assert encoder.tokenizer.n <= len(marks) + 1  # each run of marks once, and no word whole


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_token_store(spark, make_docs, word_oracle, most):
    rows = EDGES + [(i, f"short text number {i}, again and again<|endoftext|>") for i in range(60)] + [(7, "a repeated id")] * 12
    store = token_files.write_tokens(make_docs(rows), open(WORDS, encoding="utf-8").read(), shard_documents=most)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read_tokens(spark, store).collect())
    want, start = [], 0  # rows of one id may stand in any order among themselves
    for i, t in sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: x[0]):
        ids = np.array([*word_oracle.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((i, n) for i, _, n, _ in got) == sorted((i, n) for i, _, n, _ in want) and (most == 7) == (max(x[4] for x in store.shards) == 7)
    assert [x for x in got if x[0] != 7] == [x for x in want if x[0] != 7]
    assert np.frombuffer(store.fetch(8), "<u4").tolist() == [*word_oracle.encode(rows[len(EDGES) + 8][1], add_special_tokens=False).ids, 2]
    assert store.fetch(12345) is None
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.ShardReader(store.shards[0][0], b"other")
    empty = token_files.write_tokens(make_docs([]), open(WORDS, encoding="utf-8").read())
    assert token_files.read_tokens(spark, empty).count() == 0


def test_dictionary_samples_reach_the_end(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(token_files, "train_dictionary", lambda samples: seen.extend(samples) or b"")
    text = "".join(f"{i:07d} " for i in range(20_000))
    encoder = token_files.WordEncoder(open(WORDS, encoding="utf-8").read())
    token_files.write_tokens(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), open(WORDS, encoding="utf-8").read())
    whole, last = sorted(seen, key=len)[-1], encoder.encode([text])[0][-400:]
    assert len(whole) <= token_files.SAMPLE_BYTES and whole.endswith(last) and encoder.encode(["short"])[0] in seen
    assert token_files.sampled_ids(bytes(40_000) + b"tail")[-4:] == b"tail"



# --- shingles, near duplicates, decontamination -------------------------------------------------------


def near_texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 60, 200]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, (" ".join(words) if rng.random() < 0.5 else ", ".join(words).upper())))
    return rows


def brute_links(sets, threshold=0.8):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def classes_of(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(make_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    rows = near_texts(block)
    texts = {i: t for i, t in rows + EDGES if i is not None}
    sets = {i: blocks.shingle_strings((t or "").lower()) for i, t in texts.items()}
    links = brute_links(sets)
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(make_docs(rows + EDGES)).collect()}
    assert set(got) == set(texts) and len(links) > 50
    want = classes_of(texts, links)
    assert {i: r.class_id for i, r in got.items()} == want
    words = {i: tuple(blocks.word_strings((t or "").lower())) for i, t in texts.items()}
    for i, r in got.items():
        others = {words[b if a == i else a] for a, b in links if i in (a, b)} - {words[i]}
        assert r.n_links == len(others)
        assert r.n_copies == (sum(w == words[i] for w in words.values()) + (i == 904) if words[i] else 1)
    assert ngram_join.ngram_jaccard_join(make_docs([])).count() == 0


def test_one_of_each_class_stays(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(5, text), (3, text), (4, text + " more"), (8, "another thing entirely"), (None, text)])
    kept = ngram_join.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "None"]


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, None)]
    want = classes_of({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {i: r for i, r in want.items() if i in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_those_of_strings():
    texts = ["", "a b", "One two three four five six", "ä ö ü ß é " * 5, "x-y,z q r s t", "日本 語 " * 4]
    data = "".join(t.lower() for t in texts).encode()
    at = np.cumsum([0] + [len(t.lower().encode()) for t in texts])
    _, _, row, hashes = blocks.words(np.frombuffer(data, np.uint8), at)
    x, start = blocks.shingles(hashes, row, len(texts))
    for i, t in enumerate(texts):
        assert len(np.unique(x[start[i] : start[i + 1]])) == len(blocks.shingle_strings(t.lower()))
    assert blocks.word_strings("x-y,z q r") == ["x", "y", "z", "q", "r"]


def test_decontamination(spark, make_docs):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([1, 3, 5, 6, 9, 20, 40, 60, 90])] + [(50, None), (51, "..."), (None, "x y z q r s"), (5, "a second text of five")]
    rows = [(i, " ".join(say(rng.choice([20, 300, 3000])))) for i in range(60)]
    for i in range(60):
        k = rng.randrange(9)
        words, doc = items[k][1].split(), rows[i][1].split()
        if i % 3 == 1 and len(words) > 8:
            words[rng.randrange(len(words))] = "changed"
        at = rng.randrange(len(doc))
        rows[i] = (i, ", ".join(doc[:at] + words + doc[at:]).title())
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows + EDGES:
        mine = blocks.shingle_strings((t or "").lower())
        want |= {(i, k) for k, s in items if i is not None and k is not None and (q := blocks.shingle_strings((s or "").lower())) and len(q & mine) >= 0.8 * len(q)}
    docs = make_docs(rows + EDGES)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == want and len(want) > 25
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows + EDGES) - sum(i in {a for a, _ in want} for i, _ in rows + EDGES)
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0 and decontaminate.contained_items(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)
    items = [(k, f"item {k} has some words of its own here {k}") for k in range(12)]
    docs = make_docs([(k, f"before it {t} and after") for k, t in items])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(12)}


# --- suffix arrays ------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"a", b"ab", b"abc", b"\x00", b"\xff"]), max_size=120).map(b"".join)))
def test_suffix_array(raw):
    text = np.frombuffer(raw, np.uint8)
    sa = suffix_array.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix_array.permuted_lcp(text, sa)
    for before, here in zip(sa[:-1], sa[1:]):
        n = 0
        while max(before, here) + n < len(raw) and raw[before + n] == raw[here + n]:
            n += 1
        assert shared[here] == n


def brute_dedup(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                cut[s : s + length] = b"\1" * length
            seen.add(piece)
        out[i] = bytes(b for b, c in zip(raw, cut) if not c), len([1 for a, b in zip(b"\0" + cut, cut) if b and not a])
    return out


@pytest.mark.parametrize("most", [16_384, 1])
def test_suffix_dedup(make_docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "SHARD_SNIPPETS", most)
    rng = random.Random(most)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([40, 120, 400]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("mnopq ") for _ in range(50)) for _ in range(rng.randrange(7)))) for i in range(60)]
    rows += [(500, "ab" * 300), (501, "ab" * 90), (502, "x" * 99), (503, "x" * 100), (504, None), (505, "")]
    got = suffix_dedup.suffix_dedup(make_docs(rows + [(None, passages[0]), (500, "ab" * 300)])).collect()
    want = brute_dedup(rows, 100)
    assert len(got) == len(rows) + 1 and {r.doc_id for r in got} == set(want)
    for r in got:
        assert (bytes(r.kept), len(r.spans)) == want[r.doc_id]
        assert r.n_bytes - len(r.kept) == sum(s.stop - s.start for s in r.spans)
    assert suffix_dedup.suffix_dedup(make_docs([])).count() == 0
