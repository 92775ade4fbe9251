"""Audio, personal data, archives, pages, toxicity and the pipeline against brute force and planted cases."""

import base64
import hashlib
import io
import random
import re
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import audio, pages, pii, queries, toxicity, warc

from .conftest import EDGES

# --- audio --------------------------------------------------------------------------------------------


def tune(seed, seconds=3.0):
    rng = random.Random(seed)
    t = np.arange(int(seconds * audio.RATE)) / audio.RATE
    out = np.zeros(len(t))
    for k in range(0, len(t), audio.RATE // 4):
        f = 110 * 2 ** (rng.randrange(36) / 12)
        out[k : k + audio.RATE // 4] += np.sin(2 * np.pi * f * t[k : k + audio.RATE // 4])
    return np.clip(128 + 90 * out, 0, 255).astype(np.uint8)


def test_alignment(spark):
    a = tune(1)
    b = np.random.default_rng(8).integers(0, 256, len(a)).astype(np.uint8)
    noise = np.random.default_rng(0).integers(-3, 4, len(a))
    shift = 40 * audio.HOP
    rows = [(0, a), (1, a), (2, np.clip(a.astype(int) + noise, 0, 255).astype(np.uint8)), (3, b), (4, np.concatenate((b[:shift], a))), (5, a[:100]), (6, None), (None, a)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x.tobytes())) for i, x in rows], "doc_id long, pcm binary")
    got = {r.doc_id: r for r in audio.align(df, F.col("doc_id") == 0).collect()}
    assert set(got) == set(range(7)) and got[1].class_id == 0 and got[5].n_codes == got[6].n_codes == 0 and got[6].class_id == 6
    found = {i: [(m.query_id, m.offset) for m in r.matches] for i, r in got.items()}
    assert found[2] == [(0, 0)] and found[4] == [(0, -40)] and found[3] == [] and found[0] == [] and found[1] == []
    assert got[4].matches[0].overlap > 100
    assert audio.align(df.limit(0), F.col("doc_id") == 0).count() == 0


def test_codes_do_not_depend_on_neighbours():
    parts = [tune(k, 0.7) for k in range(4)] + [np.zeros(3, np.uint8), np.full(4000, 128, np.uint8)]
    at = np.cumsum([0] + [len(p) for p in parts])
    codes, _, n = audio.fingerprints(np.concatenate(parts), at)
    cut = np.concatenate(([0], np.cumsum(n)))
    for k, p in enumerate(parts):
        assert np.array_equal(codes[cut[k] : cut[k + 1]], audio.fingerprints(p, np.array([0, len(p)]))[0])
    assert audio.aligned(codes, codes, 0)[1:] == (len(codes), 0)


def test_integral_image_is_a_sum_of_boxes():
    x = tune(3)
    answers, n = audio._answers(x, np.array([0, len(x)]))
    frames = (len(x) - audio.FRAME) // audio.HOP + 1
    power = np.stack([np.abs(np.fft.rfft((x[k * audio.HOP : k * audio.HOP + audio.FRAME].astype(float) - 128) * np.hanning(audio.FRAME))) ** 2 for k in range(frames)]) @ audio.pitch_classes()
    smooth = sum(c * power[j : frames - 4 + j] for j, c in enumerate(audio.SMOOTH))
    smooth /= np.linalg.norm(smooth, axis=1, keepdims=True)
    for f, boxes in enumerate(audio.FILTERS):
        side = {1: 1.0, -1: 1.0}
        for sign, a, b, y, z in boxes:
            side[sign] += smooth[20 + a : 20 + b, y:z].sum()
        assert answers[20, f] == pytest.approx(np.log(side[1]) - np.log(side[-1]), abs=1e-3)


# --- personal data ------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_are_those_of_the_plain_patterns(make_docs):
    rng = random.Random(6)
    bits = ["a", "b@", "@", ".", "..", "1", "23", "4111 1111 1111 1111", "4111111111111111", "+", "+1 ", "(555) ", "555-1234", "-", " ", "192.168.0.1", "256.1.1.1", "0001.2.3.4", "x@y.z", "_", "%", "\n", "é", "😀", "", "78-05-1120"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(1200)] + EDGES + [(5000, "a@b" + ".c" * 30_000), (5001, "1 " * 20_000), (5002, "a" * 200_000)]
    got = pii.find_spans(make_docs(rows)).select("text", pii.listed(F.filter("spans", lambda s: s.base)).alias("base")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == plain_spans(r.text or ""), r.text[:80]


def test_further_spans_and_redaction(make_docs):
    rows = [(i, f"Dear Mr. John Smith, call tel 555 123 {4000 + i} or +1 (555) 555-{1000 + i} now") for i in range(30)] + [(100 + i, "The Quick Brown foxes ran over some hills and Far Away they went") for i in range(30)] + EDGES
    docs = make_docs(rows)
    model = pii.fit(docs)
    yes, no = zip(*model.reliability.values())
    assert all(0 < p < 1 for p in yes + no) and model.reliability["name", "known"][0] > model.reliability["name", "known"][1]
    got = {r.doc_id: r.s for r in pii.find_spans(docs, model).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert "local:" in got[3] and "phone:" in got[3] and "name:" in got[3] and got[101] == ""
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    by_id = {r.doc_id: r for r in clean.collect()}
    assert "<PHONE>" in by_id[3].text and "John" not in by_id[3].text and by_id[3].n_chars == len(by_id[3].text)
    assert by_id[101].text == rows[31][1] and by_id[901].text is None and by_id[3].spans == "x"
    assert pii.fit(docs.limit(0)).weights == {} and pii.find_spans(docs.limit(0)).count() == 0


def test_secrets_and_reliabilities_of_each_kind(make_docs):
    rng = random.Random(2)
    digits = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    rows = [(i, f'plain words token = "{digits(40, "0123456789abcdef")}" and more') for i in range(40)]
    rows += [(100 + i, f"see chapter-{i}-of-the-handbook-of-things and so on") for i in range(40)]
    docs = make_docs(rows)
    got = {r.doc_id: r.s for r in pii.find_spans(docs).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert all(f"secret:{rows[i][1].index(chr(34)) + 1}:{rows[i][1].rindex(chr(34))}" in got[i] for i in range(40)) and not any("secret" in got[100 + i] for i in range(40))
    assert "<SECRET>" in pii.redact(docs).where("doc_id = 3").first().text


def test_many_matches_in_one_text(make_docs):
    text = "1.2.3.4 " * 120_000
    start = time.time()
    got = pii.find_spans(make_docs([(1, text), (2, "a@b.c " * 1000)])).select("doc_id", "text", F.filter("spans", lambda s: s.base).alias("s")).collect()
    assert time.time() - start < 120
    for r in got:
        want = [(m.start(), m.end()) for m in re.finditer(r"\S+", r.text)]
        assert [(s.start, s.end) for s in r.s if s.kind in (0, 1)] == want


def test_personal_data_stays_in_the_jvm(make_docs):
    docs = make_docs([(1, "a@b.c")])
    for table in (pii.candidates(docs), pii.find_spans(docs), pii.find_spans(docs, pii.fit(docs))):
        assert not re.search("Python|Arrow|Pandas|Exchange", table._jdf.queryExecution().executedPlan().toString())


# --- archives -----------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(4, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (9, None, "other ü"), (7, "u", None), (8, "u", ""), (2, "http://b", "same"), (None, "u", "same"), (3, "u", "same")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long")
    packages = warc.write_packages(table)
    got = {r.page_id: r for r in warc.read_packages(packages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 2), 9: ("response", None), 7: ("response", None), 8: ("revisit", 7)}
    assert bytes(got[9].payload).decode() == "other ü" and got[4].payload_bytes == 4 and got[4].payload is None
    assert got[4].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    big = {r.page_id: r.record_type for r in warc.read_packages(warc.write_packages(table, min_bytes=5)).collect()}
    assert set(big.values()) == {"response"}
    assert warc.read_packages(warc.write_packages(table.limit(0))).count() == 0
    path = packages.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # an independent reader agrees on the members
        assert set(z.namelist()) == {warc.DATA, warc.INDEX, "datapackage.json"} and z.testzip() is None


class Ranges(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip64_directory_and_broken_archives():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"packed " * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK and more"
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    n, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    tail = data[end : end + 8] + b"\xff\xff" * 2 + b"\xff" * 8 + data[end + 20 :]
    archive = warc.ZipReader(Ranges(data[:end] + wide + locator + tail))
    at, length = archive.locate("a")
    assert data[at : at + length] == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        archive.locate("b")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.ZipReader(Ranges(b"nothing here"))
    entry = bytearray(data[start : start + size])
    first = 46 + 1
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry[20:28], entry[42:46], entry[30:32] = b"\xff" * 8, b"\xff" * 4, struct.pack("<H", len(extra))
    assert dict(warc.ZipReader._directory(bytes(entry[:first]) + extra, 1)) == {"a": (0, 5, 0)}
    record = warc.make_record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="differs"):
        warc.parse_record(record.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(ValueError):
        warc.parse_record(record[:-20])


def test_lower_peaks_are_tried():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**32, 400, dtype=np.uint32) for _ in range(2))
    b[:240:20] = a[:240:20]  # the tallest peak, without a stretch
    b[301:311] = a[101:111]
    weak = np.tile(np.arange(audio.WEAK_BITS, dtype=np.uint8), (400, 1))
    (found,) = audio.Block([(1, a.tobytes(), weak.tobytes())]).matches(2, b)
    assert (found["query_id"], found["offset"]) == (1, -200) and found["start"] <= 101 and found["start"] + found["overlap"] >= 111


def test_probes_turn_the_weakest_bits():
    x = tune(5)
    codes, weak, _ = audio.fingerprints(x, np.array([0, len(x)]))
    answers, levels = audio._answers(x, np.array([0, len(x)]))[0], audio._levels()
    got = audio.probes(codes, weak)
    for i in (0, 20, 77):
        far = []
        for f in range(16):
            for t in range(3):
                level = int((answers[i, f] > levels[:, f]).sum())
                other = t if answers[i, f] > levels[t, f] else t + 1
                if abs(other - level) == 1:
                    bit = (level ^ level >> 1 ^ other ^ other >> 1) << 2 * f
                    far.append((abs(answers[i, f] - levels[t, f]) / (levels[2, f] - levels[0, f]), f, bit))
        nearest = {}
        for d, f, bit in sorted(far):
            nearest.setdefault(f, bit)
        bits = list(nearest.values())[: audio.WEAK_BITS]
        want = {int(codes[i])} | {int(codes[i]) ^ a for a in bits} | {int(codes[i]) ^ a ^ b for a in bits for b in bits if a != b}
        assert set(got[i].tolist()) == want


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = [np.concatenate([tune(100 + k, 0.8), tune(200 + k % 3, 1.0)]) for k in range(12)] + [np.full(6000, 128, np.uint8), np.full(6000, 128, np.uint8), tune(1, 0.1)]
    parts += [np.clip(p.astype(int) + rng.integers(-6, 7, len(p)), 0, 255).astype(np.uint8)[int(rng.integers(0, 900)) :] for p in parts[:12]]
    rows = [(k, bytearray(p.tobytes())) for k, p in enumerate(parts)] + [(3, bytearray(parts[3].tobytes())), (50, bytearray())]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, pcm binary, codes int, class_id int")
    got = {r.doc_id: r for r in audio.align(df, F.col("doc_id") < 12).collect()}
    codes = {i: np.frombuffer(bytes(r.codes), np.uint32) for i, r in got.items() if r.class_id == i and r.n_codes}
    want = {(q, i) for q in range(12) for i in codes if i != q and any(audio.aligned(codes[q], codes[i], o)[1] for o in range(-len(codes[i]), len(codes[q])))}
    found = {(m.query_id, i) for i, r in got.items() for m in r.matches}
    assert found <= want and len(found) >= 0.9 * len(want) > 20
    assert got[13].class_id == 12 and audio.align(df, F.col("doc_id") == 3).count() == len(rows)


# --- pages --------------------------------------------------------------------------------------------

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header id="top"><h1>Site</h1></header><nav><ul><li><a href=/a>One</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>First   paragraph with <b>bold</b>
text.<br>After the break &eacute;&#233; 5 &lt; 6<p>Second <a href="x">link</a> a < b.</p><aside>Related things</aside>
<form><input value="x"><button>Go</button></form><div class="ad banner">Buy now</div><script>document.write("<p>bad</p>")</script><pre>code  here</pre></article>
<section id="comments"><p>A reader says hello</p></section></main><div class="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert pages.main_text(FULL) == "Title & more\nFirst paragraph with bold text.\nAfter the break éé 5 < 6\nSecond link a < b.\ncode here"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>menu</nav></body></html>", ""),
        ("just text", "just text"),
        ("<div class=ad>x <article><p>a</p>", "a"),
        ("<article><p>cut off in a <b", "cut off in a"),
        ("<article><p>x</p><script>never closed <p>y</p>", "x"),
        ("<article><p>x</p><!-- open <p>y</p>", "x"),
        ('<article><p title="a > b">x</p></article>', "x"),
        ("<article><p>x" + "<a " * 30_000 + '"', "x"),
        ("<article><p>x</p>" + "<a '" * 29_999, "x"),
        ("<article>" + "<div>" * 30_000 + "x" + "</section>" * 30_000, "x"),
        ("<p>a <b <i>c</i>", "a c"),
        ("<p>" + "long text here " * 30 + "</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul>", ("long text here " * 30).strip()),
    ],
)
def test_odd_pages(page, text):
    assert pages.main_text(page) == text


def test_without_lists_the_distribution_decides():
    long = "A sentence of the story that goes on for a while. " * 8
    links = "".join(f'<li><a href="/{k}">Entry {k}</a></li>' for k in range(30))
    page = f'<div id="a1"><ul>{links}</ul></div><div id="b2"><p>{long}</p><p>{long}</p></div><div><a href=x>Say</a> <a href=y>Join us</a></div>'
    assert pages.main_text(page, lists=False) == f"{long.strip()}\n{long.strip()}" == pages.main_text(page)


LONG = "A sentence of the story that goes on for a while. " * 8


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>Teaser</p></article><div><p>{LONG}</p></div>", LONG.strip()),  # the element holds little of the text
        (f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div><nav>m</nav><div>Short</div>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<div><p>{LONG}</p></div><article class="comment"><p>{LONG}</p><article class="comment"><p>Reply</p></article>More</article>', LONG.strip()),
        (f'<div id="comments"><article class="comment"><p>{LONG}</p></article>Leave a reply</div><div><p>{LONG}!</p></div>', f"{LONG}!"),
        (f'<article class="post has-comments tag-social"><p>{LONG}</p></article>', LONG.strip()),
        (f'<div><p>{LONG}</p><div class="ad">Buy</div><p>The end.</p></div><nav>m</nav><div><p>Other</p></div>', f"{LONG.strip()}\nThe end."),
        (f"<main><h1>Title</h1><article><p>{LONG}</p><aside>x</aside><p>End.</p></article></main>", f"Title\n{LONG.strip()}\nEnd."),
        (f'<article><h2><a href="/x">Linked title</a></h2><p>{LONG}</p></article>', f"Linked title\n{LONG.strip()}"),
    ],
)
def test_weights_decide_on_marked_pages(page, text):
    assert pages.main_text(page) == text


def test_page_table(spark):
    rows = [(1, "u", FULL), (None, None, None), (2, "v", ""), (2, "v", ""), (3, "w", "<article>" + "<p>x</p>" * 20_000)]
    got = pages.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and sorted(len(r.text) for r in got)[-1] == 39_999
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    stems = ["idiot", "blödm", "stupid"]
    rows, labels = [], []
    for i in range(1500):
        sentences = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 8))]
        toxic = int(i % 4 == 0)
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(stems) + rng.choice(["", "en", "isch", "erei"])
        rows.append((i, ". ".join(s.capitalize() for s in sentences) + "."))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity(spark, make_docs, labelled):
    rows, labels = labelled
    docs = make_docs(rows + EDGES)
    label_table = spark.createDataFrame(labels + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, label_table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(y) for i, y in held)
    assert right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert got[901].score == got[902].score == pytest.approx(model.base) and model.base < 0.1 and got[902].offending == []
    for i, y in held[:60]:
        text = rows[i][1]
        for s in got[i].offending:
            assert re.search("(?i)idiot|blödm|stupid", text[s.start : s.end])
    clean = toxicity.without_toxic(docs, label_table)
    assert clean.columns == docs.columns and clean.where("doc_id is null").count() == 1


def test_toxicity_never_learns_from_held_out_rows(spark, make_docs, labelled):
    rows, labels = labelled
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.fit(make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.weights, b.weights)


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "some text. more")])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score < 0.05
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_noisy_or_gradient():
    """The gradients are those of finite differences."""
    rng = np.random.default_rng(1)
    n, docs, features = 40, 12, 9
    doc_of, y = np.sort(rng.integers(0, docs, n)), rng.integers(0, 2, docs).astype(float)
    sentence, feature = rng.integers(0, n, 90), rng.integers(0, features, 90)
    importance = rng.random(docs)
    w, leak = rng.normal(0, 1.5, features), -2.0
    at = lambda w, leak: toxicity.objective(w, leak, y, importance, doc_of, sentence, feature)
    _, by_weight, by_leak = at(w, leak)
    for k in range(features):
        e = np.eye(features)[k] * 1e-6
        assert by_weight[k] == pytest.approx((at(w + e, leak)[0] - at(w - e, leak)[0]) / 2e-6, abs=1e-5)
    assert by_leak == pytest.approx((at(w, leak + 1e-6)[0] - at(w, leak - 1e-6)[0]) / 2e-6, abs=1e-5)


def test_score_is_the_noisy_or_of_sentences(spark, make_docs):
    def feature(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return toxicity._features(raw, np.array([0, len(raw)]))[1][0]

    weights = {"bad": 5.0, "awful": 4.5, "nice": -3.0}
    pairs = sorted((feature(k), v) for k, v in weights.items())
    model = toxicity.ToxicityModel(np.array([h for h, _ in pairs], np.uint64), np.array([v for _, v in pairs]), 0.02)
    texts = ["", "plain. words", "a bad day. plain", "Bad? awful! bad nice", "plain words here. " * 5000, "nice. bad " + "x" * 100_000, "é BAD. é\nawful"]
    got = {r.doc_id: r for r in toxicity.score(make_docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        q, bad = 1 - 0.02, []
        for m in re.finditer(r"[^.!?\n]+[.!?\n]*", t):
            z = sum(v for k, v in weights.items() if k in re.findall(r"\w+", m[0].lower()))
            p = 1 - np.exp(-max(0, np.logaddexp(0, z - 4) - np.logaddexp(0, -4)))
            q *= 1 - p
            bad += [(m.start(), m.end())] if p >= 0.3 else []
        assert got[i].score == pytest.approx(1 - q, abs=1e-9)
        assert [(s.start, s.end) for s in got[i].offending] == bad
    assert got[4].score == pytest.approx(0.02)


def test_labels_that_disagree_or_repeat(spark, make_docs, labelled):
    rows, labels = labelled
    twice = labels + [(i, 0) for i, y in labels if y] + labels[:200]
    a, b = (toxicity.fit(make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, twice))
    assert np.array_equal(a.hashes, b.hashes) and np.allclose(a.weights, b.weights) and a.base == pytest.approx(b.base)


# --- queries and the pipeline -------------------------------------------------------------------------


def write_tables(spark, folder, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "seven plain words of a benchmark item " * 2)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline(spark, tmp_path, labelled):
    rows, labels = labelled
    long = " ".join(f"unique{i}" for i in range(60))
    extra = [(5000, long), (5001, long), (5002, long + " tail"), (5003, "before it seven plain words of a benchmark item seven plain words of a benchmark item and after"), (5004, f"write to me@mail.example.com about {long[::-1]}"), (5005, None), (5006, "")]
    write_tables(spark, str(tmp_path), rows + extra, labels)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {5000, 5004, 5005, 5006} <= set(got) and not {5001, 5002, 5003} & set(got)
    toxic = {i for i, y in labels if y}
    assert len(toxic & set(got)) <= 0.03 * len(toxic) and len(set(got) - toxic) > 0.97 * (len(rows) - len(toxic))
    masked = f"write to <EMAIL> about {long[::-1]}"
    assert got[5004].text_sha256 == hashlib.sha256(masked.encode()).hexdigest() and got[5004].n_tokens == len(got[5004].ids)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == corpus_pipeline.COLUMNS


def test_registered_queries():
    found = queries.queries()
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in found] == list(range(1, 11))
    assert pa.__version__
