"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is what stands between sentence ends (``. ! ?`` and line feeds).  Its features are its words
and their prefixes of three to six bytes, which carry stems that inflect.  With z the
sum of the weights of a sentence's features, its probability is ``1 - exp(-h)`` with
``h = max(0, softplus(z + BIAS) - softplus(BIAS))``: it grows like a logistic function, and a sentence
without evidence has none.  A document's is the noisy-or of its sentences and of a leak, the
``base`` rate of documents in which nothing speaks for toxicity: ``1 - (1 - base) prod(1 - p)``.  So a text
without evidence scores the base rate, whatever its length, and features may speak against as well as for.
Weights and base rate are fitted to document labels by gradient descent on that
probability's log-loss with a lasso penalty; the same weights then point at the sentences that made a document toxic.

Fitting uses at most ``MOST_PER_CLASS`` labelled documents of each class, those with the least hash of
doc_id, weighted back to the share of their class among the labels.  The ``MOST_FEATURES`` features of
the highest likelihood ratio of their document counts in the two classes take part, at every size of the
input; the penalty falls with the number of documents as the noise of such counts does.
What reaches the driver is bounded by these two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, mix, powers, prefix_hash, utf8_parts, word_mask
from .shared import materialise, small_batches, without_ids

MOST_PER_CLASS = 4000
MOST_FEATURES = 2048
LEAST_DOCUMENTS = 2
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
STEPS = 600
BIAS = -4.0
LASSO = 0.03
#: Pulls the base rate towards this logit, so weakly that it only matters where nearly all labels have evidence.
_BASE, _BASE_PULL = -3.0, 1e-3
_CHUNK_BYTES = 1 << 18  # a word has up to five features, of 16 bytes each and more in passing


def _softplus(x):
    return np.logaddexp(0, x)


def _logistic(x):
    return 1 / (1 + np.exp(-x))


def hazard(z):
    """-log(1 - p) of a sentence whose features' weights sum to ``z``."""
    return np.maximum(0, _softplus(z + BIAS) - _softplus(BIAS))


@dataclass
class ToxicityModel:
    hashes: np.ndarray  # sorted, 64 bits
    weights: np.ndarray
    base: float  # the probability of a text without evidence


def held_out(doc_id="doc_id"):
    """True for the quarter of ids that labels are never learnt from; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte, so that positions stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[upper] += 32
    return out


def _sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all sentences of the texts, and the number of the first of each text; texts without bytes have none."""
    head = np.zeros(len(data) + 1, np.bool_)
    end = (data == 46) | (data == 33) | (data == 63) | (data == 10)
    if len(data):
        head[1:-1] = end[:-1] & ~end[1:]
    head[at[:-1]] = True
    head = head[: len(data)]
    starts = np.flatnonzero(head)
    return starts, np.searchsorted(starts, at)


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word's start, feature hash) of every word and prefix."""
    mask = word_mask(data)
    before = np.zeros(len(data) + 1, np.bool_)
    before[1:] = mask
    before[at[:-1]] = False
    starts = np.flatnonzero(mask & ~before[:-1])
    after = np.append(mask, False)
    after[at[1:]] = False
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    total = prefix_hash(data)
    _, down = powers(len(data) + 1)
    places, hashes = [starts], [mix((total[ends] - total[starts]) * down[starts] + np.uint64(99))]
    length = ends - starts
    for k in PREFIXES:
        own = starts[length > k]
        places.append(own)
        hashes.append(mix((total[own + k] - total[own]) * down[own] + np.uint64(k)))
    return np.concatenate(places), np.concatenate(hashes)


def _pieces(batch: pa.RecordBatch):
    data, at = utf8_parts(batch.column("text"))
    for first, last in chunks(at, _CHUNK_BYTES):
        own = at[first : last + 1] - at[first]
        yield first, last, fold_case(data[at[first] : at[last]]), own


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, last, data, at in _pieces(batch):
            place, feature = _features(data, at)
            row = np.searchsorted(at, place, "right") - 1
            order = np.lexsort((feature, row))
            row, feature = row[order], feature[order]
            new = np.ones(len(row), np.bool_)
            new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
            toxic = label[first:last][row[new]].astype(np.int64)
            yield pa.record_batch([pa.array(feature[new].view(np.int64)), pa.array(toxic)], ["feature", "toxic"])


def _hits(hashes: np.ndarray):
    """A function from feature hashes to (which are known, their numbers)."""
    door = np.zeros(1 << 16, np.bool_)
    door[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def look(feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(door[(feature >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(hashes, feature[maybe]), len(hashes) - 1)
        ok = hashes[at] == feature[maybe]
        return maybe[ok], at[ok]

    return look


def _bags(hashes: np.ndarray):
    """Rows (toxic, sentence numbers, feature numbers) of labelled documents, the numbers as packed 32-bit integers."""
    look = _hits(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_pylist()
            out = []
            for first, last, data, at in _pieces(batch):
                starts, first_of = _sentences(data, at)
                place, feature = _features(data, at)
                which, number = look(feature)
                sentence = np.searchsorted(starts, place[which], "right") - 1
                pair = np.unique(sentence * np.int64(len(hashes)) + number)
                cut = np.searchsorted(pair, first_of * np.int64(len(hashes)))
                for i in range(last - first):
                    own = pair[cut[i] : cut[i + 1]]
                    out.append((label[first + i], (own // len(hashes) - first_of[i]).astype(np.int32).tobytes(), (own % len(hashes)).astype(np.int32).tobytes()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                ["toxic", "at", "feature"],
            )

    return run


def objective(w: np.ndarray, leak: float, y: np.ndarray, importance: np.ndarray, doc_of: np.ndarray, pair_sentence: np.ndarray, pair_feature: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Weighted log-loss of the noisy-or, without the penalty, and its gradients by the weights and by the logit of the base rate.

    Sentence s is of document doc_of[s]; a pair says that a feature is in a sentence.
    """
    n, n_docs = len(doc_of), len(y)
    z = np.bincount(pair_sentence, w[pair_feature], n)
    base = _logistic(leak)
    log_q = np.log1p(-base) - np.bincount(doc_of, hazard(z), n_docs)
    p = np.maximum(-np.expm1(log_q), 1e-9)
    loss = -(importance * np.where(y > 0, np.log(p), log_q)).sum() + _BASE_PULL * (leak - _BASE) ** 2 / 2
    pull = importance * np.where(y > 0, -np.exp(log_q) / p, 1.0)
    slope = pull[doc_of] * np.where(z >= 0, _logistic(z + BIAS), 0)
    return loss, np.bincount(pair_feature, slope[pair_sentence], len(w)), pull.sum() * base + _BASE_PULL * (leak - _BASE)


def _fit(bags: list, n_features: int, class_weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights and base rate that minimise the penalised loss, by Adam with soft thresholds."""
    y = np.array([b.toxic for b in bags], np.float64)
    importance = np.array([class_weight[int(v)] for v in y])
    importance /= importance.sum()
    doc_of, pair_sentence, pair_feature, n = [], [], [], 0
    for d, b in enumerate(bags):  # sentences without features have no say
        used, local = np.unique(np.frombuffer(b.at, np.int32), return_inverse=True)
        doc_of.append(np.full(len(used), d, np.int32))
        pair_sentence.append((local + n).astype(np.int32))
        pair_feature.append(np.frombuffer(b.feature, np.int32))
        n += len(used)
    doc_of, pair_sentence, pair_feature = (np.concatenate(x) for x in (doc_of, pair_sentence, pair_feature))
    share = float((importance * y).sum())
    penalty = LASSO * np.sqrt(share * (1 - share) * np.log(n_features + 1) / len(y))
    w, leak = np.zeros(n_features), float(np.log(max(share, 1e-6) / 2))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        _, by_weight, by_leak = objective(w, leak, y, importance, doc_of, pair_sentence, pair_feature)
        grad = np.append(by_weight, by_leak)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = 0.05 / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        move = rate * m / (1 - 0.9**step)
        w, leak = w - move[:-1], float(leak - move[-1])
        w = np.sign(w) * np.maximum(np.abs(w) - penalty * rate[:-1], 0)
    return w, float(_logistic(leak))


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> ToxicityModel:
    """A model from the labelled rows of ``docs`` that aren't held out; only text and ``toxic`` take part.

    Rows with a null id, text or label teach nothing.  A document with several labels counts once, as toxic if one of
    them says so.  Without labels of both classes no feature is
    learnt, and every text scores the share of toxic labels, or next to nothing if there are none.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = ToxicityModel(np.zeros(1, np.uint64), np.zeros(1), float(1 in totals and 0 not in totals))
    if len(totals) < 2:
        return none
    chosen = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * most_per_class rows of two numbers, whatever the input.
    bound = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))
    sample = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(bound, F.col("doc_id") == F.col("_id")).where("text is not null").select("toxic", "text"), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return none
    pos, neg = float(sizes[1]), float(sizes[0])
    counted = sample.repartition(F.xxhash64("text")).mapInArrow(_document_features, "feature long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")

    def part(seen, of_feature, of_class):  # seen * ln(seen / expected)
        return F.when(seen > 0, seen * F.log(seen * (pos + neg) / (of_feature * of_class))).otherwise(0.0)

    with_it, without = a + b, (pos + neg) - a - b
    ratio = 2 * (part(a, with_it, pos) + part(b, with_it, neg) + part(pos - a, without, pos) + part(neg - b, without, neg))
    best = counted.where(with_it >= LEAST_DOCUMENTS).withColumn("ratio", F.round(ratio, 9)).orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES)
    hashes = np.array(sorted(np.uint64(r.feature & (2**64 - 1)) for r in best.collect()), np.uint64)
    if not len(hashes):
        return none
    bags = sample.mapInArrow(_bags(hashes), "toxic int, at binary, feature binary").collect()  # packed: at most 2 * MOST_PER_CLASS rows
    weights, base = _fit(bags, len(hashes), {k: totals[k] / sizes[k] for k in sizes})
    used = np.flatnonzero(weights)
    return ToxicityModel(hashes[used], weights[used], base) if len(used) else ToxicityModel(none.hashes, none.weights, base)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, offending``: the document's probability, and its sentences of ``threshold`` or more.

    ``offending`` lists structs ``start, end, score`` in text order, in code points, end exclusive.
    Null and empty texts have no sentences and score the model's base rate, as any text without evidence.  One row for each row of ``docs``.
    """
    small_batches(docs.sparkSession)
    hashes, weights, base = model.hashes, model.weights, model.base
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _hits(hashes)
        for batch in batches:
            for first, last, data, at in _pieces(batch):
                starts, first_of = _sentences(data, at)
                place, feature = _features(data, at)
                which, number = look(feature)
                sentence = np.searchsorted(starts, place[which], "right") - 1
                pair = np.unique(sentence * np.int64(len(hashes)) + number)
                z = np.bincount(pair // len(hashes), weights[pair % len(hashes)], len(starts))
                own = hazard(z)
                owner = np.searchsorted(at, starts, "right") - 1
                result = np.clip(1 - (1 - base) * np.exp(-np.bincount(owner, own, last - first)), 0, 1)
                p = -np.expm1(-own)
                bad = np.flatnonzero(p >= threshold)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                ends = np.append(starts[1:], len(data))
                owner = np.searchsorted(at, starts[bad], "right") - 1
                origin = points[at[owner]]
                lists = [[] for _ in range(last - first)]
                for o, s, e, q in zip(owner.tolist(), (points[starts[bad]] - origin).tolist(), (points[ends[bad]] - origin).tolist(), p[bad].tolist()):
                    lists[o].append({"start": s, "end": e, "score": q})
                yield pa.record_batch([batch.column("doc_id").slice(first, last - first), pa.array(result), pa.array(lists, pa.list_(item))], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document scores under ``threshold``, with all their columns; rows without doc_id stay."""
    gone = score(docs, fit(docs, labels), threshold).where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return without_ids(docs, gone)
