"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets ``p = sigmoid(bias + sum of weights of its
distinct words)`` and a document ``1 - prod(1 - p)`` (noisy-or), so one offending sentence is
enough.  Only document labels train the weights; the sentence scores then locate the offence.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` per label value, the
smallest hashes first) and its size is fixed (``BUCKETS`` weights), so the driver's memory and
the broadcast don't grow with the input.  Scoring is one narrow pass over whole texts.

``MIN_G``, ``PREFIXES`` and the settings of ``fit`` were chosen by ``cross_validate`` inside the
learnable rows; held-out labels take no part in any choice.

Defined cases: null and empty texts hold no sentence and score 0; null labels and ids are not
learned from; a document with several label rows counts as toxic if one is; without labels of
both kinds every weight is 0 and the bias alone scores; of sentences that tie the first is
located; repeated rows get equal scores; an empty table gives no rows; extra columns are ignored
by the scores and kept by ``reject_toxic``, whatever their names.  A very long text is scored
whole in one task (some 100 bytes a byte).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel
from wellspark.llm.common import held_out

BUCKETS = 1 << 18
#: Bound of the training sample: rows per label value.
SAMPLE = 3000
#: A bucket is learned if its excess in toxic documents of the sample has this likelihood ratio (G).
MIN_G = 12.0
#: A word also counts by its first letters of these lengths in bytes, so that inflected forms share evidence.
PREFIXES = (4, 5, 6)
EPOCHS = 12
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclasses.dataclass
class Model:
    weights: np.ndarray
    bias: float


@dataclasses.dataclass
class Bags:
    """Distinct words (as buckets) of each sentence, and each sentence's text."""

    bucket: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    n_texts: int


def bags(t: kernel.Texts) -> Bags:
    """Sentences end after a word with ``.``, ``!`` or ``?`` at its end, and with a line.

    A word counts in lower case without the marks around it, and once in a sentence.
    """
    w = t.words(lower=True)
    if not len(w.hash):
        e = np.empty(0, np.int64)
        return Bags(e, e, e, e, e, t.n)
    low = kernel.LOWER[t.buf]
    a, b = kernel.trim(t.buf, w.start, w.stop)
    newline = np.concatenate([[0], np.cumsum(t.buf == 10)])
    ended = _ENDS[t.buf[w.stop - 1]]
    ended[:-1] |= newline[w.start[1:]] > newline[w.stop[:-1]]
    ended[w.last[w.count > 0] - 1] = True
    ended[-1] = True
    sentence = np.concatenate([[0], np.cumsum(ended)[:-1]])
    last = np.flatnonzero(ended)
    first = np.concatenate([[0], last[:-1] + 1])
    hashed = kernel.SpanHash(low)
    size = np.maximum(b - a, 0)
    found = [sentence * BUCKETS + (hashed(a, a + size) % np.uint64(BUCKETS)).astype(np.int64)]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        h = kernel.mix(hashed(a[at], a[at] + n) + np.uint64(n))
        found.append(sentence[at] * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    pair = np.unique(np.concatenate(found))
    return Bags(pair % BUCKETS, pair // BUCKETS, w.text[first], w.start[first], w.stop[last], t.n)


def sentence_scores(b: Bags, m: Model) -> np.ndarray:
    z = m.bias + np.bincount(b.sentence, weights=m.weights[b.bucket], minlength=len(b.text))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(b: Bags, p: np.ndarray) -> np.ndarray:
    return -np.expm1(np.bincount(b.text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b.n_texts))


def telling(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, min_g: float = MIN_G) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets occur in clearly more toxic documents, and half their smoothed log ratio."""
    seen = np.zeros((2, BUCKETS))
    for text, bucket, label in parts:
        pair = np.unique(text * BUCKETS + bucket)
        for v in (0, 1):
            seen[v] += np.bincount(pair[label[pair // BUCKETS] == v] % BUCKETS, minlength=BUCKETS)
    n = np.array([[(y == 0).sum()], [(y == 1).sum()]], float)
    both, all_ = seen.sum(0), n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        cells = [(seen[v], n[v] * both / all_) for v in (0, 1)] + [(n[v] - seen[v], n[v] * (all_ - both) / all_) for v in (0, 1)]
        g = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)
    rate = (seen + 0.5) / (n + 1)
    return (g >= min_g) & (rate[1] > rate[0]), np.log(rate[1] / rate[0]) / 2


def slopes(b: Bags, p: np.ndarray, label: np.ndarray, clean_weight: float) -> np.ndarray:
    """The derivative of the noisy-or loss by each sentence's sum of weights.

    It is p for a clean document and -p (1 - score) / score for a toxic one.
    """
    score = np.clip(noisy_or(b, p), 1e-6, 1 - 1e-6)
    return p * np.where(label > 0, -(1 - score) / score, clean_weight)[b.text]


def fit(texts: list[bytes | None], labels: np.ndarray, clean_weight: float = 1.0, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, min_g: float = MIN_G) -> Model:
    """Adagrad on the noisy-or likelihood, in minibatches of 64 documents, in a fixed order.

    ``clean_weight`` makes up for clean documents that the bounded sample left out.
    """
    m = Model(np.zeros(BUCKETS), -4.0)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(m.weights, float(-6 if not len(y) or y.max() == 0 else 0))
    square, bias_square = np.full(BUCKETS, 1e-2), 1e-2
    rng = np.random.default_rng(7)
    order = rng.permutation(len(texts))
    parts = [order[k : k + 64] for k in range(0, len(order), 64)]
    made = [(bags(kernel.Texts([texts[i] for i in part])), y[part]) for part in parts]
    chosen, start = telling([(b.text[b.sentence], b.bucket, label) for b, label in made], y, min_g)
    m.weights[chosen] = start[chosen]
    for b, _ in made:
        known = chosen[b.bucket]
        b.bucket, b.sentence = b.bucket[known], b.sentence[known]
    for _ in range(epochs):
        for k in rng.permutation(len(made)):
            b, label = made[k]
            p = sentence_scores(b, m)
            g = slopes(b, p, label, clean_weight)
            grad = np.bincount(b.bucket, weights=g[b.sentence], minlength=BUCKETS)
            used = np.unique(b.bucket)
            grad = grad[used] + decay * len(label) * m.weights[used]
            square[used] += grad**2
            m.weights[used] -= rate * grad / np.sqrt(square[used])
            gb = float(g.sum())
            bias_square += gb**2
            m.bias -= rate * gb / np.sqrt(bias_square)
    return m


def cross_validate(texts: list[bytes | None], labels: np.ndarray, clean_weight: float = 1.0, folds: int = 3, **settings: float) -> tuple[float, float, float]:
    """Weighted log loss, recall of toxic texts and share of clean ones called toxic, each fold scored by a fit on the others."""
    y = np.asarray(labels)
    fold = np.random.default_rng(3).integers(0, folds, len(y))
    score = np.zeros(len(y))
    for f in range(folds):
        m = fit([t for t, k in zip(texts, fold) if k != f], y[fold != f], clean_weight, **settings)
        b = bags(kernel.Texts([t for t, k in zip(texts, fold) if k == f]))
        score[fold == f] = noisy_or(b, sentence_scores(b, m))
    p = np.clip(score, 1e-4, 1 - 1e-4)
    weight = np.where(y == 1, 1.0, clean_weight)
    loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).sum() / weight.sum()
    return float(loss), float((score[y == 1] >= 0.5).mean()), float((score[y == 0] >= 0.5).mean())


def marked_ids(labels: DataFrame) -> DataFrame:
    """id, toxic (one row per id) of the labels outside the held-out fifth."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))


def training_rows(docs: DataFrame, marked: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``per_label`` labelled rows of each label value."""
    order = [F.xxhash64("id"), "id"]
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(per_label).unionAll(marked.filter("toxic = 0").orderBy(*order).limit(per_label))
    # at most 2 * per_label ids of 12 bytes are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.orderBy(*order, F.xxhash64("text")).limit(2 * per_label)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model:
    marked = marked_ids(labels)
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = {k: min(n.get(k, 0), per_label) for k in (0, 1)}
    weight = n.get(0, 0) * taken[1] / (taken[0] * n[1]) if taken[0] and taken[1] else 1.0
    rows = training_rows(docs, marked, per_label).select("text", "toxic").toArrow()
    return fit(kernel.as_bytes(rows.column("text").combine_chunks()) if rows.num_rows else [], np.asarray(rows.column("toxic")), weight)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences and the highest sentence (its score and byte span; null without one)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("top_score", pa.float64()), ("top_start", pa.int64()), ("top_stop", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for piece, t in kernel.sub_batches(batches):
            b = bags(t)
            p = sentence_scores(b, m)
            # the highest sentence of each text, the first among equals
            order = np.lexsort((np.arange(len(p)), -p, b.text))
            some, at = np.unique(b.text[order], return_index=True)
            top = np.full(t.n, -1)
            top[some] = order[at]
            none = top < 0
            pick = lambda v: pa.array(v[top] if len(v) else np.zeros(t.n, v.dtype), mask=none)
            yield kernel.record(schema, piece.column("doc_id"), np.clip(noisy_or(b, p), 0, 1), np.bincount(b.text, minlength=t.n), pick(p), pick(b.start - t.start[b.text]), pick(b.stop - t.start[b.text]))

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, n_sentences long, top_score double, top_start long, top_stop long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns and the located sentence."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "top_score", "top_start", "top_stop")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows (all columns, in place) whose score is below ``threshold``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for piece, t in kernel.sub_batches(batches):
            b = bags(t)
            yield piece.filter(pa.array(noisy_or(b, sentence_scores(b, m)) < threshold))

    return docs.mapInArrow(run, docs.schema)
