"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every test item's word ``SEED``-grams are seeds, all of them and not the rarest only: which ones
survive in an edited copy can't be told from how many documents hold them.  One pass joins
passages to items by the seeds (in each task, against a table bounded by ``BLOCK_BYTES`` of test
text; a larger benchmark is read in blocks that don't influence each other).  A positive local
alignment spans less than three times the item's words, so the words that far around a seed
are its passage; passages that touch are one.  Each is scored by local alignment over words; a
common phrase costs a count of common words before any alignment.  A passage with ``identity``
(aligned equal words over the item's words) of ``MIN_IDENTITY`` or more, counted on the best local
alignment (the highest score, then the most equal words), is a leak.

``seed`` is the length of a seed.  With 1 every document that shares any word takes part, which
loses no leak; the default misses a copy in which no three consecutive words survive.

Words are compared in ASCII lower case without marks around them.  Defined cases: null or
wordless texts and items take no part; items shorter than ``seed`` words are one seed as a whole;
equal items each report, and so do repeated rows; of equal alignments a text's first place per
item is reported; an empty table of documents or items gives no leak; extra columns are ignored by
``leaks`` and kept by ``reject_leaks``, whatever their names; a very long text costs about 100
bytes a word beside itself.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel

SEED = 3
MIN_IDENTITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bound of the test text that one pass broadcasts.
BLOCK_BYTES = 4 << 20


@dataclasses.dataclass
class Items:
    """A block of test items: words, and the seeds (sorted); seed ``s`` is held by ``holder[first[s]:first[s + 1]]``."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    holder: np.ndarray
    n_words: int


def build(ids: list[int], texts: list[str], seed: int = SEED) -> Items:
    words, hashes, holder = [], [], []
    for k, text in enumerate(texts):
        w = kernel.Texts([(text or "").encode()]).words(lower=True, trimmed=True)
        words.append(w.hash)
        h = np.unique(kernel.windows(w, min(seed, max(1, len(w.hash))))[0])
        hashes.append(h)
        holder.append(np.full(len(h), k))
    h, k = np.concatenate(hashes), np.concatenate(holder)
    order = np.argsort(h, kind="stable")
    seeds, first = np.unique(h[order], return_index=True)
    return Items(ids, words, seeds, np.append(first, len(h)), k[order], seed)


def _find(t: kernel.Texts, items: Items) -> tuple[kernel.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch, and the distinct (text, item, first word) of all seeds that its texts hold, ascending."""
    w = t.words(lower=True, trimmed=True)
    place, seed = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in sorted({min(items.n_words, len(x)) for x in items.words if len(x)}):
        h, at = kernel.windows(w, n)
        slot = np.minimum(np.searchsorted(items.seeds, h), len(items.seeds) - 1)
        hit = np.flatnonzero(items.seeds[slot] == h)
        place.append(at[hit])
        seed.append(slot[hit])
    place, seed = np.concatenate(place), np.concatenate(seed)
    n = items.first[seed + 1] - items.first[seed] if len(seed) else seed
    item = items.holder[np.repeat(items.first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(seed) else seed
    place = np.repeat(place, n)
    text = w.text[place]
    order = np.lexsort((place, item, text))
    return w, text[order], item[order], place[order]


def smith_waterman(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """(score, equal words, first, one past the last text word) of the best local alignment.

    Best is the highest score, then the most equal words, then the first end in the text.  A row
    of the table is one item word against the whole text; the gaps along a row are a running
    maximum.  A cell holds score and equal words in one number.
    """
    n = len(text)
    unit = 1 << 24
    j = np.arange(n + 1, dtype=np.int64)
    value, first = np.zeros(n + 1, np.int64), j.copy()
    best = (0, 0, 0)
    for x in item:
        match = text == x
        fresh = value[:-1] == 0
        diagonal = value[:-1] + np.where(match, MATCH * unit + 1, MISMATCH * unit)
        up = value[1:] + GAP * unit
        from_up = up > diagonal
        row, start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        row[0], start[0] = 0, 0
        row[1:] = np.where(from_up, up, diagonal)
        start[1:] = np.where(from_up, first[1:], np.where(fresh, j[:-1], first[:-1]))
        dead = row < unit  # a score of 0 or less starts anew
        row[dead], start[dead] = 0, j[dead]
        level = row - j * (GAP * unit)  # a gap of k text words costs k
        run = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= run, j, 0))
        value = run + j * (GAP * unit)
        first = start[source]
        dead = value < unit
        value[dead], first[dead] = 0, j[dead]
        at = int(value.argmax())
        if (value[at], -at) > (best[0], -best[2]):
            best = (int(value[at]), int(first[at]), at)
    return best[0] // unit, best[0] % unit, best[1], best[2]


def best_passage(words: np.ndarray, places: np.ndarray, item: np.ndarray, min_identity: float) -> tuple[int, int, int, int] | None:
    """Align ``item`` with the passages around ``places`` (ascending); one with too few of its words in common can't reach the limit."""
    reach = 3 * len(item)
    cut = [0, *(np.flatnonzero(np.diff(places) > 2 * reach) + 1).tolist(), len(places)]
    kind, count = np.unique(item, return_counts=True)
    best = None
    for i, j in zip(cut, cut[1:]):
        a, b = max(0, int(places[i]) - reach), min(len(words), int(places[j - 1]) + reach + 1)
        part = words[a:b]
        slot = np.minimum(np.searchsorted(kind, part), len(kind) - 1)
        held = np.bincount(slot[kind[slot] == part], minlength=len(kind))
        if np.minimum(held, count).sum() < min_identity * len(item):
            continue
        score, equal, first, end = smith_waterman(part, item)
        if equal >= min_identity * len(item) and (best is None or (score, equal) > best[:2]):
            best = (score, equal, a + first, a + end)
    return best


def leaks_of(t: kernel.Texts, items: Items, min_identity: float) -> list[tuple]:
    """(text, item id, score, identity, first word, one past the last) of a batch."""
    if not len(items.seeds):
        return []
    w, text, item, place = _find(t, items)
    cut = [*np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)).tolist(), len(text)]
    out = []
    for i, j in zip(cut, cut[1:]):
        d, body = int(text[i]), items.words[item[i]]
        first = int(w.first[d])
        found = best_passage(w.hash[first : int(w.last[d])], place[i:j] - first, body, min_identity)
        if found:
            score, equal, start, end = found
            out.append((d, items.ids[item[i]], score / (MATCH * len(body)), equal / len(body), start, end))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, seed: int = SEED) -> Iterator[Items]:
    """The test items in blocks of bounded size, one after the other."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].encode())
        if size >= block_bytes:
            yield build(ids, texts, seed)
            ids, texts, size = [], [], 0
    if ids:
        yield build(ids, texts, seed)


def leaks(docs: DataFrame, benchmark: DataFrame, min_identity: float = MIN_IDENTITY, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, identity, start_word, end_word for each document and item that it leaks."""
    kind = "doc_id long, item_id long, score double, identity double, start_word long, end_word long"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("identity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], kind)
    for block in item_blocks(benchmark, block_bytes, seed):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for piece, t in kernel.sub_batches(batches):
                ids = piece.column("doc_id").to_pylist()
                rows = leaks_of(t, shared.value, min_identity)
                yield kernel.record(schema, [ids[r[0]] for r in rows], *([r[k] for r in rows] for k in range(1, 6)))

        out = out.unionAll(slim.mapInArrow(run, kind))
    return out


def reject_leaks(docs: DataFrame, benchmark: DataFrame, min_identity: float = MIN_IDENTITY, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows (all columns, in place) that leak no item; no shuffle."""
    for block in item_blocks(benchmark, block_bytes, seed):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for piece, t in kernel.sub_batches(batches):
                keep = np.ones(t.n, bool)
                keep[[r[0] for r in leaks_of(t, shared.value, min_identity)]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
