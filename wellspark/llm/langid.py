"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public piece model and stays fixed.  Per language, expectation
maximisation over all segmentations learns a probability for each piece; a text's score is
the sum over its words of the log of the word's probability summed over all segmentations
(the forward algorithm), and the language with the highest sum wins.

The fit uses a bounded sample of rows (about ``PER_LANG`` of each language) with all their words,
of any length, whether the script has spaces or not; what is broadcast is a table of pieces x
languages.  Scoring is one narrow pass over whole texts; words repeat, so their scores are
remembered in a table that is bounded and emptied when full, which changes no result.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a null
``lang`` are not learned from; without any learned language every row is ``und``; of languages
that tie the first in alphabetical order wins; repeated rows get equal results; an empty table
gives no rows; extra columns are ignored, whatever their names.  A very long text is scored whole;
a word costs some 100 bytes a byte and language.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel
from wellspark.llm.common import held_out

#: Bound of the training sample: about so many rows of each language.
PER_LANG = 400
ROUNDS = 4
SMOOTH = 0.05
MEMORY_WORDS = 1_000_000
#: Words of about this many bytes times languages make one lattice.
LATTICE_BYTES = 1 << 20
#: Forward values are multiplied by this per byte, so that they stay near 1.
LIFT = 20.0
_LETTER = regex.compile(r"\p{L}")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted piece hashes, their piece numbers, a filter by the hash's low bits, the longest piece in bytes.

    The word-start sign is a space; control, unknown and single-byte pieces are left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i).replace("▁", " ") for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    raw = sorted({n.encode() for n in names if n.strip(" ") or n == " "})
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    stop = np.cumsum(size)
    h = kernel.SpanHash(buf)(stop - size, stop) + size.astype(np.uint64)
    order = np.argsort(h)
    maybe = np.zeros(1 << 20, bool)
    maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return h[order], order, maybe, int(size.max())


class Lattice:
    """All piece matches inside a list of distinct words, as flat arrays ready for forward passes.

    Where no match crosses a place, every segmentation cuts there.  The stretches between such places
    (units) are therefore summed on their own, and their products give the words.
    """

    def __init__(self, words: list[bytes], path: str) -> None:
        hashes, number, maybe, longest = vocabulary(path)
        words = [b" " + w for w in words]
        self.n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(size)
        left = np.repeat(stop, size) - np.arange(len(buf))  # bytes until the word's end
        head = (buf & 0xC0) != 0x80
        width = np.select([buf < 0x80, buf < 0xE0, buf < 0xF0], [1, 2, 3], 4)
        span = kernel.SpanHash(buf)
        at = np.flatnonzero(head)
        single = np.zeros(len(buf), bool)
        found = []
        for k in range(1, min(longest, int(size.max()) if self.n else 0) + 1):
            at = at[left[at] >= k]
            h = span(at, at + k) + np.uint64(k)
            near = np.flatnonzero(maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            slot = np.searchsorted(hashes, h[near])
            slot[slot == len(hashes)] = 0
            hit = hashes[slot] == h[near]
            p, s = at[near[hit]], number[slot[hit]]
            single[p[width[p] == k]] = True
            found.append((p, np.full(len(p), k), s))
        lone = np.flatnonzero(head & ~single)  # a letter that is no piece: an unknown of its own
        found.append((lone, np.minimum(width[lone], left[lone]), np.full(len(lone), len(hashes))))
        p, k, s = (np.concatenate(x) for x in zip(*found))
        inside = np.cumsum(np.bincount(p + 1, minlength=len(buf) + 2) - np.bincount(p + k, minlength=len(buf) + 2))[: len(buf)]
        begins = inside == 0
        begin = np.flatnonzero(begins)
        unit = np.cumsum(begins) - 1
        self.size = np.diff(np.append(begin, len(buf)))
        self.word = np.searchsorted(stop, begin, side="right")
        self.cell = begin + np.arange(len(begin))  # each unit has size + 1 cells
        self.longest_first = np.argsort(-self.size, kind="stable")
        src = p + unit[p]
        offset = p - begin[unit[p]] + k  # end position in its unit: the forward step that uses it
        order = np.lexsort((src + k, offset))
        self.src, self.width, self.piece, self.unit = src[order], k[order], s[order], unit[p][order]
        self.dst = self.src + self.width
        self.step = np.searchsorted(offset[order], np.arange((int(self.size.max()) if len(begin) else 0) + 2))
        self.group = np.flatnonzero(np.diff(self.dst, prepend=-1))  # edges into the same cell stand together
        self.group_step = np.searchsorted(self.group, self.step)

    def units(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each unit per language: ``prob`` is pieces + 1 x languages."""
        a = np.zeros((int(self.size.sum()) + len(self.size), prob.shape[1]))
        a[self.cell] = 1
        scale = np.zeros((len(self.size), 1))
        edge = prob[self.piece] * (LIFT**self.width)[:, None]
        shorter = np.sort(-self.size)
        for j in range(1, len(self.step) - 1):
            e = slice(self.step[j], self.step[j + 1])
            if e.start < e.stop:
                first = self.group[self.group_step[j] : self.group_step[j + 1]]
                a[self.dst[first]] = np.add.reduceat(a[self.src[e]] * edge[e], first - e.start, axis=0)
            if j % 8 == 0:  # long units: bring the cells that are still used back to about 1
                live = self.longest_first[: np.searchsorted(shorter, -j)]
                top = np.max([a[self.cell[live] + j - back].max(1) for back in range(4)], axis=0)[:, None]
                top = np.where(top > 0, top, 1.0)
                scale[live] += np.log(top)
                for back in range(min(j, 64) + 1):
                    a[self.cell[live] + j - back] /= top
        return np.log(np.maximum(a[self.cell + self.size], 1e-250)) + scale - (self.size * np.log(LIFT))[:, None]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each word per language."""
        logs = self.units(prob)
        return np.stack([np.bincount(self.word, weights=logs[:, k], minlength=self.n) for k in range(prob.shape[1])], axis=1)

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts per language, for words that occur ``counts`` times.

        A unit's edges are lifted by its own probability per byte, so that its cells stay near 1.
        """
        logs = self.units(prob)
        cells = int(self.size.sum()) + len(self.size)
        a, b = np.zeros((cells, prob.shape[1])), np.zeros((cells, prob.shape[1]))
        a[self.cell] = 1
        end = self.cell + self.size
        b[end] = 1
        edge = prob[self.piece] * np.exp(-(logs / self.size[:, None])[self.unit] * self.width[:, None])
        for j in range(1, len(self.step) - 1):
            e = slice(self.step[j], self.step[j + 1])
            np.add.at(a, self.dst[e], a[self.src[e]] * edge[e])
        for j in range(len(self.step) - 2, 0, -1):
            e = slice(self.step[j], self.step[j + 1])
            np.add.at(b, self.src[e], b[self.dst[e]] * edge[e])
        share = counts[self.word] / np.maximum(a[end], 1e-250)
        out = np.zeros(prob.shape)
        np.add.at(out, self.piece, a[self.src] * edge * b[self.dst] * share[self.unit])
        return out


def lattices(words: list[bytes], path: str, langs: int) -> Iterator[tuple[slice, Lattice]]:
    """Lattices of bounded size (or of one longer word) over the words, one at a time."""
    a, size = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size * langs >= LATTICE_BYTES or k == len(words) - 1:
            yield slice(a, k + 1), Lattice(words[a : k + 1], path)
            a, size = k + 1, 0


@dataclasses.dataclass
class Model:
    langs: list[str]
    prob: np.ndarray
    path: str


def _spaced(texts: list[str | None]) -> kernel.Texts:
    return kernel.Texts([(t or "").lower().encode() for t in texts])


def fit(texts: list[str | None], langs: list[str], path: str) -> Model:
    """Expectation maximisation from equal probabilities; deterministic."""
    names = sorted(set(langs))
    pieces = len(vocabulary(path)[0])
    prob = np.full((pieces + 1, max(1, len(names))), 1 / (pieces + 1))
    counts: dict[bytes, list[int]] = {}
    for text, lang in zip(texts, langs):
        k = names.index(lang)
        for w in (text or "").lower().encode().split():
            counts.setdefault(w, [0] * len(names))[k] += 1
    words = sorted(counts)
    if not words:
        return Model(names, prob, path)
    n = np.array([counts[w] for w in words], float)
    for _ in range(ROUNDS):
        c = SMOOTH + sum(lattice.expected(prob, n[part]) for part, lattice in lattices(words, path, len(names)))
        prob = c / c.sum(0)
    return Model(names, prob, path)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """text, lang of about ``per_lang`` rows of each language outside the held-out fifth, chosen by a hash."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    part = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(F.broadcast(n), "lang").filter(part < per_lang / F.col("n"))
    return sample.orderBy("h", "lang", "text").select("lang", "text")


def train(docs: DataFrame, path: str, per_lang: int = PER_LANG) -> Model:
    rows = training_rows(docs, per_lang).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), path)


class Memory:
    """Word hash -> scores per language: a sorted table, and recent additions that are merged geometrically."""

    def __init__(self, langs: int) -> None:
        self.langs = langs
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.empty(0, np.uint64), np.empty((0, self.langs), np.float32))]

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, known = np.zeros((len(h), self.langs), np.float32), np.zeros(len(h), bool)
        for keys, values in self.tables:
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[slot] == h
                out[hit], known = values[slot[hit]], known | hit
        return out, known

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        if sum(len(k) for k, _ in self.tables) + len(h) > MEMORY_WORDS:
            self.clear()
        order = np.argsort(h)
        self.tables.append((h[order], values[order].astype(np.float32)))
        while len(self.tables) > 1 and 2 * len(self.tables[-1][0]) >= len(self.tables[-2][0]):
            (k2, v2), (k1, v1) = self.tables.pop(), self.tables.pop()
            keys = np.concatenate([k1, k2])
            order = np.argsort(keys)
            self.tables.append((keys[order], np.concatenate([v1, v2])[order]))


def text_scores(t: kernel.Texts, model: Model, memory: Memory) -> np.ndarray:
    """Log probability of every text per language."""
    w = t.words()
    h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    scores, known = memory.get(h)
    new = np.flatnonzero(~known)
    raw = t.buf.tobytes()
    words = [raw[a:b] for a, b in zip(w.start[first[new]], w.stop[first[new]])]
    for part, lattice in lattices(words, model.path, scores.shape[1]):
        made = lattice.forward(model.prob)
        scores[new[part]] = made
        memory.add(h[new[part]], made)
    total = np.zeros((t.n, scores.shape[1]))
    for k in range(total.shape[1]):
        total[:, k] = np.bincount(w.text, weights=scores[inverse, k], minlength=t.n)
    return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the language under equal priors)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prob, model.path))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        memory = Memory(m.prob.shape[1])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < kernel.SUB_BATCH_BYTES):
                    size += len(texts[b] or "")
                    b += 1
                score = text_scores(_spaced(texts[a:b]), m, memory)
                score -= score.max(1, keepdims=True)
                best = score.argmax(1)
                p = 1 / np.exp(score).sum(1)
                blank = [not m.langs or x is None or not _LETTER.search(x) for x in texts[a:b]]
                yield kernel.record(
                    schema, batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                    ["und" if z else m.langs[k] for z, k in zip(blank, best)], np.where(blank, 0.0, p),
                )
                a = b

    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
