"""Vectorised byte kernels shared by the text operators.

A batch of texts is one byte buffer, every text followed by one newline.  Word
boundaries, span hashes and per-text sums are numpy operations over that buffer, so
the Python cost is per batch and not per word.

Defined cases: a null text counts as an empty one; the separators are the bytes
``0x20`` and ``0x09-0x0D``, which never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SUB_BATCH_BYTES = 1 << 20
STEP_BITS = 16
STEP = 1 << STEP_BITS

_rng = np.random.default_rng(0x5EED)
_TABLES = [_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 2, dtype=np.uint64)]
_INVERSES = [pow(b, -1, 2**64) for b in _BASES]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()[]|*#$%&<>")] = True


def trim(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without up to four marks on either side; a word of marks only becomes empty."""
    a, b = start.copy(), stop.copy()
    for _ in range(4):
        a += _MARK[buf[np.minimum(a, len(buf) - 1)]] & (a < b)
        b -= _MARK[buf[np.maximum(b - 1, 0)]] & (a < b)
    return a, b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse up to ``STEP``; longer buffers multiply by powers of ``base ** STEP``."""
    out = []
    for base in (_BASES[which], _INVERSES[which]):
        x = np.full(STEP, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class SpanHash:
    """Polynomial prefix sums over a byte buffer: the hash of any span in O(1).

    Memory is 8 bytes for each byte of the buffer; the tables of powers are of a fixed size.
    """

    def __init__(self, buf: np.ndarray, which: int = 0) -> None:
        n = len(buf)
        forward, self._low = _powers(which)
        n_steps = n // STEP + 1
        self._high = np.cumprod(np.array([1] + [pow(_INVERSES[which], STEP, 2**64)] * (n_steps - 1), np.uint64))
        self._sums = np.zeros(n + 1, np.uint64)
        for k in range(n_steps):
            a, b = k * STEP, min(n, (k + 1) * STEP)
            part = _TABLES[which][buf[a:b]]
            part *= forward[: b - a]
            part *= np.uint64(pow(_BASES[which], a, 2**64))
            np.cumsum(part, out=self._sums[a + 1 : b + 1])
            self._sums[a + 1 : b + 1] += self._sums[a]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self._sums[end] - self._sums[start]
        h *= self._low[start & (STEP - 1)]
        h *= self._high[start >> STEP_BITS]
        return mix(h)

    def fixed(self, length: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of all spans of one length that start from ``first`` up to ``last``, by start."""
        last = max(first, min(len(self._sums) - length, len(self._sums) if last is None else last))
        h = self._sums[first + length : last + length] - self._sums[first:last]
        for a in range(first - first % STEP, last, STEP):
            i, j = max(a, first), min(a + STEP, last)
            h[i - first : j - first] *= self._low[i - a : j - a]
            h[i - first : j - first] *= self._high[a >> STEP_BITS]
        return mix(h)


class Texts:
    """A batch of UTF-8 texts as one buffer; ``start[i]:stop[i]`` is text ``i``."""

    def __init__(self, texts: list[bytes | None]) -> None:
        texts = [t or b"" for t in texts]
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if self.n else size
        self.stop = self.start + size

    def words(self, *, lower: bool = False, trimmed: bool = False) -> "Words":
        return Words(self, lower, trimmed)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.stop] - total[self.start]


class Words:
    """The words of a batch in order: byte spans, hashes, owning text, and each text's range."""

    def __init__(self, texts: Texts, lower: bool = False, trimmed: bool = False) -> None:
        sep = _SEPARATOR[texts.buf]
        self.separator = sep
        edge = np.flatnonzero(np.diff(np.concatenate([[True], sep]).view(np.int8)))
        self.start, self.stop = edge[0::2], edge[1::2]
        buf = LOWER[texts.buf] if lower else texts.buf
        self.hash = SpanHash(buf)(*(trim(buf, self.start, self.stop) if trimmed else (self.start, self.stop)))
        self.first = np.searchsorted(self.start, texts.start)
        self.last = np.searchsorted(self.start, texts.stop)
        self.count = self.last - self.first
        self.text = np.repeat(np.arange(texts.n), self.count)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word windows inside one text, and the index of their first word."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(words.text[:m] == words.text[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[at + k])
    return h, at


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``SUB_BATCH_BYTES`` of text each, so that memory
    follows the longest text and not the batch size of the session."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).astype(np.int64)
        part = np.cumsum(size) // SUB_BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def sub_batches(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The ``slices`` with their texts."""
    for piece in slices(batches, text):
        yield piece, Texts(as_bytes(piece.column(text)))


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
