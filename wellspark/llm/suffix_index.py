"""Suffix-array dedup: a logarithmic family of sampled suffix arrays.

Every batch (block) of documents gets a suffix array, sampled by minimisers: among the
``MINIMISER``-byte strings of every ``length``-byte window the one with the smallest hash is the
window's anchor, so equal windows have equal anchors wherever they occur.  The array's entries
are the runs of windows with one anchor, ordered by the anchor's hash and then by the hash of
the run's whole context - an order in which equal prefixes stand together, which is all that a
merge-scan needs, and which ships 17 bytes for about 85 suffixes instead of the suffixes.

The arrays are dealt by hash range.  In a range, each new batch's array enters a family of
levels (``LevelFamily``): equal-sized levels merge geometrically, and the merge-scan marks
entries whose context occurs elsewhere (all their windows are repeated) and entries whose
anchor occurs with other contexts.  The windows of the latter are looked at more closely: a
second family holds them in bins of ``BIN`` neighbours, by the bytes that all windows of a bin
share, and only for bins that are not settled there a third family holds single windows by
128-bit hash.  So every window is judged exactly, up to hash collisions (64 bits choose an anchor
and find a block's own entries, 128 bits compare blocks).

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; rows with
equal texts are copies of each other, whatever their ids, so repeated rows and ties lose the
same bytes; matches never cross documents; overlapping repeats count; an empty table gives no
rows; extra columns are ignored by ``digest`` and kept by ``cut_repeats``, whatever their names.
A very long text is held whole in one task (some 60 bytes a byte while its windows are hashed).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import blocks, kernel
from wellspark.llm.common import checkpointed

LENGTH = 200
MINIMISER = 32
BIN = 16
#: Window hashes are held for this much text at a time.
GROUP_BYTES = 256 << 10
REPEATED, MIXED, FIRST = 1, 2, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """The sampled suffix array of a batch: runs ``lo..hi`` of window starts with one anchor.

    Texts are taken in groups of about ``GROUP_BYTES``, so that the windows' hashes are held for one
    group (or one longer text) at a time; an anchor depends on its window's bytes alone.
    """

    def __init__(self, t: kernel.Texts, length: int) -> None:
        self.t, self.length, self.span = t, length, kernel.SpanHash(t.buf)
        group = (t.stop - t.start[0] if t.n else t.stop) // GROUP_BYTES
        cut = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), t.n]
        parts = [self._part(t.start[i:j], t.stop[i:j]) for i, j in zip(cut, cut[1:])]
        parts = [p for p in parts if len(p[0])] or [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
        self.lo, self.hi, self.place, self.anchor = (np.concatenate(x) for x in zip(*parts))
        self.context = self.span(self.lo, self.hi + length)

    def _part(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """lo, hi, place and anchor of the runs of some neighbouring texts."""
        k = min(MINIMISER, self.length)
        n_windows = np.maximum(stop - start - self.length + 1, 0)
        first = np.repeat(start, n_windows)
        at = first + np.arange(len(first)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        if not len(at):
            return at, at, at, np.empty(0, np.uint64)
        base = int(start[0])
        h = self.span.fixed(k, base, int(stop[-1]) - k + 1)
        m, p = h, np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64)
        width, have = self.length - k + 1, 1
        while have < width:  # of equal hashes the leftmost counts
            step = min(have, width - have)
            right = m[step:] < m[:-step]
            m, p = np.where(right, m[step:], m[:-step]), np.where(right, p[step:], p[:-step])
            have += step
        place = p[at - base].astype(np.int64)
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        ends = np.append(new[1:] - 1, len(at) - 1)
        place = place[new]
        return at[new], at[ends], place + base, kernel.mix(h[place])

    def bins(self, which: np.ndarray) -> "Bins":
        return Bins(self, which)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``lo`` to ``hi``, range after range, and the range of each."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), n)
    return np.repeat(lo, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


class Bins:
    """The windows of chosen runs in bins by their distance from the anchor, as runs of their own.

    The key of a bin is what all windows at its distances share, wherever the run begins or ends.
    """

    def __init__(self, runs: Runs, which: np.ndarray) -> None:
        self.t, self.length, self.span = runs.t, runs.length, runs.span
        place, lo, hi = runs.place[which], runs.lo[which], runs.hi[which]
        number, of = _spread((place - hi) // BIN, (place - lo) // BIN)
        near = place[of] - number * BIN  # the bin's last window start, if the run reaches that far
        self.lo, self.hi = np.maximum(lo[of], near - BIN + 1), np.minimum(hi[of], near)
        self.anchor = kernel.mix(self.span(near, near - BIN + 1 + runs.length) + number.astype(np.uint64))
        self.context = self.span(self.lo, self.hi + runs.length)


class LevelFamily:
    """Sorted levels of (key, second key, batch, mark); a level merges with one of its size or smaller."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, key: np.ndarray, second: np.ndarray, batch: int, mark: np.ndarray) -> None:
        """A new batch as a level of its own; its (key, second key) pairs are distinct."""
        if not len(key):
            return
        self.levels.append(self.scan([key, second, np.full(len(key), batch, np.int64), mark.astype(np.uint8)]))
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        self.levels.append(self.scan([np.concatenate(x) for x in zip(a, b)]))

    @staticmethod
    def scan(level: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Sort two levels into one and mark the entries that meet their like."""
        order = np.argsort(level[0], kind="stable")
        key, second, batch, mark = (x[order] for x in level)
        same = key[1:] == key[:-1]
        group = np.flatnonzero(np.append(True, ~same))
        if len(group) < len(key):  # inside a key, order by the second key and then by batch
            member = np.cumsum(np.append(True, ~same)) - 1
            big = np.flatnonzero(np.bincount(member)[member] > 1)
            inner = np.lexsort((batch[big], second[big], member[big]))
            for x in (second, batch, mark):
                x[big] = x[big][inner]
        equal = same & (second[1:] == second[:-1])
        mark[1:][equal] |= REPEATED
        mark[:-1][equal] |= REPEATED
        lowest, highest = np.minimum.reduceat(second, group), np.maximum.reduceat(second, group)
        n = np.diff(np.append(group, len(key)))
        mark[np.repeat(lowest != highest, n)] |= MIXED
        return key, second, batch, mark

    def finish(self) -> tuple[np.ndarray, ...]:
        """All levels as one; FIRST marks the first batch that holds an entry."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64), np.empty(0, np.uint8))
        key, second, batch, mark = self.levels[0]
        mark = mark.copy()
        mark[np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]))[: len(key)]] |= FIRST
        return key, second, batch, mark


def _unique(key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and REPEATED where a pair occurs twice."""
    order = np.lexsort((second, key))
    key, second = key[order], second[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]))[: len(key)])
    n = np.diff(np.append(new, len(key)))
    return key[new], second[new], np.where(n > 1, REPEATED, 0).astype(np.uint8)


def _send(block: int, key: np.ndarray, second: np.ndarray, n_ranges: int) -> list[tuple[int, int, bytes]]:
    key, second, mark = _unique(key, second)
    part = blocks.by_range(key, n_ranges)
    return [(int(p), block, raw) for p, raw in blocks.split_by_block(part, key, second, mark)]


def _family(batch: np.ndarray, payloads: list[bytes]) -> LevelFamily:
    family = LevelFamily()
    for k in np.argsort(batch, kind="stable"):
        key, second, mark = blocks.read_columns(payloads[k], "u8", "u8", "u1")
        family.add(key, second, int(batch[k]), mark)
    return family


def _answers(batch: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
    key, second, batch, mark = _family(batch, payloads).finish()
    some = (mark & (REPEATED | MIXED)) > 0
    return blocks.split_by_block(batch[some], key[some], second[some], mark[some])


def _summary(payloads: list[bytes]) -> bytes:
    """The distinct entries of several batches, those that repeat among them marked."""
    key, second, _, mark = _family(np.arange(len(payloads)), payloads).finish()
    one = (mark & FIRST) > 0
    return b"".join(x[one].tobytes() for x in (key, second, mark & np.uint8(REPEATED)))


def _told(batch: np.ndarray, payloads: list[bytes], answer: bytes) -> list[tuple[int, bytes]]:
    """The marks of a summary's entries for the batches that hold them; FIRST stays with one batch."""
    key, second, batch, mark = _family(batch, payloads).finish()
    known, known_second, known_mark = blocks.read_columns(answer, "u8", "u8", "u1")
    order = np.lexsort((known_second, known))
    entry = np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])).cumsum()[: len(key)] - 1
    first = np.flatnonzero(mark & FIRST)
    # both sides are in the order of (key, second key), and the answer's entries are among the summary's
    both = np.lexsort((np.append(np.zeros(len(first), np.int8), np.ones(len(known), np.int8)), np.append(second[first], known_second[order]), np.append(key[first], known[order])))
    hit = np.flatnonzero(both >= len(first))
    told = np.zeros(len(first), np.uint8)
    told[both[hit - 1]] = known_mark[order][both[hit] - len(first)]
    all_ = told[entry]
    new = (all_ & np.uint8(REPEATED | MIXED)) | (all_ & mark & np.uint8(FIRST))
    some = (new & (REPEATED | MIXED)) > 0
    return blocks.split_by_block(batch[some], key[some], second[some], new[some])


MERGE = blocks.Merge(_answers, _summary, _told)


def _pair(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    return kernel.mix(key + second * _MIX)


def _marks(key: np.ndarray, second: np.ndarray, answers: list[bytes] | None) -> np.ndarray:
    told, told_second, mark = blocks.stack_columns(answers, "u8", "u8", "u1")
    out = np.zeros(len(key), np.uint8)
    if len(told):
        known = _pair(told, told_second)
        order = np.argsort(known)
        asked = _pair(key, second)
        slot = np.minimum(np.searchsorted(known[order], asked), len(told) - 1)
        hit = known[order][slot] == asked
        out[hit] = mark[order][slot[hit]]
    return out


def _shown(key: np.ndarray, second: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Entries to be looked at more closely: mixed ones, of repeated contexts one in all blocks."""
    which = np.flatnonzero(((mark & MIXED) > 0) & (((mark & REPEATED) == 0) | ((mark & FIRST) > 0)))
    _, once = np.unique(_pair(key[which], second[which]), return_index=True)
    return which[once]


def _window_hashes(runs: Runs | Bins, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs.span(at, at + runs.length), kernel.SpanHash(runs.t.buf, 1)(at, at + runs.length)


def _texts(table: pa.Table) -> kernel.Texts:
    return kernel.Texts(kernel.as_bytes(table.column("text").combine_chunks()) if table.num_rows else [])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def removed_bytes(runs: Runs, run_answers: list[bytes] | None, bin_answers: list[bytes] | None, window_answers: list[bytes] | None) -> np.ndarray:
    """True for each byte of the batch's buffer that a repeated window covers."""
    change = np.zeros(len(runs.t.buf) + runs.length + 1, np.int64)

    def settle(level: Runs | Bins, mark: np.ndarray) -> np.ndarray:
        """Covers repeated entries; gives the entries that stay open."""
        whole = (mark & REPEATED) > 0
        np.add.at(change, level.lo[whole], 1)
        np.add.at(change, level.hi[whole] + runs.length, -1)
        return np.flatnonzero(~whole & ((mark & MIXED) > 0))

    open_ = settle(runs, _marks(runs.anchor, runs.context, run_answers))
    bins = runs.bins(open_)
    open_ = settle(bins, _marks(bins.anchor, bins.context, bin_answers))
    first, second, _ = blocks.stack_columns(window_answers, "u8", "u8", "u1")
    if len(open_) and len(first):
        at, _ = _spread(bins.lo[open_], bins.hi[open_])
        at = at[np.isin(_pair(*_window_hashes(runs, at)), _pair(first, second))]
        np.add.at(change, at, 1)
        np.add.at(change, at + runs.length, -1)
    return np.cumsum(change)[: len(runs.t.buf)] > 0


def _apply(docs: DataFrame, length: int, schema: str | object, emit: Callable[[pa.Table, kernel.Texts, np.ndarray], list[pa.RecordBatch]]) -> DataFrame:
    """The whole operator: blocks, the families over runs, bins and windows, and ``emit`` per block."""
    packed, n_ranges = blocks.packed_blocks(docs)
    sent = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])

    def record(block: int, key: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        out = _send(block, key, second, n_ranges)
        return kernel.record(sent, *([x[i] for x in out] for i in range(3)))

    def send_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            runs = Runs(_texts(blocks.unpack(row["payload"])), length)
            yield record(row["block"], runs.anchor, runs.context)

    def shown_bins(row: dict) -> Bins:
        runs = Runs(_texts(blocks.unpack(row["payload"])), length)
        return runs.bins(_shown(runs.anchor, runs.context, _marks(runs.anchor, runs.context, row["run_answers"])))

    def send_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["run_answers"]:
                bins = shown_bins(row)
                yield record(row["block"], bins.anchor, bins.context)

    def send_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["bin_answers"]:
                bins = shown_bins(row)
                which = _shown(bins.anchor, bins.context, _marks(bins.anchor, bins.context, row["bin_answers"]))
                at, _ = _spread(bins.lo[which], bins.hi[which])
                yield record(row["block"], *_window_hashes(bins, at))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            table = blocks.unpack(row["payload"])
            t = _texts(table)
            gone = removed_bytes(Runs(t, length), row["run_answers"], row["bin_answers"], row["window_answers"])
            yield from emit(table, t, gone)

    told = packed
    for send, name in ((send_runs, "run_answers"), (send_bins, "bin_answers"), (send_windows, "window_answers")):
        answers = blocks.exchange_ranges(told.mapInArrow(send, "part long, block long, payload binary"), MERGE, n_ranges)
        told = told.join(checkpointed(answers).withColumnRenamed("answers", name), "block", "left")
    return told.mapInArrow(finish, schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def emit(table: pa.Table, t: kernel.Texts, gone: np.ndarray) -> list[pa.RecordBatch]:
        start = np.diff(gone.view(np.int8), prepend=0) == 1
        kept = [hashlib.sha256(t.buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(t.start, t.stop)]
        return [kernel.record(schema, table.column("doc_id").combine_chunks(), t.stop - t.start, t.sums(gone), t.sums(start), kept)]

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return _apply(slim, length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", emit)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with ``text`` without its repeated bytes (and ``n_chars`` counted anew where it exists).

    A letter that loses some of its bytes is dropped; a null text stays null.
    """
    names = docs.columns
    target = docs.schema

    def emit(table: pa.Table, t: kernel.Texts, gone: np.ndarray) -> list[pa.RecordBatch]:
        null = table.column("text").is_null().to_pylist()
        texts = [None if z else t.buf[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b, z in zip(t.start, t.stop, null)]
        table = table.set_column(names.index("text"), table.schema.field("text"), pa.array(texts, table.schema.field("text").type))
        if "n_chars" in names and pa.types.is_integer(table.schema.field("n_chars").type):
            was = table.column("n_chars").to_pylist()
            table = table.set_column(names.index("n_chars"), table.schema.field("n_chars"), pa.array([w if x is None else len(x) for w, x in zip(was, texts)], table.schema.field("n_chars").type))
        return table.combine_chunks().to_batches()

    return _apply(docs, length, target, emit)
