"""Quality rules: base counts of every text, and the cross-document line-frequency verdict.

Lines are normalised (ASCII lower case, runs of separators as one space, ends trimmed) and
hashed; the distinct documents that hold a line are counted per host (``source`` here).  A
line above both limits (``min_docs`` documents and ``max_share`` of the host's documents) is
boilerplate and is removed; a document that keeps less than ``min_left`` of its words is
depleted and rejected.

Defined cases: a null text has no words and fails the base rule; a null host is a host of
its own; every row counts as a document, repeated ids included; rows with equal id, host
and text get equal results; an empty table gives no rows.  Extra columns are ignored.
A very long text is measured whole in one task (some 80 bytes a byte).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel
from wellspark.llm.common import checkpointed

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("lines", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))])


def _lines(t: kernel.Texts, w: kernel.Words) -> tuple[np.ndarray, ...]:
    """Per line with a word: its text, its raw hash, its first and one past its last word."""
    end = np.flatnonzero(t.buf == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    some = first < last
    start, end, first, last = start[some], end[some], first[some], last[some]
    return w.text[first], kernel.SpanHash(t.buf)(start, end) + (end - start).astype(np.uint64), first, last


def _measure(t: kernel.Texts) -> list:
    w = t.words()
    letters = ((t.buf & 0xC0) != 0x80) & ~w.separator
    text, raw, first, last = _lines(t, w)
    own = kernel.mix(raw + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(own, return_index=True)
    n_lines = np.bincount(text, minlength=t.n)
    dup_lines = n_lines - np.bincount(text[at], minlength=t.n)

    h, at = kernel.windows(w, 3)
    h = kernel.mix(h + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    cover = np.zeros(len(w.hash) + 3, np.int64)
    for k in range(3):
        cover[twice + k] = 1
    total = np.concatenate([[0], np.cumsum(cover)])
    repeat = total[w.last] - total[w.first]

    # a normalised line is its words in lower case: their hashes, summed in order
    low = kernel.SpanHash(kernel.LOWER[t.buf])(w.start, w.stop)
    place = np.arange(len(low)) - np.repeat(first, last - first) if len(low) else np.empty(0, np.int64)
    keyed = kernel.mix(low + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    line = kernel.mix(np.add.reduceat(keyed, first)) if len(first) else np.empty(0, np.uint64)
    # one entry per distinct line of a text, with all its words there
    own = kernel.mix(line + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, inverse = np.unique(own, return_index=True, return_inverse=True)
    n_in = np.bincount(inverse, weights=(last - first), minlength=len(at)).astype(np.int64)
    order = np.argsort(text[at], kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=t.n))]).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(line[at][order].view(np.int64)), pa.array(n_in[order])], names=["h", "w"])
    return [w.count, t.sums(letters), t.sums(_SYMBOL[t.buf]), dup_lines, repeat, pa.ListArray.from_arrays(pa.array(offsets), entries)]


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the text's 64-bit hash, the base counts and ``lines array<struct<h, w>>``."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), *_SCHEMA])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in kernel.sub_batches(batches):
            yield kernel.record(schema, *(piece.column(k) for k in range(3)), *_measure(texts))

    return slim.mapInArrow(run, f"doc_id long, host string, text_hash long, {_BASE}, lines array<struct<h: long, w: long>>")


def line_verdicts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The contract's columns, ``n_left`` (words outside boilerplate lines) and ``kept``.

    Shuffles: one row per distinct line and task for the counts, then only the entries of
    boilerplate lines.  A hot line is combined before the shuffle, and the join that finds its
    documents has plain exchanges on both sides, so that adaptive execution splits it.
    """
    rows = checkpointed(measure(docs, host))
    key = ["doc_id", "host", "text_hash"]
    entries = rows.select(*key, F.explode("lines").alias("e")).select(*key, F.col("e.h").alias("line"), F.col("e.w").alias("w"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = entries.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    heavy = checkpointed(
        counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
        .filter(F.col("n_docs") > max_share * F.col("host_docs")).select(F.col("c.host").alias("heavy_host"), F.col("line").alias("heavy_line"))
    )
    hit = entries.join(heavy, (F.col("line") == F.col("heavy_line")) & F.col("host").eqNullSafe(F.col("heavy_host")))
    removed = hit.groupBy(*key, "line").agg(F.max("w").alias("w")).groupBy(*key).agg(F.sum("w").alias("n_removed"))
    removed = removed.select(*(F.col(k).alias(f"r_{k}") for k in key), "n_removed")
    base = rows.drop("lines")
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
    out = base.join(removed, same[0] & same[1] & same[2], "left").withColumn("n_left", F.col("n_words") - F.coalesce(F.col("n_removed"), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_left") >= min_left * F.col("n_words"))).alias("kept"), F.col("n_left").cast("long").alias("n_left"),
    )


#: The same rows by plain SQL over whole texts (words and lines as text instead of hashes).
SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) AS t(k) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
lines AS (SELECT rid, host, line, len(ws) AS n, array_to_string(list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS norm FROM lw WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
heavy AS (SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT rid) >= 20 AND count(DISTINCT rid) > 0.02 * (SELECT count(*) FROM d WHERE d.host IS NOT DISTINCT FROM lines.host)),
gone AS (SELECT rid, sum(n) AS n FROM lines WHERE EXISTS (SELECT 1 FROM heavy h WHERE h.norm = lines.norm AND h.host IS NOT DISTINCT FROM lines.host) GROUP BY rid),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS n_left
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.5 * n_words AS kept, n_left FROM r
"""
