"""Blocks of documents: the batches of the index operators.

Each task packs its rows into blocks of about ``BLOCK_BYTES`` of text, and a block is kept as one
compressed Arrow table in a checkpoint, which also fixes its number.  Later passes join small
per-block results to it without moving it again.  What blocks send to each other is
packed: one row per block and hash range, already unique inside the block, so a passage held
by a third of all rows counts once per block.  From ``GROUP_BLOCKS`` blocks on a range is merged in
two steps, groups of blocks first, so that one which all blocks hold is gathered nowhere whole.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.common import checkpointed_by, text_bytes

#: Small enough that a packed block is no outsized object of the JVM's heap.
BLOCK_BYTES = 1 << 20
#: A hash range stands for about this much text.
RANGE_BYTES = 16 << 20
#: Blocks whose payloads of one range meet in one task; an entry that all of them hold takes 1 MB there.
GROUP_BLOCKS = 1 << 16
#: A partition of the checkpoint holds blocks of about this much text.
PARTITION_BYTES = 32 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def pack(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def packed_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block long, payload binary) in a checkpoint, and the number of hash ranges for exchanges.

    An empty table makes no block.
    """
    total = text_bytes(docs)
    n_ranges = max(16, -(-total // RANGE_BYTES))
    schema = pa.schema([("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size_of = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)).astype(np.int64) + 16
            at = 0
            while at < batch.num_rows:  # as many rows as fill the block
                n = int(np.searchsorted(np.cumsum(size_of[at:]), BLOCK_BYTES - size)) + 1
                part = batch.slice(at, n)
                held.append(part)
                size += int(size_of[at : at + n].sum())
                at += part.num_rows
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(pa.Table.from_batches(held))], pa.binary())], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(pa.Table.from_batches(held))], pa.binary())], schema=schema)

    blocked = docs.mapInArrow(run, "payload binary").select(F.monotonically_increasing_id().alias("block"), "payload")
    return checkpointed_by(blocked, "block", -(-total // PARTITION_BYTES)), n_ranges


def by_range(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """The range of each 64-bit hash, by its high half."""
    return ((h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


class Merge(NamedTuple):
    """How the payloads of a range are merged.

    ``answers(blocks, payloads)`` gives (block, payload) for each block that has something to hear.
    ``summary(payloads)`` is one payload that stands for all of them, and ``told(blocks, payloads,
    answer)`` hands the answer to a summary on to its blocks.
    """

    answers: Callable[[np.ndarray, list[bytes]], list[tuple[int, bytes]]]
    summary: Callable[[list[bytes]], bytes]
    told: Callable[[np.ndarray, list[bytes], bytes], list[tuple[int, bytes]]]


def exchange_ranges(sent: DataFrame, merge: Merge, n_ranges: int) -> DataFrame:
    """``sent`` (part, block, payload) by range through ``merge``: (block, answers array<binary>).

    With more than ``GROUP_BLOCKS`` blocks, groups of blocks are summed up first, the summaries of a
    range are merged, and their answers go back through the groups; the answers are the same.
    """
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    n_groups = -(-n_ranges * RANGE_BYTES // (GROUP_BLOCKS * BLOCK_BYTES))

    def record(found: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table([[b for b, _ in found], [p for _, p in found]], schema=schema)

    def columns(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        return np.asarray(table.column("block")), table.column("payload").to_pylist()

    def run(table: pa.Table) -> pa.Table:
        return record(merge.answers(*columns(table)))

    if n_groups < 2:
        answers = sent.groupBy("part").applyInArrow(run, "block long, payload binary")
    else:
        # a cell is a range and a group of blocks; the groups take the place of blocks among the summaries
        cell = F.col("part") * n_groups + F.pmod(F.xxhash64("block"), F.lit(n_groups))
        dealt = checkpointed_by(sent.select(cell.alias("cell"), "block", "payload"), "cell")

        def sum_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return record([(key[0].as_py(), merge.summary(columns(table)[1]))])

        def hand_on(own: pa.Table, answer: pa.Table) -> pa.Table:
            raw = answer.column("payload").to_pylist()
            return record(merge.told(*columns(own), raw[0]) if raw and own.num_rows else [])

        summed = dealt.groupBy("cell").applyInArrow(sum_up, "block long, payload binary")
        by_part = summed.withColumn("part", F.floor(F.col("block") / n_groups)).groupBy("part")
        answered = by_part.applyInArrow(run, "block long, payload binary").withColumnRenamed("block", "cell")
        answers = dealt.groupBy("cell").cogroup(answered.groupBy("cell")).applyInArrow(hand_on, "block long, payload binary")
    return answers.groupBy("block").agg(F.collect_list("payload").alias("answers"))


def split_by_block(block: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """One payload per block: its columns one after the other."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.diff(block, prepend=-1)).tolist() + [len(block)]
    columns = [c[order] for c in columns]
    return [(int(block[a]), b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(cut, cut[1:]) if a < b]


def read_columns(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of a payload, by their numpy types."""
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def stack_columns(raws: list[bytes] | None, *kinds: str) -> list[np.ndarray]:
    parts = [read_columns(r, *kinds) for r in raws or []]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, k) for k in kinds]
