"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be covered by a merge, so
the position between the two bytes is a certain cut.  Every pre-token is cut there, the
fragments are encoded independently, and the ids are concatenated (and remembered for the
pre-token, as it repeats).  Decoding concatenates the tokens' bytes.

Defined cases: a null text encodes as an empty one; the strings of added special tokens
become their ids, as the public library does by default; repeated rows get equal ids; an empty
table gives no rows; extra columns pass through ``encode_documents`` and ``decode_documents``
(a column of the name that they add is replaced) and are ignored by the others.  What is
remembered is bounded in entries and in their length, which changes no result, so beside that memory follows the longest text (some 60 bytes a byte).
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a memory's newer half.
MEMORY_ENTRIES = 100_000
#: Longer pre-tokens aren't remembered.
MEMORY_LENGTH = 64


class Memory(dict):
    """Results by pre-token in two halves: when the newer one is full it replaces the older, so frequent ones stay."""

    def __init__(self, make: Callable, entries: int) -> None:
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, word: str) -> object:
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= MEMORY_LENGTH:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next letter from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {b: i for i, b in self.token.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self._core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._pretoken = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joined = np.zeros((256, 256), bool)
        for b in ranks:
            a = np.frombuffer(b, np.uint8)
            self.joined[a[:-1], a[1:]] = True
        self._held = self.joined.tobytes()
        self._digests = Memory(self._digest, 2 * MEMORY_ENTRIES)
        self._ids = Memory(self._packed, MEMORY_ENTRIES)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between all byte pairs that no token holds."""
        held = self._held
        cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not held[a << 8 | b]]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def _piece(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: its fragments are encoded on their own."""
        return [i for f in self.fragments(piece) for i in self._core.encode_single_piece(f)]

    def _digest(self, word: str) -> tuple[str, bytes]:
        ids = self._piece(word.encode())
        return ",".join(map(str, ids)), self.decode_bytes(ids)

    def _packed(self, word: str) -> bytes:
        return array("i", self._piece(word.encode())).tobytes()

    def _spans(self, text: str) -> Iterator[tuple[str, bool]]:
        if self._special is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, part in enumerate(self._special.split(text)):
            if part:
                yield part, bool(k % 2)

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as 4-byte numbers one after the other."""
        out: list[bytes] = []
        for part, special in self._spans(text or ""):
            if special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += map(self._ids.__getitem__, self._pretoken.findall(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "i4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[str, bytes]:
        """The ids in decimal with commas, and the bytes that they decode to; pre-token by pre-token from memory."""
        ids, out = [], []
        for part, special in self._spans(text or ""):
            if special:
                ids.append(str(self.special[part]))
                out.append(self.token[self.special[part]])
                continue
            known = [self._digests[w] for w in self._pretoken.findall(part)]
            ids += [i for i, _ in known]
            out += [b for _, b in known]
        return ",".join(ids), b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every row with the ids of its whole text: the input's columns and ``ids array<int>``.

    An input column ``ids`` is replaced, a null text has no ids.  No shuffle.
    """
    kept = docs.drop("ids")
    schema = kept.select("*", F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in kernel.slices(batches):
            packed = [bpe.encode_packed(t) for t in part.column("text").to_pylist()]
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return kept.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``text`` again from ``ids``; a null list gives an empty text.  Other columns pass through."""
    kept = encoded.drop("text")
    schema = kept.drop("ids").select("*", F.lit("").alias("text")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                text = pa.array([bpe.decode(i or ()) for i in part.column("ids").to_pylist()], pa.string())
                rest = part.drop_columns(["ids"])
                yield pa.RecordBatch.from_arrays([*rest.columns, text], names=[*rest.schema.names, "text"])

    return kept.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one narrow pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in kernel.slices(batches):
            n, a, b = [], [], []
            for t in part.column("text").to_pylist():
                ids, raw = bpe.digest(t)
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
            yield kernel.record(schema, part.column("doc_id"), n, a, b)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One column ``n_tokens``: the encoded length of every whole text."""
    schema = pa.schema([("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in kernel.slices(batches):
            yield kernel.record(schema, [len(bpe.encode_packed(t)) // 4 for t in part.column("text").to_pylist()])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")
