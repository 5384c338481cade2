"""N-gram Jaccard join with signature trees.

A document's set holds its distinct ``n``-word shingles; two documents link when
``100 * intersection >= percent * union``.  The result is each document's component.

1. Blocks count how many times each shingle (a 48-bit hash) occurs anywhere.  A set's shingles
   are ordered rarest first; linked sets share one of the first ``size - need + 1``, and
   shingles that occur once are shared with nobody, so most documents end here.
2. Sets are dealt to size bands so wide that linked sets are in one band or in neighbouring
   ones.  The remaining sets, one per distinct set, are grouped by the smallest set of their band
   with which they share such a shingle, in chunks of bounded bytes, each with that leading set.
3. In a chunk a signature tree is built: leaves hold sets, every node the OR of its sets' token
   bitmaps, its size range and its largest number of bitmap collisions.  A dual traversal drops
   node pairs whose maximum possible overlap or size ranges exclude a link, or whose sets are
   connected already, and verifies what is left exactly.  Only a spanning part of the links is
   sent on, so a group of n copies sends n - 1 links.
4. Chunk pairs of one band or neighbouring ones that share a rare shingle between different
   components are traversed likewise.

Defined cases: null and empty texts have empty sets, which link with nothing and are their own
component; a document with fewer than ``n`` words has one shingle, its whole sequence; equal
sets are one class, so repeated rows and ties share a component; a component's id is its smallest
doc_id (null ids are passed over); an empty table gives no rows; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``, whatever their names and types.  A very long text
is held whole in one task, and its set (6 bytes a shingle) is compared in one.
Exact up to collisions of 48-bit hashes inside one set or pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm import blocks, graph, kernel
from wellspark.llm.common import checkpointed

WORDS = 4
PERCENT = 85
#: Bytes of the sets of a chunk (a larger set is a chunk of its own, with the leading set).
CHUNK_BYTES = 1 << 20
LEAF = 8
FANOUT = 8
_TOKEN = (1 << 48) - 1
_LOW = (1 << 24) - 1


class Sets:
    """The shingle sets of a batch of texts: ``token[first[i]:first[i + 1]]`` is set ``i``, ascending."""

    def __init__(self, t: kernel.Texts, n: int) -> None:
        w = t.words(lower=True)
        doc, token = [], []
        for k in range(1, n + 1):
            h, at = kernel.windows(w, k)
            owner = w.text[at]
            if k < n:
                whole = w.count[owner] == k
                h, owner = h[whole], owner[whole]
            doc.append(owner)
            token.append(h >> np.uint64(16))
        doc, token = np.concatenate(doc).astype(np.uint64), np.concatenate(token)
        if t.n <= 1 << 16:
            key = np.unique((doc << np.uint64(48)) | token)
            self.doc, self.token = (key >> np.uint64(48)).astype(np.int64), key & np.uint64(_TOKEN)
        else:  # more texts than 16 bits name
            pair = np.unique(np.stack([doc, token]), axis=1)
            self.doc, self.token = pair[0].astype(np.int64), pair[1]
        self.size = np.bincount(self.doc, minlength=t.n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])


def need(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of this size with any set it links to."""
    return -(-percent * size // 100)


def _place(token: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    part = ((token >> np.uint64(24)) * np.uint64(n_ranges) >> np.uint64(24)).astype(np.int64)
    return part, (token & np.uint64(_LOW)).astype(np.int64)


def pack_ascending(values: np.ndarray, marks: np.ndarray) -> bytes:
    """Ascending 24-bit values as 2-byte steps where they fit, and one byte each of ``marks``."""
    step = np.diff(values, prepend=0)
    wide = bool(len(step)) and int(step.max()) > 0xFFFF
    return bytes([wide]) + step.astype("u4" if wide else "u2").tobytes() + marks.astype("u1").tobytes()


def unpack_ascending(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, marks = blocks.read_columns(raw[1:], "u4" if raw[0] else "u2", "u1")
    return np.cumsum(step, dtype=np.int64), marks


def _totals(lists: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """An eighth of the range at a time: its first value, the counts of its values over all lists, and where it ends in each."""
    size = 1 << 21
    for low in range(0, 1 << 24, size):
        total = np.zeros(size, np.uint32)
        cuts = [np.searchsorted(value, (low, low + size)) for value, _ in lists]
        for (i, j), (value, n) in zip(cuts, lists):
            total[value[i:j] - low] += n[i:j]
        yield low, total, cuts


def count_range(batch: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
    """How often each value occurs over all batches; each batch hears of its values that occur twice or more.

    An answer is the range's number, then the values with the bit length of their counts.
    """
    lists = [unpack_ascending(p[8:]) for p in payloads]
    counts = [np.empty(len(value), np.uint32) for value, _ in lists]
    for low, total, cuts in _totals(lists):
        for (i, j), (value, _), own in zip(cuts, lists, counts):
            own[i:j] = total[value[i:j] - low]
    out = []
    for b, raw, (value, _), n in zip(batch, payloads, lists, counts):
        some = n > 1
        if some.any():
            out.append((int(b), raw[:8] + pack_ascending(value[some], np.ceil(np.log2(n[some] + 1)))))
    return out


def _summary(payloads: list[bytes]) -> bytes:
    """The values of several batches with their counts, of which more than 255 count as 255."""
    values, counts = [], []
    for low, total, _ in _totals([unpack_ascending(p[8:]) for p in payloads]):
        at = np.flatnonzero(total)
        values.append(at + low)
        counts.append(np.minimum(total[at], 255))
    return payloads[0][:8] + pack_ascending(np.concatenate(values), np.concatenate(counts))


def _told(batch: np.ndarray, payloads: list[bytes], answer: bytes) -> list[tuple[int, bytes]]:
    """The bit lengths of a summary's counts for the batches that hold the values."""
    known, mark = unpack_ascending(answer[8:])
    out = []
    for b, raw in zip(batch, payloads):
        value, _ = unpack_ascending(raw[8:])
        slot = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = known[slot] == value
        if hit.any():
            out.append((int(b), raw[:8] + pack_ascending(value[hit], mark[slot[hit]])))
    return out


COUNTS = blocks.Merge(count_range, _summary, _told)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sets(payload: bytes, n: int) -> tuple[pa.Table, Sets]:
    table = blocks.unpack(payload)
    return table, Sets(kernel.Texts(kernel.as_bytes(table.column("text").combine_chunks()) if table.num_rows else []), n)


def _frequency(s: Sets, answers: list[bytes] | None, n_ranges: int) -> np.ndarray:
    """Bit length of each entry's count over all documents; 1 where it occurs once."""
    out = np.ones(len(s.token), np.int64)
    keys, marks = [], []
    for raw in answers or []:
        value, mark = unpack_ascending(raw[8:])
        keys.append((int(np.frombuffer(raw[:8], "i8")[0]) << 24) | value)
        marks.append(mark)
    if keys and len(out):
        key, mark = np.concatenate(keys), np.concatenate(marks)
        order = np.argsort(key)
        key, mark = key[order], mark[order]
        part, value = _place(s.token, n_ranges)
        asked = (part << 24) | value
        slot = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        hit = key[slot] == asked
        out[hit] = mark[slot[hit]]
    return out


def _six(token: np.ndarray) -> bytes:
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class SignatureTree:
    """Sets at the leaves; every node has an OR-combined bitmap, its size range and its most collisions."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in sets]), size))
        self.sets = [sets[i] for i in self.order]
        size = size[self.order]
        words = max(1, bits // 64)
        maps = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(self.sets):
            bit = np.unique((s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(words * 64))
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        collisions = size - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, size, size, collisions)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(low), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))

    def children(self, level: int, i: int) -> slice:
        f = LEAF if level == 1 else FANOUT
        return slice(i * f, min((i + 1) * f, len(self.levels[level - 1][1])))


class Unions:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def dual_traversal(a: SignatureTree, b: SignatureTree, ids_a: list[int], ids_b: list[int], unions: Unions, percent: int) -> list[tuple[int, int]]:
    """Verified links between ``a`` and ``b`` (or inside ``a`` if they are one) that join unconnected sets."""
    found: list[tuple[int, int]] = []

    def possible(la: int, sa: slice, lb: int, sb: slice) -> np.ndarray:
        """Which node pairs can hold a link: by size ranges, then by the most tokens they can share."""
        ma, low_a, high_a, extra_a = (x[sa] for x in a.levels[la])
        mb, low_b, high_b, extra_b = (x[sb] for x in b.levels[lb])
        most = np.bitwise_count(ma[:, None, :] & mb[None, :, :]).sum(2, dtype=np.int64) + np.minimum(extra_a[:, None], extra_b[None, :])
        most = np.minimum(most, np.minimum(high_a[:, None], high_b[None, :]))
        least = need(np.maximum(low_a[:, None], low_b[None, :]), percent)
        return np.argwhere((most >= least) & (most > 0))

    def visit(la: int, i: int, lb: int, j: int) -> None:
        if la == 0 and lb == 0:
            return
        sa = a.children(la, i) if la >= lb else slice(i, i + 1)
        sb = b.children(lb, j) if lb >= la else slice(j, j + 1)
        na, nb = (la - 1 if la >= lb else la), (lb - 1 if lb >= la else lb)
        if na == 0 and nb == 0:
            roots = {unions.find(ids_a[a.order[k]]) for k in range(sa.start, sa.stop)} | {unions.find(ids_b[b.order[k]]) for k in range(sb.start, sb.stop)}
            if len(roots) == 1:
                return
        for x, y in possible(na, sa, nb, sb).tolist():
            p, q = sa.start + x, sb.start + y
            if a is b and na == nb and p > q:
                continue
            if na == 0 and nb == 0:
                u, v = ids_a[a.order[p]], ids_b[b.order[q]]
                if u != v and unions.find(u) != unions.find(v):
                    s, r = a.sets[p], b.sets[q]
                    both = len(np.intersect1d(s, r, assume_unique=True))
                    if both and 100 * both >= percent * (len(s) + len(r) - both):
                        unions.join(u, v)
                        found.append((u, v))
            else:
                visit(na, p, nb, q)

    visit(len(a.levels) - 1, 0, len(b.levels) - 1, 0)
    if len(a.levels) == 1 and len(b.levels) == 1 and a is not b:  # two single sets
        for x, y in possible(0, slice(0, 1), 0, slice(0, 1)).tolist():
            u, v = ids_a[0], ids_b[0]
            both = len(np.intersect1d(a.sets[0], b.sets[0], assume_unique=True))
            if unions.find(u) != unions.find(v) and both and 100 * both >= percent * (len(a.sets[0]) + len(b.sets[0]) - both):
                unions.join(u, v)
                found.append((u, v))
    return found


def _bits(sets: list[np.ndarray]) -> int:
    """Two bits for each token of the largest set; between 256 and 131,072."""
    most = max((len(s) for s in sets), default=1)
    return min(1 << 17, max(256, 1 << (2 * most - 1).bit_length()))


def links_in(keys: list[bytes], payloads: list[bytes], side: list[int], component: list[bytes], percent: int) -> list[tuple[bytes, bytes]]:
    """Spanning links of one chunk (all ``side`` 0) or between two chunks; ``component`` holds what is connected already."""
    at = {}
    for k, key in enumerate(keys):
        at.setdefault(key, k)
    unions = Unions(len(keys))
    known: dict[bytes, int] = {}
    for k, key in enumerate(keys):
        unions.join(at[key], k)
        if component[k] is not None:
            unions.join(known.setdefault(component[k], k), k)
    sets = [_from_six(p) for p in payloads]
    bits = _bits(sets)
    groups = [[k for k in sorted(set(at.values()) if len(set(side)) < 2 else range(len(keys))) if side[k] == s] for s in sorted(set(side))]
    trees = [SignatureTree([sets[k] for k in g], bits) for g in groups]
    a, b = (0, 1) if len(groups) > 1 else (0, 0)
    return [(keys[u], keys[v]) for u, v in dual_traversal(trees[a], trees[b], groups[a], groups[b], unions, percent)]


def _traverse(rows: DataFrame, group: list[str], percent: int) -> DataFrame:
    """Links (a, b) from rows of group columns and key, payload, side, component."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_pylist() for n in ("key", "payload", "side", "component")}
        order = sorted(range(table.num_rows), key=lambda k: (c["side"][k], c["key"][k]))
        links = links_in(*([c[n][k] for k in order] for n in ("key", "payload", "side", "component")), percent)
        return pa.table([[x for x, _ in links], [y for _, y in links]], schema=schema)

    return rows.groupBy(*group).applyInArrow(run, "a binary, b binary")


_ROWS = "kind int, doc_id long, text_hash long, block long, row int, size long, key binary, payload binary, prefix array<long>"


def shingle_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The packed blocks of ``docs`` (all columns), and checkpointed rows about them.

    Kind 0 is a document (doc_id, text_hash, its place as block and row, size, key), kind 1 a set
    that may link (key, size, payload, prefix).
    """
    packed, n_ranges = blocks.packed_blocks(docs)
    sent = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "block": pa.int64(), "row": pa.int32(), "size": pa.int64(), "key": pa.binary(), "payload": pa.binary(), "prefix": pa.list_(pa.int64())}
    out = pa.schema(list(kinds.items()))

    def emitted(n: int, **columns: object) -> pa.RecordBatch:
        return kernel.record(out, *(columns.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, s = _sets(row["payload"], words)
            part, value = _place(s.token, n_ranges)
            key, n = np.unique((part << 24) | value, return_counts=True)
            part, n = key >> 24, np.minimum(n, 255)
            cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(key)]
            rows = [(int(part[i]), np.int64(part[i]).tobytes() + pack_ascending(key[i:j] & _LOW, n[i:j])) for i, j in zip(cut, cut[1:]) if i < j]
            yield kernel.record(sent, [p for p, _ in rows], [row["block"]] * len(rows), [r for _, r in rows])

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            table, s = _sets(row["payload"], words)
            n = len(s.size)
            keys = [hashlib.blake2b(s.token[a:b].tobytes(), digest_size=16).digest() for a, b in zip(s.first, s.first[1:])]
            hashes = [int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest(), "little", signed=True) for t in kernel.as_bytes(table.column("text"))]
            ids = table.column("doc_id").combine_chunks().cast(pa.int64())
            yield emitted(n, kind=[0] * n, doc_id=ids, text_hash=hashes, block=[row["block"]] * n, row=list(range(n)), size=s.size, key=keys)
            often = _frequency(s, row["answers"], n_ranges)
            alone = np.bincount(s.doc[often == 1], minlength=n)
            prefix = s.size - need(s.size, percent) + 1
            seen: set[bytes] = set()
            found = []
            for d in np.flatnonzero((alone < prefix) & (s.size > 0)).tolist():
                if keys[d] in seen:
                    continue
                seen.add(keys[d])
                part = slice(s.first[d], s.first[d + 1])
                order = np.lexsort((s.token[part], often[part]))[alone[d] : prefix[d]]
                found.append((keys[d], int(s.size[d]), _six(s.token[part]), s.token[part][order].astype(np.int64)))
            for k in range(0, len(found), 256):
                f = found[k : k + 256]
                yield emitted(len(f), kind=[1] * len(f), size=[x[1] for x in f], key=[x[0] for x in f], payload=[x[2] for x in f], prefix=[x[3] for x in f])

    answers = blocks.exchange_ranges(packed.mapInArrow(send, "part long, block long, payload binary"), COUNTS, n_ranges)
    return packed, checkpointed(packed.join(answers, "block", "left").mapInArrow(sets, _ROWS))


def size_band(size: Column, percent: int) -> Column:
    """Sizes of linked sets differ by a factor of 100 / percent at most, so by one band at most."""
    return F.floor(F.log(size) / (1.0001 * math.log(100 / percent) if percent < 100 else 1.0)).cast("int")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(node, label) over the keys of linked sets."""
    may = rows.filter("kind = 1")
    content = may.groupBy("key").agg(F.first("payload").alias("payload"))
    postings = may.select(F.explode("prefix").alias("token"), "key", "size", size_band(F.col("size"), percent).alias("band")).distinct()
    leaders = postings.groupBy("token", "band").agg(F.min("key").alias("leader"), F.max("key").alias("last"))
    shared = leaders.groupBy("token").agg(F.min("leader").alias("low"), F.max("last").alias("high")).filter("low != high").select("token")
    leaders = checkpointed(leaders.drop("last").join(shared, "token"))
    held = checkpointed(postings.join(leaders, ["token", "band"]))  # token, band, key, size, leader: only shared tokens

    lead = held.groupBy("key").agg(F.min("leader").alias("leader"), F.first("size").alias("size"), F.first("band").alias("band"))
    counts = lead.groupBy("leader").agg(F.ceil(F.sum(F.col("size") * 6 + 64) / CHUNK_BYTES).alias("chunks"), F.count("*").alias("n"))
    counts = checkpointed(counts)
    member = checkpointed(lead.join(counts, "leader").select("key", "leader", "band", "n", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk")))
    several = member.filter("n > 1 OR key != leader").select("key", "leader", "chunk")
    copies = counts.select(F.col("leader").alias("key"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    placed = several.unionAll(copies.join(several.select("leader", "chunk").distinct(), ["leader", "chunk"]).select("key", "leader", "chunk")).distinct().join(content, "key")
    none = F.lit(None).cast("binary")
    first = _traverse(placed.select("leader", "chunk", "key", "payload", F.lit(0).alias("side"), none.alias("component")), ["leader", "chunk"], percent)
    first = checkpointed(first)
    label = graph.components(first)

    # a token that stands between components: its chunks are compared with each other
    where = member.select("key", F.struct("leader", "chunk").alias("cell"))
    now = held.select("token", "band", "key").join(label.withColumnRenamed("node", "key"), "key", "left").select("token", "band", "key", F.coalesce("label", "key").alias("component"))
    sizes = now.groupBy("token", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("parts > 1")
    split = checkpointed(split.select("token", "main"))
    open_ = checkpointed(now.join(split, "token").join(where, "key"))
    cells = open_.groupBy("token", "band", "cell").agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("odd"), F.min("component").alias("low"), F.max("component").alias("high"))
    cells = checkpointed(cells)
    x = cells.filter("odd = 1").withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("x")
    y = cells.alias("y")
    differ = ~((F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")) & (F.col("x.low") == F.col("x.high")))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.near") == F.col("y.band")) & (F.col("x.cell") != F.col("y.cell")) & differ)
    pairs = checkpointed(pairs.select(F.least("x.cell", "y.cell").alias("one"), F.greatest("x.cell", "y.cell").alias("two")).distinct())
    sides = pairs.select("one", "two", F.col("one").alias("cell"), F.lit(0).alias("side")).unionAll(pairs.select("one", "two", F.col("two").alias("cell"), F.lit(1).alias("side")))
    asked = open_.select("key", "cell", "component").distinct()
    second = _traverse(sides.join(asked, "cell").join(content, "key").select("one", "two", "key", "payload", "side", "component"), ["one", "two"], percent)
    second = checkpointed(second)
    if not second.limit(1).count():
        return label
    return graph.components(first.unionAll(second))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and ``class_id`` (the smallest doc_id with an equal set)."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    _, rows = shingle_sets(slim, words, percent)
    label = links(rows, percent)
    one = rows.filter("kind = 0").select("doc_id", F.col("size").alias("n_shingles"), "key")
    full = one.filter("n_shingles > 0")
    classes = checkpointed(full.groupBy("key").agg(F.min("doc_id").alias("class_id")))
    grouped = classes.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("label", "key"))
    least = checkpointed(grouped.groupBy("group").agg(F.min("class_id").alias("component_id")))
    known = checkpointed(grouped.join(least, "group").select("key", "class_id", "component_id"))
    linked = full.join(known, "key").select("doc_id", "n_shingles", "component_id", "class_id")
    empty = one.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return linked.unionAll(empty)


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (all columns) without all but one document of each component.

    The one with the smallest doc_id stays (a null id only if there is no other; ties by a hash of
    the text, then one of the equal rows).  Texts without words all stay.  The texts don't move
    again: the places of the rows that stay go back to the blocks.
    """
    packed, rows = shingle_sets(docs, words, percent)
    label = links(rows, percent)
    one = rows.filter("kind = 0")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "block", "row")
    classes = checkpointed(one.filter("size > 0").groupBy("key").agg(F.min(rank).alias("best")))
    grouped = classes.join(label.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("label", "key").alias("group")).agg(F.min("best").alias("best"))
    kept = grouped.select("best.block", "best.row").unionAll(one.filter("size = 0").select("block", "row"))
    told = checkpointed(kept.groupBy("block").agg(F.collect_list("row").alias("kept")))  # a block's rows are bounded

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            table = blocks.unpack(row["payload"])
            yield from table.take(pa.array(sorted(row["kept"]), pa.int64())).combine_chunks().to_batches()

    return packed.join(told, "block").mapInArrow(emit, docs.schema)


#: The same rows by SQL: distinct sets, all pairs that share a shingle, and a recursive closure.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
k AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS key, sh FROM s),
c AS (SELECT key, min(doc_id) AS id, any_value(n) AS n, any_value(sh) AS sh FROM k WHERE n > 0 GROUP BY key),
e AS (SELECT id, n, unnest(sh) AS t FROM c),
p AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(id, o) AS (SELECT id, id FROM c UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.o),
m AS (SELECT id, min(o) AS comp FROM r GROUP BY id)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE m.comp END AS component_id, CASE WHEN k.n = 0 THEN k.doc_id ELSE c.id END AS class_id
FROM k LEFT JOIN c ON c.key = k.key AND k.n > 0 LEFT JOIN m ON m.id = c.id
"""
