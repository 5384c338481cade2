import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, nothing, odd_documents, odd_rows, words
from wellspark.llm import blocks, graph, jaccard, kernel, suffix_index, warc


def brute_repeats(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    return out


def repeats_corpus(seed=0, n=120):
    """Passages that many texts share, cut at random places, near copies, periodic texts and plain ones."""
    rng = random.Random(seed)
    shared = [words(rng, 80) for _ in range(4)]
    texts = []
    for k in range(n):
        t = words(rng, rng.randint(5, 80))
        if k % 3 == 0:
            p = shared[k % 4]
            a = rng.randint(0, 150)
            t += p[a : a + rng.randint(190, 330)] + words(rng, 5)
        if k % 10 == 9:
            t = texts[k - 5][:400] + "é" + texts[k - 5][400:]
        if k % 17 == 0:
            t += ("abc " * rng.randint(45, 70)) + words(rng, 3)
        texts.append(t)
    return texts


@pytest.mark.parametrize("length", [200, 60])
def test_suffix_index_against_brute_force(spark, length):
    texts = repeats_corpus()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_index.digest(docs, length).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats([t.encode() for t in texts], length)


def test_suffix_index_merged_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", 64)  # four groups
    test_suffix_index_against_brute_force(spark, 200)
    test_suffix_index_odd_rows(spark)


def test_two_steps_give_the_answers_of_one():
    rng = np.random.default_rng(5)
    payloads = []
    for _ in range(12):
        key, second, mark = suffix_index._unique(rng.integers(0, 60, 30).astype(np.uint64), rng.integers(0, 3, 30).astype(np.uint64))
        payloads.append(key.tobytes() + second.tobytes() + mark.tobytes())
    batch = np.arange(12)

    def entries(answers):
        return {(b, *e) for b, raw in answers for e in zip(*(x.tolist() for x in blocks.read_columns(raw, "u8", "u8", "u1")))}

    groups = [batch[:5], batch[5:6], batch[6:]]
    told = dict(suffix_index._answers(np.arange(3), [suffix_index._summary([payloads[k] for k in g]) for g in groups]))
    two = [x for k, g in enumerate(groups) for x in suffix_index._told(g, [payloads[i] for i in g], told[k])]
    assert entries(two) == entries(suffix_index._answers(batch, payloads))

    lists = []
    for _ in range(12):
        value = np.unique(rng.integers(0, 1 << 24, 40) // 500_000 * 500_000)
        lists.append(np.int64(7).tobytes() + jaccard.pack_ascending(value, rng.integers(1, 9, len(value))))
    told = dict(jaccard.count_range(np.arange(3), [jaccard._summary([lists[k] for k in g]) for g in groups]))
    two = [x for k, g in enumerate(groups) for x in jaccard._told(g, [lists[i] for i in g], told[k])]
    assert sorted(two) == sorted(jaccard.count_range(batch, lists))


def test_suffix_index_odd_rows(spark):
    rows = odd_rows()
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows])))
    assert Counter(map(tuple, suffix_index.digest(odd_documents(spark)).collect())) == want
    cut = suffix_index.cut_repeats(odd_documents(spark))
    assert cut.columns == odd_documents(spark).columns and cut.count() == len(rows)
    by_place = {r["doc_id"]: r for r in cut.collect() if r["doc_id"] not in (None, 4)}
    assert by_place[5]["text"] is None and by_place[3]["text"] == "" and by_place[8]["text"] == "one two" and by_place[8]["n_chars"] == 7
    assert suffix_index.digest(nothing(spark)).count() == 0 and suffix_index.cut_repeats(nothing(spark)).count() == 0


def test_level_family_is_logarithmic_and_complete():
    rng = np.random.default_rng(3)
    family = suffix_index.LevelFamily()
    every = []
    for batch in range(40):
        key, second = rng.integers(0, 300, 30).astype(np.uint64), rng.integers(0, 2, 30).astype(np.uint64)
        key, second, mark = suffix_index._unique(key, second)
        every += [(int(a), int(b), batch, bool(m)) for a, b, m in zip(key, second, mark)]
        family.add(key, second, batch, mark)
        sizes = [len(x[0]) for x in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 12
    pairs, seconds = Counter((a, b) for a, b, _, _ in every), {}
    for a, b, _, _ in every:
        seconds.setdefault(a, set()).add(b)
    inner = {(a, b) for a, b, _, m in every if m}
    for a, b, batch, mark in zip(*(x.tolist() for x in family.finish())):
        assert bool(mark & suffix_index.REPEATED) == (pairs[a, b] > 1 or (a, b) in inner and any(m and (x, y, z) == (a, b, batch) for x, y, z, m in every))
        assert bool(mark & suffix_index.MIXED) == (len(seconds[a]) > 1)


# --- op3


def brute_components(rows, n=4, percent=85):
    low = {c: c + 32 for c in range(65, 91)}
    seps = "\x20\t\n\x0b\x0c\r"
    sets = []
    for _, t in rows:
        ws = "".join(" " if c in seps else c for c in (t or "").translate(low)).split(" ")
        ws = [w for w in ws if w]
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def copies_corpus(seed, n=260):
    """Chains of small edits, large groups of near copies, pairs near the limit, and short texts."""
    rng = random.Random(seed)
    rows = []
    base = words(rng, 70).split()
    for k in range(n):
        if k % 4 == 0:
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = words(rng, 1)
        elif k % 4 == 1 and k > 8:
            t = rows[k - 4 if k % 8 == 1 else rng.randrange(k)][1].split() or ["x"]
            t[rng.randrange(len(t))] = words(rng, 1)
        else:
            t = words(rng, rng.choice([1, 2, 3, 4, 9, 40, 90])).split()
        rows.append((k * 7 % 1009, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_against_brute_force(spark, seed):
    rows = copies_corpus(seed)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows)


def test_jaccard_counted_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_BLOCKS", 64)
    test_jaccard_against_brute_force(spark, 2)
    test_jaccard_odd_rows(spark)


def test_jaccard_in_many_small_chunks(spark, monkeypatch):
    """With chunks of a few sets the links between chunks come from the second round."""
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 2500)
    rows = copies_corpus(5, 200)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 5, 80)


def test_jaccard_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = jaccard.near_duplicates(odd_documents(spark))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows)
    kept = jaccard.keep_one(odd_documents(spark), 5, 80)
    assert kept.columns == odd_documents(spark).columns
    texts = Counter(r["text"] for r in kept.collect())
    base, near = rows[0][1], rows[1][1]
    assert texts[base] == 1 and texts[near] == 0 and texts[rows[3][1]] == 1 and texts[None] == 2 and texts[""] == 1
    assert jaccard.near_duplicates(nothing(spark)).count() == 0 and jaccard.keep_one(nothing(spark), 5, 80).count() == 0


def test_one_of_equal_rows_stays_whatever_their_columns(spark):
    """Maps can't be ordered; rows with equal ids and texts are still told apart."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"b": 2}), (2, text, None), (3, None, {"c": 3}), (3, None, {"c": 3})], "doc_id int, text string, kept map<string,int>")
    out = jaccard.keep_one(docs, 5, 80).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3, 3] and {str(r["kept"]) for r in out if r["doc_id"] == 1} <= {"{'a': 1}", "{'b': 2}"}


def test_size_bands_hold_all_links(spark):
    sizes = spark.range(1, 3000).select(F.col("id").alias("n"), jaccard.size_band(F.col("id"), 85).alias("band"))
    band = {r["n"]: r["band"] for r in sizes.collect()}
    assert all(band[n] - band[jaccard.need(n, 85)] <= 1 for n in band)


def test_jaccard_of_megabyte_texts(spark):
    rng = random.Random(41)
    long = words(rng, 250_000)
    parts = long.split()
    parts[1000] = "other"
    docs = spark.createDataFrame([(1, long), (2, " ".join(parts)), (3, words(rng, 30)), (4, words(rng, 250_000))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    got = {r["doc_id"]: r for r in suffix_index.digest(docs).collect()}
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == 0 and got[1]["n_bytes"] - got[1]["n_removed"] < 20


def test_anchors_depend_on_windows_alone():
    """Equal windows have equal anchors in batches of any size."""
    rng = random.Random(43)
    same = words(rng, 300).encode()
    few = suffix_index.Runs(kernel.Texts([same]), 200)
    many = suffix_index.Runs(kernel.Texts([words(rng, 20_000).encode(), same, words(rng, 60_000).encode()]), 200)
    at = int(many.t.start[1])
    inside = (many.lo >= at) & (many.hi < many.t.stop[1])
    assert (many.lo[inside] - at).tolist() == few.lo.tolist() and (many.anchor[inside] == few.anchor).all() and (many.context[inside] == few.context).all()


def test_signature_tree_bounds():
    """The dual traversal finds the components of all pairs, for any tree shape."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 70):
        base = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
        sets = []
        for k in range(n):
            s = base.copy() if k % 2 else rng.integers(0, 1 << 48, int(rng.integers(1, 80)), dtype=np.uint64)
            s[: rng.integers(0, min(12, len(s)) + 1)] = rng.integers(0, 1 << 48)
            sets.append(np.unique(s))
        keys = [bytes([k]) for k in range(n)]
        found = jaccard.links_in(keys, [jaccard._six(s) for s in sets], [0] * n, [None] * n, 80)
        u, v = jaccard.Unions(n), jaccard.Unions(n)
        for a, b in found:
            u.join(a[0], b[0])
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    v.join(i, j)
        assert [[u.find(i) == u.find(j) for j in range(n)] for i in range(n)] == [[v.find(i) == v.find(j) for j in range(n)] for i in range(n)]


def test_packing():
    rng = np.random.default_rng(2)
    for top in (200, 1 << 24):
        v = np.unique(rng.integers(0, top, 150))
        m = rng.integers(1, 250, len(v))
        a, b = jaccard.unpack_ascending(jaccard.pack_ascending(v, m))
        assert (a == v).all() and (b == m).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)] + [(600, 600)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in list(nodes)[:60] for b in nodes)
    assert all(got[v] == v for v in set(got.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op4

RECORD = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, payload_digest string, headers map<string,string>, bucket string, rec string"


def test_canonical_url(spark):
    rows = [
        ("http://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#f", "example.com/a?a=1&b=2"), ("https://example.com/a", "example.com/a"), ("example.com", "example.com"), ("http://e.org/?ref=1", "e.org"),
        ("http://e.org/A?reference=1", "e.org/A?reference=1"), (None, None), ("", ""),
    ]
    got = spark.createDataFrame(rows, "url string, want string").select(warc.canonical_url(F.col("url")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_revisits(spark):
    h = {"Content-Length": "9", "ETag": '"a"', "Age": "1"}
    rows = [
        (1, "http://x.org/p", 10, "response", 200, '"a"', "d1", "s1", h, None, None), (2, "https://x.org/p/", 20, "response", 200, '"b"', "d2", "s2", None, None, None), (3, "http://x.org/p", 15, "response", 404, None, None, "s3", h, None, None),
        (10, "http://x.org/p#z", 15, "revisit", 304, 'W/"a"', None, None, {"content-length": "0", "age": "7", "X": "y"}, None, None), (11, "http://x.org/p", 20, "revisit", 304, '"a"', None, None, None, None, None),
        (12, "http://x.org/p", 99, "revisit", 304, '"a"', None, None, None, None, None), (13, "http://x.org/p", 99, "revisit", 304, None, "d2", "s2", None, None, None), (14, "http://x.org/p", 99, "revisit", 304, None, None, None, None, None, None),
        (15, "http://x.org/p", 5, "revisit", 304, '"a"', None, None, None, None, None), (16, None, 99, "revisit", 304, '"a"', None, None, None, None, None), (17, "http://x.org/p", None, "revisit", 304, None, None, None, None, None, None),
        (18, "http://x.org/p", 99999, "revisit", 304, None, "d2", "other", None, None, None), (19, "", 1, "response", 200, '"a"', None, None, None, None, None), (20, "  ", 9, "revisit", 304, '"a"', None, None, None, None, None),
    ]
    for width in (1, 8, 3600, 10**9):
        out = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), width).collect()}
        assert {k: (r["verdict"], r["response_id"]) for k, r in out.items()} == {
            10: ("resolved", 1), 11: ("resolved", 1), 12: ("changed", 2), 13: ("resolved", 2), 14: ("unchecked", 2), 15: ("no_response", None), 16: ("no_response", None), 17: ("no_response", None), 18: ("changed", 2), 20: ("no_response", None),
        }
        assert out[10]["headers"] == {"content-length": "9", "etag": '"a"', "age": "7", "x": "y"} and out[10]["payload_digest"] == "s1" and out[12]["headers"] is None
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(7)
    rows, urls = [], [f"http://h{k % 3}.org/{k}" for k in range(9)]
    for k in range(400):
        full = rng.random() < 0.4
        url = urls[0] if rng.random() < 0.5 else rng.choice(urls)
        rows.append((k, url, rng.randrange(120), "response" if full else "revisit", 200 if full else 304, rng.choice(['"a"', '"b"', None]), None, None, None, None, None))
    got = {r["record_id"]: (r["response_id"], r["verdict"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), 7).collect()}
    for r in rows:
        if r[3] == "revisit":
            best = max(((x[2], x[0], x[5]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]), default=None)
            verdict = "no_response" if best is None else "unchecked" if r[5] is None else "resolved" if best[2] == r[5] else "changed"
            assert got[r[0]] == (best and best[1], verdict)
