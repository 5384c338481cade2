import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, nothing, odd_documents, odd_rows, words
from wellspark.llm import bpe, decontam, kernel, langid, lengths, licenses, quality, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


# --- op9


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_public_encoding(text):
    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    ids = t.encode(text, add_special_tokens=False).ids
    own = bpe.encoder(BYTE_BPE)
    assert own.encode(text) == ids
    assert own.decode(ids) == t.decode(ids, skip_special_tokens=False) == text
    assert own.digest(text) == (",".join(map(str, ids)), text.encode())


def test_bpe_fragments_join_no_token(public):
    own = bpe.encoder(BYTE_BPE)
    piece = "ab\x00q\x00\x00zz日x".encode()
    parts = own.fragments(piece)
    assert b"".join(parts) == piece and len(parts) > 1
    tokens = set(own.token.values())
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    assert not any(bytes(piece[c - 1 : c + 1]) in t for c in cuts for t in tokens)


def test_bpe_special_strings_and_runs(public):
    own = bpe.encoder(BYTE_BPE)
    for text in ("<|endoftext|>", "a<|endoftext|>b<|endoftext|>", " " * 300 + "x", "a" * 3000, "\n\n\n x\r\n", "it's 'S we'll"):
        assert own.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_bounded(public):
    """Pre-tokens of a megabyte are encoded whole and aren't remembered."""
    own = bpe.ForcedBoundaryBPE(BYTE_BPE)
    text = "日本語" * 120_000 + " " + "ab" * 300_000 + " short words here"
    ids = public.encode(text, add_special_tokens=False).ids
    assert own.digest(text) == (",".join(map(str, ids)), text.encode()) and own.encode(text) == ids
    for memory in (own._digests, own._ids):
        assert all(len(k) <= bpe.MEMORY_LENGTH for k in memory) and len(memory) <= bpe.MEMORY_ENTRIES


def test_bpe_documents(spark, public):
    docs = odd_documents(spark)
    got = sorted(map(tuple, bpe.digest_documents(docs, BYTE_BPE).collect()), key=str)
    want = []
    for r in odd_rows():
        ids = public.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode_documents(docs, BYTE_BPE)
    assert encoded.columns == [*docs.columns, "ids"]
    back = bpe.decode_documents(encoded, BYTE_BPE)
    assert Counter(r["text"] for r in back.collect()) == Counter(r[1] or "" for r in odd_rows())
    assert bpe.digest_documents(nothing(spark), BYTE_BPE).count() == 0


# --- op2


def test_lengths_against_brute_force(spark, public):
    n = [len(public.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows()]
    sums = lengths.suffix_sums(lengths.histogram(odd_documents(spark), BYTE_BPE)).cache()
    rows = {r["length"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert r["n_docs"] == n.count(k) and r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
        assert r["docs_at_least"] == sum(x >= k for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= k)
        assert r["truncated_total"] == sum(min(x, k) for x in n)
        assert math.isclose(r["quantile"], sum(x <= k for x in n) / len(n))
    limits = [0, 1, 5, 300, max(n), 10 * max(n)]
    for r in lengths.at_limits(sums, limits).collect():
        assert r["truncated_total"] == sum(min(x, r["limit"]) for x in n) and r["docs_over"] == sum(x > r["limit"] for x in n)
    for r in lengths.quantiles(sums, [0.25, 0.5, 1.0]).collect():
        assert r["length"] == min(k for k in n if sum(x <= k for x in n) >= r["share"] * len(n))


def test_lengths_of_nothing(spark):
    assert lengths.suffix_sums(lengths.histogram(nothing(spark), BYTE_BPE)).count() == 0


# --- op1


def _quality(text):
    seps = "\x20\t\n\x0b\x0c\r"
    split = lambda s: [w for w in "".join(" " if c in seps else c for c in s).split(" ") if w]
    ws = split(text or "")
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.line_verdicts(odd_documents(spark)).collect())
    assert got == sorted((str(r[0]), *_quality(r[1])) for r in odd_rows())
    assert quality.line_verdicts(nothing(spark)).count() == 0


def test_quality_removes_frequent_lines(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        own = words(rng, 60)
        text = own if k % 3 else "  The  SAME line " + " of all\n" + own
        if k >= 290:
            text = "\n".join(["the same line of all"] * 1 + [words(rng, 40)]) if k < 295 else "\n".join(f"{x} the same line of all" for x in range(12)) + "\nthe same line of all" * 12
        rows.append((k, text, None, "host", 0, None, None, None, None))
    out = {r["doc_id"]: r for r in quality.line_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0]["n_left"] == out[0]["n_words"] - 5 and out[0]["kept"] is True
    assert out[1]["n_left"] == out[1]["n_words"] and out[1]["kept"] is True
    assert out[299]["n_left"] < out[299]["n_words"]


# --- op5


def toxic_corpus(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        sentences = [words(rng, 9) + "." for _ in range(6)]
        if bad:
            sentences[k % 6] = words(rng, 4) + rng.choice([" zidiotz ", " zmoronz, "]) + words(rng, 3) + "."
        rows.append((k, " ".join(sentences), "en", "s", 0, None, None, None, None))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_located(spark):
    docs, labels = toxic_corpus(spark)
    out = toxicity.toxicity(docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    hits = [r for r in held if r["doc_id"] % 4 == 0 and r["predicted"]]
    assert hits and all(b"zidiotz" in (s := texts[r["doc_id"]][r["top_start"] : r["top_stop"]]) or b"zmoronz" in s for r in hits)


def test_noisy_or_and_its_slopes_against_plain_loops():
    """Scores by a loop over sentences and words, and the slope by a difference quotient."""
    rng = np.random.default_rng(4)
    texts = [words(random.Random(k), 30).replace(" a", ". a").encode() for k in range(12)] + [b"", None, b"one. two! three"]
    b = toxicity.bags(kernel.Texts(texts))
    m = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), -1.0)
    got = toxicity.noisy_or(b, toxicity.sentence_scores(b, m))
    label = rng.integers(0, 2, len(texts)).astype(float)

    def plain(shift=None):
        out = []
        for d in range(len(texts)):
            left = 1.0
            for s in range(len(b.text)):
                if b.text[s] == d:
                    z = m.bias + sum(m.weights[x] for x, k in zip(b.bucket, b.sentence) if k == s) + (1e-6 if s == shift else 0)
                    left *= 1 - 1 / (1 + math.exp(-z))
            out.append(1 - left)
        return out

    assert np.allclose(got, plain()) and got[12] == got[13] == 0

    def loss(score):
        return sum(-math.log(max(p, 1e-6)) if y else -3 * math.log(1 - p) for p, y in zip(score, label))

    slope = toxicity.slopes(b, toxicity.sentence_scores(b, m), label, 3.0)
    for s in range(len(b.text)):
        assert math.isclose(slope[s], (loss(plain(s)) - loss(plain())) / 1e-6, rel_tol=1e-3, abs_tol=1e-4)


def test_toxicity_cross_validation():
    rng = random.Random(2)
    texts = [f"{words(rng, 8)}. {words(rng, 5)} {'zvile' if k % 3 == 0 else ''}. {words(rng, 9)}".encode() for k in range(240)]
    loss, recall, false = toxicity.cross_validate(texts, np.array([int(k % 3 == 0) for k in range(240)]))
    assert loss < 0.1 and recall > 0.98 and false < 0.02


def test_toxicity_odd_inputs(spark):
    docs, labels = toxic_corpus(spark, 80)
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 1)], labels.schema))
    model = toxicity.train(docs, marks)
    rows = toxicity.score_documents(odd_documents(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 and r["top_start"] is None for r in rows if r["n_sentences"] == 0)
    kept = toxicity.reject_toxic(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns
    empty = toxicity.toxicity(odd_documents(spark), spark.createDataFrame([], labels.schema))
    assert empty.count() == len(odd_rows()) and {r["predicted"] for r in empty.collect()} == {0}
    assert toxicity.toxicity(nothing(spark), labels).count() == 0


# --- op7


def test_forward_sums_all_segmentations():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    raw = sorted(n for n in names if n.strip(b" ") or n == b" ")
    number = {r: i for i, r in enumerate(raw)}
    rng = np.random.default_rng(2)
    prob = rng.random((len(raw) + 1, 2))
    prob /= prob.sum(0)

    def brute(word, k):
        letters = [c.encode() for c in " " + word]
        a = [1.0] + [0.0] * len(letters)
        for j in range(1, len(a)):
            for i in range(j):
                s = b"".join(letters[i:j])
                if s in number:
                    a[j] += a[i] * prob[number[s], k]
                elif j == i + 1:
                    a[j] += a[i] * prob[-1, k]
        return math.log(a[-1])

    some = ["the", "internationalisation", "grün", "日本", "x", "q́😀z", "a" * 90, "thethethethethethethethethethethethethethe"]
    got = langid.Lattice([w.encode() for w in some], PIECES).forward(prob)
    for w, r in zip(some, got):
        for k in (0, 1):
            assert math.isclose(r[k], brute(w, k), rel_tol=1e-9), w


def test_expected_counts_of_all_segmentations():
    """The learning step against the enumeration of every segmentation, for short and long words and both alphabets."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    raw = sorted(n for n in names if n.strip(b" ") or n == b" ")
    number = {r: i for i, r in enumerate(raw)}
    rng = np.random.default_rng(5)
    prob = rng.random((len(raw) + 1, 2))
    prob /= prob.sum(0)
    some, counts = ["the", "other", "grün", "日本語の", "q́z"], np.array([[3, 0], [1, 2], [0, 5], [2, 1], [1, 1]], float)
    want = np.zeros(prob.shape)
    for word, n in zip(some, counts):
        letters = [c.encode() for c in " " + word]
        ways = []
        for mask in range(1 << (len(letters) - 1)):
            parts, at = [], 0
            for j in range(1, len(letters) + 1):
                if j == len(letters) or mask >> (j - 1) & 1:
                    parts.append((b"".join(letters[at:j]), j - at))
                    at = j
            if all(p in number or m == 1 for p, m in parts):
                ways.append([number.get(p, len(raw)) for p, _ in parts])
        for k in (0, 1):
            weight = [np.prod(prob[w, k]) for w in ways]
            for w, x in zip(ways, weight):
                np.add.at(want[:, k], w, n[k] * x / sum(weight))
    got = langid.Lattice([w.encode() for w in some], PIECES).expected(prob, counts)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    # a long word is learned like its parts, and its counts add up to its bytes
    long = langid.Lattice([("the other " * 400).replace(" ", "").encode(), ("日本語" * 900).encode()], PIECES)
    out = long.expected(prob, np.array([[1.0, 0.0], [0.0, 1.0]]))
    lengths_ = np.array([len(r) for r in raw] + [3])
    assert np.isclose(out[:, 0] @ lengths_, 1 + 8 * 400) and np.isclose(out[:, 1] @ lengths_, 1 + 9 * 900)


def test_langid_of_scripts_without_spaces(spark):
    rng = random.Random(3)
    letters = {"ja": "のにはをたがでてとしれさいるか日本人語学校", "zh": "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而"}
    rows = []
    for k in range(300):
        lang = list(letters)[k % 2]
        rows.append((k, "".join(rng.choices(letters[lang], k=200)), lang))
    rows.append((900, "".join(rng.choices(letters["ja"], k=400_000)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs, PIECES)).collect()}
    held = [k for k in range(300) if out[k]["held_out"]]
    assert all(out[k]["lang_pred"] == list(letters)[k % 2] for k in held) and out[900]["lang_pred"] == "ja"


def test_langid_learns_every_language_of_many(spark):
    """No bound on the number of languages, and no word is left out."""
    rng = random.Random(6)
    parts = {f"l{k:02d}": [words(rng, 1) + words(rng, 1) for _ in range(6)] for k in range(70)}
    texts, langs = [], []
    for k in range(700):
        lang = list(parts)[k % 70]
        texts.append(" ".join(rng.choices(parts[lang], k=20)))
        langs.append(lang)
    model = langid.fit(texts, langs, PIECES)
    assert model.langs == sorted(parts)
    t = kernel.Texts([x.encode() for x in texts[:70]])
    assert [model.langs[k] for k in langid.text_scores(t, model, langid.Memory(70)).argmax(1)] == langs[:70]


def test_langid_held_out(spark):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "tion", "er", "and", "of"], "de": ["sch", "ung", "der", "ein", "und", "ä"], "xx": ["qua", "zo", "lle", "ñ", "ción", "os"]}
    rows = []
    for k in range(450):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(30)), lang if k % 11 else None, "s", 0, None, None, None, None))
    docs = spark.createDataFrame(rows + [(900, None, "en", None, 0, None, None, None, None), (901, "12 34 !!", "en", None, 0, None, None, None, None), (None, "", None, None, 0, None, None, None, None)], SCHEMA)
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs, PIECES)).collect()}
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == out[None]["lang_pred"] == "und" and out[900]["score"] == 0
    held = [k for k in range(450) if out[k]["held_out"]]
    assert sum(out[k]["lang_pred"] == list(parts)[k % 3] for k in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit([], [], PIECES)).collect()} == {"und"}
    assert langid.predict(nothing(spark), langid.train(nothing(spark), PIECES)).count() == 0


# --- op10


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(50):
        v = rng.sample(range(30), 9)
        best = max((sum(1 for _ in c) for m in range(512) for c in [[v[i] for i in range(9) if m >> i & 1]] if all(x < y for x, y in zip(c, c[1:]))), default=0)
        got = licenses.longest_increasing(v)
        assert len(got) == best and all(v[a] < v[b] for a, b in zip(got, got[1:]))


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    rng = random.Random(4)
    edited = mit.replace("free of charge, ", "").replace("merge, publish, ", "").upper()
    rows = [
        (1, words(rng, 50) + "\n" + mit + "\n" + words(rng, 20)), (2, words(rng, 10) + edited), (3, "Released under the MIT License.\nReleased under the MIT License."), (4, words(rng, 200)),
        (5, "all rights\n reserved"), (6, None), (7, ""), (8, mit[:200]), (9, "License " * 2000), (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None, "b", None, None, None) for i, t in rows], SCHEMA)
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs).collect()}
    assert got[1, "MIT"]["coverage"] == 1 and got[1, "MIT"]["start_word"] == 50 and got[2, "MIT"]["coverage"] >= 0.9
    assert got[3, "MIT-notice"]["n_places"] == 2 and got[5, "reserved-notice"]["coverage"] == 1 and got[None, "CC-BY-NC-4.0-notice"]["coverage"] == 1
    assert not {k for k in got if k[0] in (4, 6, 7, 8, 9)}
    assert licenses.scan(nothing(spark)).count() == 0


def test_license_alignment_loses_nothing():
    """Whatever patience over the whole text finds is found, with insertions of any length and several copies."""
    rng = random.Random(8)
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    ((template,), _, _) = licenses.compiled((("t", body),), 0.8)
    hashed = lambda ws: kernel.Texts([" ".join(ws).encode()]).words(lower=True, trimmed=True).hash.tolist()
    for k in range(300):
        text = body.split()
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = words(rng, 1) if k % 2 else rng.choice(body.split())
        cut = rng.randint(0, len(text))
        text = words(rng, 12).split() + text[:cut] + words(rng, rng.choice([0, 5, 200])).split() + text[cut:] + words(rng, 12).split()
        found = licenses.scan_words(hashed(text), template)
        brute = len(licenses.patience(hashed(text), template.words)) / 10
        assert (found is not None) >= (brute >= 0.8) and (found is None or found[0] >= brute)
        if found and found[3] == 1:
            twice = licenses.scan_words(hashed(text + ["between"] * (k % 3) + text), template)
            assert twice[0] >= found[0] and (twice[3] >= 2 or k % 2 == 0)


@pytest.mark.parametrize("n", [60, 80, 100, 150, 3000])
def test_license_with_a_long_insertion(n):
    rng = random.Random(n)
    for name in ("ISC", "MIT", "GPL-3.0-notice", "BSD-2-Clause"):
        (known, _, _) = licenses.compiled(tuple(licenses.TEMPLATES.items()), 0.8)
        template = next(t for t in known if t.name == name)
        own = licenses.TEMPLATES[name].split()
        text = " ".join(words(rng, 40).split() + own[: len(own) // 2] + words(rng, n).split() + own[len(own) // 2 :])
        coverage, first, end, places, inserted = licenses.scan_words(kernel.Texts([text.encode()]).words(lower=True, trimmed=True).hash.tolist(), template)
        assert coverage == 1 and places == 1 and first == 40 and inserted == n and end == 40 + len(own) + n


def test_license_words_apart(spark):
    rows = [(1, "All of the rights are reserved"), (2, "This fine work is now hereby licensed under the well known GNU General Public License, version 3."), (3, "all " + "x " * 300_000 + "rights reserved")]
    got = {(r["doc_id"], r["license"]): r["n_inserted"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "reserved-notice"): 3, (2, "GPL-3.0-notice"): 5, (3, "reserved-notice"): 300_000}


# --- op6


def plain_alignment(a, b):
    """(score, equal words) of the best local alignment by the full table."""
    table = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            (s, e), up, left = table[i - 1][j - 1], table[i - 1][j], table[i][j - 1]
            cell = max((s + 2, e + 1) if x == y else (s - 1, e), (up[0] - 1, up[1]), (left[0] - 1, left[1]))
            table[i][j] = cell if cell[0] > 0 else (0, 0)
    return max(max(row) for row in table)


def test_smith_waterman_against_full_table():
    rng = random.Random(6)
    for _ in range(60):
        a, b = [rng.randrange(5) for _ in range(12)], [rng.randrange(5) for _ in range(9)]
        table = [[0] * 10 for _ in range(13)]
        for i in range(1, 13):
            for j in range(1, 10):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        score, equal, first, end = decontam.smith_waterman(np.array(a), np.array(b))
        assert score == max(map(max, table)) and (score, equal) == plain_alignment(a, b)
        # the same alignment from its own words alone
        assert decontam.smith_waterman(np.array(a[first:end]), np.array(b))[:2] == (score, equal)


def test_decontamination_over_blocks(spark):
    """Blocks of the benchmark don't influence each other, and equal items each report."""
    rng = random.Random(31)
    items = [(k, words(rng, 25)) for k in range(12)]
    items += [(20 + k, t) for k, t in items[:3]]
    docs = spark.createDataFrame([(k, f"{words(rng, 20)} {items[k % 15][1]} {words(rng, 300)} {items[(k + 7) % 15][1]}") for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert whole and whole == sorted(map(tuple, decontam.leaks(docs, bench, block_bytes=300).collect()))
    kept = {r["doc_id"] for r in decontam.reject_leaks(docs, bench.filter("item_id = 5")).collect()}
    assert kept == {r["doc_id"] for r in decontam.reject_leaks(docs, bench.filter("item_id = 5"), block_bytes=10).collect()} == {k for k in range(30)} - {d for d, i, *_ in whole if i == 5}


def test_decontamination_recall_by_seed(spark):
    """Random substitutions in half of an item's words: seeds of one word find all that the alignment accepts."""
    rng = random.Random(17)
    items, rows = [], []
    for k in range(60):
        own = words(rng, 40).split()
        items.append((k, " ".join(own)))
        for at in rng.sample(range(40), 18):
            own[at] = words(rng, 1) + "zz"
        rows.append((k, f"{words(rng, 30)} {' '.join(own)} {words(rng, 900)}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    w = kernel.Texts([t.encode() for _, t in rows]).words(lower=True, trimmed=True)
    brute = set()
    for k, body in items:
        it = kernel.Texts([body.encode()]).words(lower=True, trimmed=True).hash
        brute |= {(d, k) for d in range(len(rows)) if decontam.smith_waterman(w.hash[w.first[d] : w.last[d]], it)[1] >= 20}
    exact = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, seed=1).collect()}
    usual = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert exact == brute and usual <= brute and len(usual) >= 0.9 * len(brute)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randint(15, 60))) for k in range(20)] + [(90, None), (91, ""), (92, "qq zz"), (None, words(rng, 20))]
    rows, truth = [], set()
    for k in range(300):
        text = words(rng, 120)
        if k % 6 == 0:
            own = items[k % 20][1].split()
            for _ in range(len(own) // 8 if k % 12 else 0):
                own[rng.randrange(len(own))] = words(rng, 1)
            text = words(rng, 40) + "\n" + " ".join(own).upper() + ", " + words(rng, 40)
            truth.add((k, k % 20))
        rows.append((k, text, None, None, 0, "b", "p", None, None))
    rows += [(400, None, None, None, 0, None, None, None, None), (401, "", None, None, 0, None, None, None, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == truth
    # brute force: the alignment of every text with every item
    texts = kernel.Texts([(r[1] or "").encode() for r in rows[:60]])
    w = texts.words(lower=True, trimmed=True)
    brute = set()
    for item, body in items[:20]:
        it = kernel.Texts([body.encode()]).words(lower=True, trimmed=True).hash.tolist()
        for d in range(texts.n):
            if plain_alignment(w.hash[w.first[d] : w.last[d]].tolist(), it)[1] >= 0.5 * len(it):
                brute.add((d, item))
    assert brute == {x for x in truth if x[0] < 60}
    kept = decontam.reject_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in truth}
    assert decontam.leaks(nothing(spark), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_edited_and_partial_copies(spark):
    """Copies with 20 to 40 % of their words replaced and first halves, one each and one in a large group, as by brute force."""
    rng = random.Random(21)
    items = [(k, words(rng, rng.randint(20, 40))) for k in range(40)]
    rows = []
    for k, text in items:
        own = text.split()
        if k % 4 == 3:
            own = own[: (len(own) + 1) // 2]
        else:
            for at in rng.sample(range(len(own)), len(own) * (2 + k % 4) // 10):
                own[at] = words(rng, 1) + "z"
        rows += [(k, f"{words(rng, 30)} {' '.join(own)} {words(rng, 30)}")] * (50 if k < 4 else 1)
    schema = "doc_id long, text string"
    got = decontam.leaks(spark.createDataFrame(rows, schema), spark.createDataFrame(items, "item_id long, text string"))
    w = kernel.Texts([t.encode() for _, t in dict(rows).items()]).words(lower=True, trimmed=True)
    brute = set()
    for k, text in items:
        it = kernel.Texts([text.encode()]).words(lower=True, trimmed=True)
        item, grams = it.hash.tolist(), set(zip(it.hash.tolist(), it.hash[1:].tolist(), it.hash[2:].tolist()))
        for d in range(len(items)):
            own = w.hash[w.first[d] : w.last[d]].tolist()
            if grams & set(zip(own, own[1:], own[2:])) and plain_alignment(own, item)[1] >= 0.5 * len(item):
                brute.add((d, k))
    assert len(brute) >= 36
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert set(found) == brute
    assert all(found.count(x) == (50 if x[0] < 4 else 1) for x in brute)


def test_benchmark_in_blocks(spark):
    rng = random.Random(12)
    items = spark.createDataFrame([(k, words(rng, 20)) for k in range(30)], "item_id long, text string")
    blocks = list(decontam.item_blocks(items, 500))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids) == list(range(30))
