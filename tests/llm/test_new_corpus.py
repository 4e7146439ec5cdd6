"""Operators 11 to 13 on a small hard table, against the library and plain Python."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from muralis.llm import packing, queries, runs, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, word string, n long, length string, runs string, block int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randint(4, 9))) for _ in range(40)]

    def word():
        w = rng.choice(stems)
        return w if rng.random() < 0.8 else w[: rng.randint(0, 3)] + rng.choice("abzÀ") + w[rng.randint(2, 4) :]

    texts = [None, "", " \n\t", "one", "tick tock " * 400, "a b c " * 40 + "x " + "a b c " * 40, "A" * 3000, "don't 'S ''ll'd <|endoftext|> x<|startoftext|>y Ç×÷ ½ “quoted” 日本 é"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(150)]
    texts += [" ".join(word() for _ in range(9000)), " ".join([*(word() for _ in range(30)), *(["u", "v"] * 30), *(["v"] * 30)])]
    texts += ["lllongword" * 30 + " " + "lllongword" * 29 + "lllongwor"] * 3
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, *out[8:12], *out[8:12], (None, "alpha beta"), (None, "alpha beta"), (-7, "tick tock " * 30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash", 2) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# packing


@pytest.mark.parametrize(("capacity", "block", "slack"), [(4096, 1 << 16, 64), (64, 40, 2)])
def test_packing(spark, docs, rows, empty, capacity, block, slack):
    path = queries.vocabulary("word_bpe_49k.json")
    library = packing.WordEncoder(path).tokenizer
    got = packing.pack_sequences(docs, path, capacity=capacity, block=block, slack=slack).collect()
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(held) <= 1.04 * total / capacity + 2
    assert packing.pack_sequences(empty, path).collect() == []


def test_packing_places_by_sums_of_squares():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.choice([10, 37])
        lengths = [rng.randint(1, capacity) for _ in range(80)]
        bins, offsets, gaps = packing.sum_of_squares(lengths, capacity)
        left: list[int] = []

        def squares(levels):
            return sum(n * n for g, n in collections.Counter(levels).items() if g)

        for s, b, o in zip(lengths, bins, offsets, strict=True):
            choices = [squares([*left[:i], g - s, *left[i + 1 :]]) for i, g in enumerate(left) if g >= s]
            choices.append(squares([*left, capacity - s]))
            left = [*left, capacity] if b == len(left) else left
            assert o == capacity - left[b]
            left[b] -= s
            assert left[b] >= 0 and squares(left) == min(choices)
        assert left == gaps


def test_equal_rows_are_spread_when_packing(spark):
    same = spark.createDataFrame([(1, "a b c d e f g")] * 3000, "doc_id long, text string")
    got = packing.pack_sequences(same, queries.vocabulary("word_bpe_49k.json"), capacity=64, block=500)
    assert got.select("sequence_id", "offset").distinct().count() == 3000
    assert got.select("sequence_id").distinct().count() <= 3000 / 8 + 7


def test_word_encoder_equals_the_library():
    enc = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    rng = random.Random(5)
    alphabets = ["aAbzZ'stdmrevl ÀÉéÿß×÷İıſŉΣς09 .,!<|>_\n\t\r\x0b \x1c\x7f 　½²日́😀", "aAbzZ''stdmrevl ÀÞéÿß×÷09 .,\n\t\r"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 25))) for a in alphabets for _ in range(4000)]
    texts += ["x<|endoftext|>", None, "<|startoftext|> 'll"]
    ids, at = enc.encode_all(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids, text


# runs


def brute_runs(words, min_length=24, min_exponent=3):
    out, n = [], len(words)
    for p in range(1, n // min_exponent + 1):
        same = [words[i] == words[i + p] for i in range(n - p)]
        i = 0
        while i < n - p:
            if not same[i]:
                i += 1
                continue
            j = i
            while j < n - p and same[j]:
                j += 1
            length = j + p - i
            if length >= max(min_length, min_exponent * p):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                    out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def report(doc_id, words):
    found = brute_runs(words)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest(),
    )


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_documents(docs, rows, empty):
    got = runs.digest(runs.periodic_runs(runs.with_planted_periods(docs)))
    want = [report(i, planted(i, WORD.findall(t or ""))) for i, t in rows if len(t or "") < 40_000]
    assert sum(w[1] for w in want) > 10
    long = {i for i, t in rows if len(t or "") >= 40_000}
    assert collections.Counter(map(tuple, (r for r in got.collect() if r.doc_id not in long))) == collections.Counter(want)
    assert runs.digest(runs.periodic_runs(empty)).collect() == []


def test_runs_of_symbols():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 70), rng.randint(1, 3)
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 2 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([3, 6, 24])
        first = np.append(0, np.cumsum([len(w) for w in texts]))
        start, length, period = runs.find_runs(np.array(sum(texts, []), np.int64), first, least, 3)
        got = [[] for _ in texts]
        for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
            d = int(np.searchsorted(first, s, "right")) - 1
            got[d].append((s - int(first[d]), n, p))
        assert got == [brute_runs(w, least) for w in texts]


def test_runs_of_a_very_long_text(spark):
    text = "x " * 300_000 + "y " + "p q r " * 100_000
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 1), (300_001, 300_000, 3)]
    assert row.collapsed == "x y p q r" and tuple(row.greatest) == (0, 300_000, 1) and row.n_words == 600_001


# spelling


def brute_spelling(rows, typo=97):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if typo and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    near_of = {w: [x for x in known if near(w, x)] for w in known}
    best = {w: min(near_of[w], key=lambda x: (-known[x], x), default=None) for w in known}
    form = {w: b if b is not None and known[b] >= 2 * known[w] else None for w, b in best.items()}
    out = {}
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (known[w], len(near_of[w]), form[w], known.get(form[w]), root)
    return out


@pytest.mark.parametrize(("typo", "bits"), [(97, 27), (3, 9)])
def test_spelling_variants(docs, rows, typo, bits):
    want = brute_spelling(rows, typo)
    assert sum(v[2] is not None for v in want.values()) > 20 and any(v[4] != v[2] for v in want.values() if v[2]) and max(map(len, want)) > 200
    got = spelling.spelling_variants(docs, typo=typo, bits=bits).collect()
    assert len(got) == len(want) and {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_variants(empty).collect() == []
    few = spark.createDataFrame([(1, "seldom words"), (2, None)], "doc_id long, text string")
    assert spelling.spelling_variants(few).collect() == []


def test_roots_follow_long_chains(spark):
    n = 70
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < n - 1 else None) for i in range(n)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {f"w{n - 1}"}


def test_strings_are_distinct_and_whole():
    hood = spelling.Neighbours([ord(c) for c in "abc"])

    class Everything:
        def has(self, x):
            return np.ones(x.shape, bool)

    for word in ("a", "aab", "abcab", "ccc", "aabbaa"):
        letters = np.array([[ord(c) for c in word]], np.uint32)
        made = [t for _, m in hood.strings(letters, Everything(), piece=5) for t in spelling._texts(m)]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for c in "abc" for k in (0, 1) for i in range(len(word) + 1 - k)}
        assert sorted(made) == sorted(want - {word})
        by_hash = {int(hood.hashes(np.array([[ord(c) for c in t]], np.uint32))[0]) for t in made if t}
        assert len(by_hash) == len([t for t in made if t])
