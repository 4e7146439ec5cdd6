"""The pipeline's stages, each on its own input, against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from muralis.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ("kept", "n_words", "rk", "key", "whole", "row", "host", "contaminated", "n_hit", "copies", "times", "class_id", "text_", "size", "taken", "base_failed", "bad", "nth")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def bench_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def failed(text):
    w = WORD.findall(text or "")
    c, hit = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


def good_quality(rows):
    """Operator 8: base rules, then hosts by their shrunk failure rate."""
    bad = [failed(r[1]) for r in rows]
    n, k = collections.Counter(r[3] for r in rows), collections.Counter(r[3] for r, b in zip(rows, bad, strict=True) if b)
    total, mean = len(rows), sum(bad) / max(len(rows), 1)
    weight = 1e9
    if len(n) > 1 and 0 < mean < 1:
        s = sum(k[h] ** 2 / n[h] for h in n)
        between = (s - total * mean**2 - (len(n) - 1) * mean * (1 - mean)) / max(total - sum(x * x for x in n.values()) / total - (len(n) - 1), 1e-9)
        weight = max(2.0, mean * (1 - mean) / between - 1) if between > 0 else weight
    out = {h for h in n if (k[h] + mean * weight) / (n[h] + weight) > 0.8}
    return [r for r, b in zip(rows, bad, strict=True) if not b and r[3] not in out]


def one_of_each(rows):
    """Operator 2: the least id of each class; of rows with one id and text, one."""
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (WORD.findall(r[1] or "") for r in rows)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b]:
                common = (bags[a] & bags[b]).total()
                if common and common >= 0.8 * (bags[a].total() + bags[b].total() - common):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if x == old else x for x in label]
    best = {}
    for r, c in zip(rows, label, strict=True):
        best[c] = min(best.get(c, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    return list(best.values())


def clean(rows, items):
    windows = {tuple(w[k : k + 13]) for w in map(bench_words, items) for k in range(max(1, len(w) - 12) if w else 0)}
    out = []
    for r in rows:
        w, hit = bench_words(r[1]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [prose(rng, 30) for _ in range(3)] + [None, "few words"]
    texts = [prose(rng, rng.randint(55, 160)) for _ in range(150)]
    texts += [" ".join([w if j != 20 else "changed" for j, w in enumerate(t.split(" "))]) for t in texts[:20]]
    texts += [f"{prose(rng, 60)} {items[k % 3]} {prose(rng, 50)}" for k in range(6)] + [f"{prose(rng, 900)} {items[0]}"]
    texts += [None, "", " \n ", "short", "a b c " * 200, prose(rng, 12_000), texts[3], texts[3]]
    rows = [(i, t, "en", rng.choice(["a", "a", "b", "c", None]), 1) for i, t in enumerate(texts)]
    rows += [(2000 + i, "junk", "en", "spam", 1) for i in range(40)] + [(2040, texts[50] + " spam", "en", "spam", 1)]
    rows += [rows[5], rows[5], (rows[6][0], rows[6][1], "de", "b", 2), (None, prose(rng, 70), None, None, None), (None, prose(rng, 80), None, "a", None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def run_stages(spark, docs, folder, out):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k == 4:
            yield docs, made
            return
        assert made.columns == docs.columns
        made.write.parquet(f"{out}/{k}")
        before, docs = docs, spark.read.parquet(f"{out}/{k}")
        yield before, docs


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_against_plain_python(spark, folder, tmp_path):
    path, _, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = list(run_stages(spark, docs, path, tmp_path))
    rows = [[tuple(r) for r in before.collect()] for before, _ in steps]
    assert counted(steps[0][1]) == collections.Counter(good_quality(rows[0]))
    # rows that tie in id and text stand in for each other
    assert sorted((repr(r[:2]) for r in counted(steps[1][1]).elements())) == sorted(repr(r[:2]) for r in one_of_each(rows[1]))
    assert counted(steps[2][1]) == collections.Counter(clean(rows[2], items))
    assert len(rows[0]) > len(rows[1]) > len(rows[2]) > len(rows[3]) > 100
    mixed, given = counted(steps[3][1]), collections.Counter(rows[3])
    assert all(n <= 2 * given[r] for r, n in mixed.items())
    size = lambda r: len(WORD.findall(r[1] or ""))
    sources = sorted({r[3] for r in given}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) * n for r, n in given.items() if r[3] == s) for s in sources]
    goal = queries_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    for s, t in zip(sources, goal, strict=True):
        assert abs(sum(size(r) * n for r, n in mixed.items() if r[3] == s) - t) <= 0.02 * t
    got = sorted(steps[4][1].collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(queries.vocabulary()), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == sorted((repr(r[0]), crc(r[1])) for r in mixed.elements())
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == collections.Counter(map(tuple, got))


def queries_targets(sizes, weights, share=1.5, cap=2.0):
    full = set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = share * sum(sizes) - sum(cap * sizes[i] for i in full)
        out = [cap * sizes[i] if i in full else left * weights[i] / sum(weights[j] for j in open_) for i in range(len(sizes))]
        over = {i for i in open_ if out[i] > cap * sizes[i]}
        if not over:
            return out
        full |= over


def test_clashing_names_come_through(spark, folder, tmp_path):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in CLASHING:
        docs = docs.selectExpr("*", f"concat('{name}', coalesce(doc_id, -1)) as {name}")
    for k, (_, after) in enumerate(run_stages(spark, docs, path, tmp_path)):
        if k < 4:
            assert all(r[name] == f"{name}{-1 if r.doc_id is None else r.doc_id}" for r in after.collect() for name in CLASHING)


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, after in run_stages(spark, empty, path, tmp_path):
        assert after.collect() == []
