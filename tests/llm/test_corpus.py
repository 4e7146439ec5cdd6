"""Corpus operators on a small hard table, against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralis.llm import bpe_count, decontam, html_extract, minhash, mixing, quality, queries, records, substring
from muralis.llm.bpe_encode import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base, passage = prose(rng, 400), prose(rng, 60)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["CHANGED"] + words[k + 1 :]) for k in (50, 200, 390)]
    out = [None, "", " \n\t ", "one", "one two three four", base, base, base.replace(" ", "\n"), *near, " ".join(words[:330]), "a b " * 3000, prose(rng, 30_000)]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    out += ["same line\n" * 60 + prose(rng, 10), "# $ % & " * 30, "x<|endoftext|>y don't  stop here ½²　日本語", "tab\tand \x1c odd\r\n  spaces"]
    return out + [prose(rng, rng.randint(1, 120)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", -1, "clash") for i, t in enumerate(texts)]
    rows.append((5, texts[5], "en", "s2", -1, "clash"))  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_records_round_trip(spark, docs, texts, empty):
    path = queries.vocabulary()
    got = sorted(records.token_records(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([*range(len(texts)), 5])
    enc, at = Encoder(path), 0
    for r in got:
        ids = np.array([*enc.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert records.token_records(empty, path).collect() == []
    nobody = spark.createDataFrame([(None, "a"), (-3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in sorted(records.token_records(nobody, path).collect(), key=lambda r: r.start)] == [(None, 0), (-3, 2)]


def test_records_stay_where_they_are_put(spark, docs, tmp_path):
    path = queries.vocabulary()
    want = sorted(map(tuple, records.token_records(docs, path).collect()), key=repr)
    assert sorted(map(tuple, records.token_records(docs, path, path=f"{tmp_path}/out").collect()), key=repr) == want
    (tmp_path / "out").rename(tmp_path / "moved")
    other = spark.newSession()
    manifest = records.open_shards(other, f"file://{tmp_path}/moved")
    assert sorted(map(tuple, records.read_shards(other, manifest).collect()), key=repr) == want
    with pytest.raises(Exception, match="(?i)exists"):
        records.token_records(docs, path, path=f"{tmp_path}/moved")
    (tmp_path / "half").mkdir()
    with pytest.raises(Exception, match="(?i)not_found|does not exist"):
        records.open_shards(spark, f"{tmp_path}/half")


def test_frames_tell_damage():
    data = records.frame(records.pack(7, b"\1\2", 2)) + records.frame(b"")
    payload, after = records.unframe(data, 0)
    assert records.unpack(payload)[0] == 7 and records.unframe(data, after) == (b"", len(data))
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 16
        with pytest.raises(ValueError):
            at = 0
            while at < len(broken):
                _, at = records.unframe(bytes(broken), at)


def test_shuffled_reads(docs):
    manifest = records.write_shards(docs.select("doc_id", "text"), queries.vocabulary(), 0)
    path = manifest.first().path
    plain, mixed = ([(i, ids.tolist()) for _, i, ids in records.read_frames(path, seed)] for seed in (None, 3))
    assert plain != mixed and sorted(plain) == sorted(mixed)


def test_token_counts(docs, texts, empty):
    enc = Encoder(queries.vocabulary())
    got = by_id(bpe_count.token_counts(docs, queries.vocabulary()))
    for i, t in enumerate(texts):
        n = len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert bpe_count.token_counts(empty, queries.vocabulary()).collect() == []


def test_quality(docs, texts, empty):
    got = by_id(quality.quality(docs))
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c, hit = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][m] for m in quality.MEASURES) == want, i
        assert got[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.quality(empty).collect() == []


def test_bad_hosts_lose_their_documents(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 100 == 0 or i >= 400 else "bad", "junk" if i < 400 else f"h{i % 5}") for i in range(700)]
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(got[i].kept for i in range(400)) and all(got[i].kept for i in range(400, 700))


def test_near_duplicates(docs, texts, empty):
    got = by_id(minhash.near_duplicates(docs))
    sets = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else None for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = sum((sets[a] & sets[b]).values())
                if common >= 0.8 * (sets[a].total() + sets[b].total() - common):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = [new if x == old else x for x in label]
    assert [got[i].class_id for i in range(len(texts))] == label
    assert minhash.near_duplicates(empty).collect() == []


def test_near_duplicates_in_large_buckets(spark):
    """A form with sixty yes/no fields: every shingle is in half of the texts or more, so hardly a bucket is small;
    only copies that differ in few fields are near-duplicates."""
    rng = np.random.default_rng(11)
    filled = rng.integers(0, 2, (500, 60))
    copies = filled[:60].copy()
    for row in copies:
        row[rng.choice(60, 10, replace=False)] ^= 1
    filled = np.concatenate([copies, filled])
    texts = [" ".join(f"{'no' if x else 'yes'}{k} " + " ".join(f"f{k}w{j}" for j in range(9)) for k, x in enumerate(row)) for row in filled]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    number = {x: i for i, x in enumerate(set().union(*shingles))}
    has = np.zeros((len(texts), len(number)))
    for row, x in zip(has, shingles, strict=True):
        row[[number[y] for y in x]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    near = common >= 0.8 * (size[:, None] + size - common)
    label = np.arange(len(texts))
    for _ in label:
        label = np.where(near, label, len(texts)).min(axis=1)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert 490 < len(set(label)) <= 500
    assert [got[i].class_id for i in range(len(texts))] == label.tolist()


def near_classes(texts, similarity=0.8):
    """Least index of each text's class, by all pairs of multisets of five-word runs."""
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else None for t in texts]
    number: dict = {}
    for bag in bags:
        for x, c in (bag or {}).items():
            for k in range(c):
                number.setdefault((x, k), len(number))
    has = np.zeros((len(texts), len(number)), np.float32)
    for row, bag in zip(has, bags, strict=True):
        row[[number[x, k] for x, c in (bag or {}).items() for k in range(c)]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    near = (common >= similarity * (size[:, None] + size - common) - 1e-6) & (size[:, None] > 0) & (size > 0)
    np.fill_diagonal(near, True)
    label = np.arange(len(texts))
    while True:
        new = np.where(near, label, len(texts)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates_in_one_cluster_of_2000_edited_copies(spark):
    rng = random.Random(21)
    base = prose(rng, 120).split(" ")
    texts = []
    for _ in range(2000):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = near_classes(texts)
    assert 1 < len(set(want)) < 1900
    assert [got[i].class_id for i in range(2000)] == want


def test_near_duplicates_of_the_documents_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = by_id(minhash.near_duplicates(spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")))
    assert [got[i].class_id for i in range(len(rows))] == near_classes([r.text for r in rows])


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    keys, docs_, counts = np.concatenate([h, h]), np.repeat([0, 1], 300), np.concatenate([a, b])
    sig = minhash.bag_minhash(keys, docs_, counts, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_repeated_passages(docs, texts, empty):
    got = by_id(substring.remove_repeats(docs))
    words = [WORD.findall(t or "") for t in [*texts, texts[5]]]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for i, w in enumerate(words[:-1]):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), kept), i
    assert substring.remove_repeats(empty).collect() == []


def test_repeated_passages_with_split_minimisers(docs):
    plain, split = (sorted(map(tuple, substring.remove_repeats(docs, hot=h).collect()), key=repr) for h in (2_000, 2))
    assert plain == split


def test_repeated_passages_window_by_window(docs):
    """Minimisers of more than ``bucket_bytes`` are counted window by window."""
    plain, single = (sorted(map(tuple, substring.remove_repeats(docs, bucket_bytes=b).collect()), key=repr) for b in (2 << 20, 300))
    assert plain == single


def test_repeated_passages_of_many_equal_rows(spark):
    text = prose(random.Random(4), 4000)
    df = spark.range(1500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    rows = substring.remove_repeats(df).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert [tuple(r) for r in rows] == [(7, 4000, 4000, "", 1500)]


def test_contamination(spark, docs, texts, empty):
    items = [(1, " ".join(texts[14].split(" ")[28:60])), (2, "nothing like it in any of these documents at all"), (3, None), (10, "One, two; THREE four"), (11, " ".join(texts[13].split(" ")[100:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    got = by_id(decontam.contamination(docs, bench))
    for i, t in enumerate(texts):
        w, hit, who = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= found
        want = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want, i
    # without broadcasts, candidates come back to their documents in blocks
    assert sorted(map(tuple, decontam.contamination(docs, bench, broadcast_rows=0, block=20).collect()), key=repr) == sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=repr)
    assert decontam.contamination(empty, bench).collect() == []
    assert not any(r.n_hit for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (1 + (i * 37) % 300), None if i % 10 == 0 else f"s{min(i % 10, 4)}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=512).collect()
    again = mixing.mix(df.repartition(3), block=512).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source, taken, target = {i: s for i, _, s in rows}, collections.Counter(), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(got) == 9000 and all(abs(taken[s] - t) <= 0.005 * t for s, t in target.items())
    assert mixing.mix(empty).collect() == [] and mixing.mix(docs).count() == docs.count()


def test_mix_of_a_small_source_beside_a_large_one(spark):
    """However many blocks other sources need, each meets its target, whatever its longest document."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), "a") for i in range(1500)]
    rows += [(10_000 * (k + 1) + i, "w " * (5000 if i == 0 else rng.randint(1, 400)), f"b{k}") for k in range(4) for i in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(4.0, 1.0, 1.1, 1.2, 1.3), share=0.7, block=256).collect()
    source, taken, target = {i: s for i, _, s in rows}, collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 20 for s, t in target.items()), (taken, target)


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    """Every capped set is tried by adding the sources that are above, until none is."""
    full = set()
    while True:
        open_ = [i for i, x in enumerate(sizes) if x > 0 and i not in full]
        left = share * sum(sizes) - sum(cap * sizes[i] for i in full)
        out = [cap * x if i in full else left * weights[i] / sum(weights[j] for j in open_) if i in open_ else 0.0 for i, x in enumerate(sizes)]
        over = {i for i in open_ if out[i] > cap * sizes[i]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [0, 0], [], [100, 1, 1], [1, 2, 3, 4, 5000, 6, 7], [1000, 3, 0, 40, 7]])
def test_targets(spark, sizes):
    rows = [(i, "w " * n, f"s{i:02d}" if i < len(sizes) - 1 else None) for i, n in enumerate(sizes)]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[i].target for i in range(len(sizes))] == pytest.approx(want)
    assert [(got[i].size, got[i].source_size) for i in range(len(sizes))] == [(n, n) for n in sizes]


def test_mix_of_repeated_ids_agrees(spark):
    rng = random.Random(9)
    rows = [(i % 7, "w " * rng.randint(1, 9) + str(i % 90), "a" if i % 2 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (collections.Counter(map(tuple, mixing.mix(x, key=True).collect())) for x in (df, df.repartition(3, "text")))
    assert first == again
    first, again = (collections.Counter(map(tuple, mixing.resample(x).collect())) for x in (df, df.repartition(3, "text")))
    assert first == again and set(first) <= set(rows)


def test_draws_keep_probabilities():
    size = np.sort(np.random.default_rng(2).integers(1, 100, 60))[::-1].astype(float)
    seen = np.zeros(60)
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        seen += mixing.landing(mixing.flight(mixing.outliers(np.full(60, 0.3), size, rng), size, rng), size, rng)
    assert abs(seen / 3000 - 0.3).max() < 0.04


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    p, size = rng.random(500), np.sort(rng.integers(1, 1000, 500))[::-1].astype(float)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3


def test_main_text(spark):
    pages = [
        "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First\n  line<br>goes on <b>bold</b><p>Second<script>var t='</p>';</script></article><aside>more</aside><footer>(c)</footer>",
        None, "", "plain < text", "<div class=content><p>Only words of an article here, and more of them.</p></div><div class=comments><p>Nice one</p></div>",
    ]
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[0] == "A & B\nFirst line goes on bold\nSecond"
    assert got[1] == got[2] == "" and got[4] == "Only words of an article here, and more of them."
    assert html_extract.main_text(df.limit(0)).collect() == []


def test_held_out_accuracy():
    weights, edge = html_extract.train()
    right = total = 0
    for page, label in html_extract.labelled_pages(100, seed=77):
        found = html_extract.Forest([page]).marginals(weights, edge)[0] > 0.5
        right, total = right + int((found == label).sum()), total + len(label)
    assert right >= 0.99 * total


def test_many_equal_rows_part_over_blocks(spark):
    """Two thirds of a source are one row; its copies fill many blocks, and totals stay."""
    same = [(1, "a b c d e", "s")] * 6000
    rows = spark.createDataFrame(same + [(i, "w " * (i % 40), "s") for i in range(2, 3000)] + [(-1, "x y", "t")] * 20, "doc_id long, text string, source string")
    got = mixing.mix(rows, block=256).collect()
    assert len(got) == 6000 + 2998 + 20
    for other in (False, True):
        own = [r for r in got if (r.doc_id == -1) == other]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 80
    assert all(r.taken % r.size == 0 and r.taken <= 2 * r.size for r in got if r.size)
