"""Pairs of large buckets: items are counted by slots, never joined one by one."""

import random

from muralis.llm import minhash


def _texts(spark, path):
    rng = random.Random(8)
    base = rng.sample(range(1 << 62), 60)
    lists = []
    for i in range(120):
        own = rng.sample(range(1 << 62), 60)
        k = rng.randrange(3, 20)
        lists.append([*base[k:], *own[:k]] if i % 3 else own)
    rows = [(bytes([i]), len(x), bytes([i % 7]), x) for i, x in enumerate(lists)]
    spark.createDataFrame(rows, "fp binary, n long, comp binary, items array<long>").write.parquet(path)
    df = spark.read.parquet(path)
    return rows, df.select("fp", "n", "comp"), df.select("fp", "items")


def test_prefix_pairs_miss_none_however_few_slots(spark, tmp_path):
    rows, docs, items = _texts(spark, str(tmp_path / "t"))
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and share(a[3], b[3]) >= 0.8}
    assert len(want) > 100
    for bits in (8, 22):
        got = {tuple(sorted((bytes(r.p), bytes(r.q)))) for r in minhash.prefix_pairs(docs, items, 0.8, bits=bits).collect()}
        assert want <= got


def test_no_row_for_each_item(spark, tmp_path):
    _, docs, items = _texts(spark, str(tmp_path / "t"))
    made = []
    kept, minhash.stash = minhash.stash, lambda df, label: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label)
    try:
        minhash.prefix_pairs(docs, items, 0.8)
    finally:
        minhash.stash = kept
    assert not any("explode(array_distinct(items" in plan or "explode(items" in plan for plan in made) and len(made) == 3
