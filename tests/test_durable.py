"""Durable ingest in any cut against one full replay; keyed deduplication; the offline queue."""

import random

import pytest
from pyspark.sql import functions as F

from muralis.operators import verify
from muralis.streaming import durable, queue
from tests.test_verify import ACTION, SCHEMA, crowd

FULL = SCHEMA + ", client_uuid string"


def frame(spark, reports):
    return spark.createDataFrame([(*(r[c.split()[0]] for c in SCHEMA.split(", ")), r.get("client_uuid", f"u{r['id']}")) for r in reports], FULL)


def acts_frame(spark, actions):
    return spark.createDataFrame([(a["action_id"], a["report_id"], a["action"], a["at_us"]) for a in actions], "action_id long, report_id long, action string, at_us long")


def rows_of(decisions):
    return {r.id: (r.state, r.score, r.site_key, r.duplicate_of, tuple(r.codes)) for r in decisions.collect()}


@pytest.mark.parametrize("reviewed", [False, True])
def test_any_cut_gives_one_replay(spark, tmp_path, reviewed):
    reports, rng = crowd(120, 6), random.Random(3)
    for r in reports[40:60]:  # sound reports of one device, most of them pending until it floods
        r.update(device="flood", captured_us=r["received_us"], accuracy_m=5.0, blur_score=0.1, patch_found=True, quality="good", n_cracks=1, width=0.5)
        if r["id"] % 4:
            r.update(fp=rng.getrandbits(63), lat=38 + r["id"] / 50)
    actions = [{"action_id": k, "report_id": (j := rng.randrange(1, 110)), "action": rng.choice(list(ACTION)), "at_us": reports[j - 1]["received_us"] + 1 + rng.randrange(12_000_000_000)} for k in range(60)] if reviewed else []
    want = rows_of(verify.decide(frame(spark, reports), None, acts_frame(spark, actions) if reviewed else None))
    assert len(want) == 120 and {"FLOODING_RETRO", "FLOODING"} <= {c for w in want.values() for c in w[4]}
    cuts = [0, 50, 52, 97, 120] if not reviewed else [0, 45, 90, 120]
    store = durable.Store(spark, f"file://{tmp_path}/store")
    done = -1
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        until = reports[b - 1]["received_us"] if b < 120 else 1 << 60
        since = [x for x in actions if done < x["at_us"] <= until]
        assert store.commit(k, frame(spark, reports[a:b]), acts_frame(spark, since) if reviewed else None)
        done = until
        if k == 1:
            before = rows_of(store.decisions())
            assert not store.commit(k, frame(spark, reports[a:b])) and not store.commit(0, frame(spark, reports))
            assert rows_of(store.decisions()) == before
            store.compact()
            assert rows_of(store.decisions()) == before
    assert rows_of(store.decisions()) == want
    assert {r.site_key for r in store.sites().collect()} == {i for i, w in want.items() if w[2] == i}


def test_slices_give_one_replay(spark):
    reports, rng = crowd(100, 9), random.Random(4)
    actions = [{"action_id": k, "report_id": (j := rng.randrange(1, 90)), "action": rng.choice(list(ACTION)), "at_us": reports[j - 1]["received_us"] + 1 + rng.randrange(9_000_000_000)} for k in range(40)]
    df, acts = frame(spark, reports), acts_frame(spark, actions)
    whole = {r.id: tuple(r) for r in verify.evaluate(df, acts).collect()}
    assert {r.id: tuple(r) for r in verify.evaluate_in_slices(df, acts, slices=3).collect()} == whole and len(whole) == 100


def test_resent_reports_and_lost_attempts(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    reports = crowd(12, 1)
    store = durable.Store(spark, root)
    assert store.decisions() is None and store.table("reports") is None
    store.commit(7, frame(spark, reports[:8]), tables={"notes": spark.createDataFrame([(1, "x")], "id long, note string")})
    again = [dict(r, id=r["id"] + 100, client_uuid=f"u{r['id']}") for r in reports[6:10]]
    store.commit(8, frame(spark, again))
    assert sorted(r.id for r in store.table("reports").collect()) == [*range(1, 9), 109, 110]
    assert store.table("notes").count() == 1
    frame(spark, reports).write.parquet(f"{root}/data/000000000009-lost/reports")  # an attempt that never came to its commit
    assert store.table("reports").count() == 10
    with pytest.raises(durable.Conflict):
        store._publish({"version": 2, "batch": 9, "folders": []})
    assert store.commit(9, frame(spark, []))
    assert store.table("reports").count() == 10 and store.decisions().count() == 10


def test_stream_of_resent_reports(spark, tmp_path):
    reports = crowd(60, 2)
    sent = [dict(r, client_uuid=f"u{r['id'] % 45}") for r in reports]
    for k in range(3):
        frame(spark, sent[k * 20 : k * 20 + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = durable.Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(FULL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        durable.ingest(stream, store, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.id for r in store.table("reports").collect()) == list(range(1, 46))
    assert rows_of(store.decisions()) == rows_of(verify.decide(frame(spark, sent[:45])))


QUEUE = "device string, at timestamp, id long, client_uuid string, link boolean, valid boolean"
MIN = 60_000_000


def brute_queue(rows, watermark, first=10 * MIN, retries=12):
    log, devices = [], {}
    for r in rows:
        devices.setdefault(r[0], []).append(r)
    for device, own in devices.items():
        waiting, since, tried = {}, None, 0
        feed = sorted((r for r in own if r[1] <= watermark), key=lambda r: (r[1], r[2]))
        for r in [*feed, None]:
            until = r[1] if r else watermark
            while since is not None and tried < retries and since + first * (2 ** (tried + 1) - 1) <= until:
                at = since + first * (2 ** (tried + 1) - 1)
                for u, w in waiting.items():
                    w[1] += 1
                    log.append((device, u, w[0], w[1], at, "failed"))
                tried += 1
            if r is None:
                break
            waiting.pop(r[3], None)
            waiting[r[3]] = [r[1], 0, r[5]]
            if r[4]:
                for u, w in waiting.items():
                    log.append((device, u, w[0], w[1] + 1, r[1], "sent" if w[2] else "refused"))
                waiting, since = {}, None
            else:
                waiting[r[3]][1] = 1
                log.append((device, r[3], r[1], 1, r[1], "failed"))
                if since is None:
                    since, tried = r[1], 0
    return sorted(log, key=repr)


@pytest.mark.parametrize("files", [1, 4])
def test_offline_queue_in_any_cut(spark, tmp_path, files):
    rng = random.Random(files)
    rows = []
    for i in range(120):
        at = i * 7 * MIN + 1234
        rows.append((rng.choice(["a", "b", None]), at, i, f"u{rng.randrange(60)}", rng.random() < 0.35, rng.random() < 0.8))
    per = len(rows) // files
    for k in range(files):
        part = rows[k * per : (k + 1) * per]
        rng.shuffle(part)
        df = spark.createDataFrame([(r[0], r[1], *r[2:]) for r in part], QUEUE.replace("timestamp", "long"))
        df.withColumn("at", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    queue.use_rocksdb(spark)
    stream = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = queue.offline_queue(stream, "30 minutes")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*queue.LOG.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")).collect()), key=repr)
    assert got == brute_queue(rows, rows[-1][1] // 1000 * 1000 - 30 * MIN)
    assert {r[5] for r in got} == {"failed", "sent", "refused"} and max(r[3] for r in got) > 3
