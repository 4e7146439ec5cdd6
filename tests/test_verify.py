"""The distributed fold against a report-by-report replay, and the rules' published examples."""

import math
import random

import pytest

from muralis.config import DELTAS, RULES
from muralis.operators import verify

SCHEMA = "id long, device string, received_us long, captured_us long, lat double, lon double, accuracy_m double, blur_score double, patch_found boolean, quality string, n_cracks int, width double, fp long"
DAY, MINUTE, HOUR = 86_400_000_000, 60_000_000, 3_600_000_000
ACTION = {"accept": "accepted", "reject": "rejected", "close": "closed", "hold": "held", "reopen": "pending"}


def metres(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(x))


def replay(reports, actions=()):
    """One report after another, with the state of all earlier ones at hand."""
    past, out = [], {}
    feed = sorted([(r["received_us"], 1, r["id"], r) for r in reports] + [(a["at_us"], 0, a["action_id"], a) for a in actions], key=lambda e: e[:3])
    for now, kind, _, e in feed:
        if kind == 0:
            hit = next((c for c in past if c["id"] == e["report_id"]), None)
            if hit:
                hit["state"] = ACTION[e["action"]]
                if hit["state"] in ("accepted", "pending") and hit["site"] is None:
                    hit["site"] = hit["id"]
            continue
        r = dict(e)
        dlat = 500 / 111320
        dlon = dlat / max(0.2, math.cos(math.radians(r["lat"])))
        box = [c for c in past if c["state"] != "rejected" and abs(c["lat"] - r["lat"]) <= dlat + 1e-12 and abs(c["lon"] - r["lon"]) <= dlon + 1e-12]
        near = [(bin((c["fp"] ^ r["fp"]) & (2**64 - 1)).count("1"), metres(r, c), c["id"], c) for c in box]
        radius = min(50, max(15, r["accuracy_m"]))
        scene = sorted((x for x in near if x[1] <= radius and x[0] <= 18), key=lambda x: x[:3])
        ring = [x for x in near if 50 < x[1] <= 500 and x[0] <= 12 and x[3]["state"] != "held"]
        site = next((x[3]["site"] for x in scene if x[3]["site"]), None)
        codes, parent = [], None
        for h, m, _, c in sorted((x for x in near if x[1] <= 50), key=lambda x: x[:3]):
            hours = abs(r["captured_us"] - c["captured_us"]) / HOUR
            code = "DUPLICATE_SAME_DEVICE" if c["device"] == r["device"] and h <= 18 and hours <= 24 else "DUPLICATE_SAME_PHOTO" if h <= 8 and hours <= 2 else None
            if code:
                parent, site = c["dup"] or c["id"], site or c["site"]
                codes.append(code)
                break
        if any(bin((c["fp"] ^ r["fp"]) & (2**64 - 1)).count("1") <= 8 and metres(r, c) > 200 for c in past):
            codes.append("PHOTO_REUSED_ELSEWHERE")
        elif ring and not scene:
            codes.append("SCENE_ELSEWHERE")
        late = r["captured_us"] - now
        mine = [c for c in past if c["device"] == r["device"]]
        done = [c["state"] for c in mine if c["state"] in ("accepted", "rejected", "closed")]
        checks = {
            "CALIBRATION_MISSING": not r["patch_found"], "CALIBRATION_POOR": r["patch_found"] and r["quality"] == "poor", "GPS_IMPRECISE": r["accuracy_m"] > 50, "IMAGE_BLURRY": r["blur_score"] > 0.6,
            "NO_DETECTION": r["n_cracks"] == 0, "IMPLAUSIBLE_WIDTH": (r["width"] or 0) > 50, "FUTURE_TIMESTAMP": late / MINUTE > 10, "STALE_PHOTO": -late / DAY > 30,
            "FLOODING": sum(c["received_us"] >= now - HOUR for c in mine) >= 6, "DEVICE_HISTORY": len(done) >= 3 and done.count("rejected") / len(done) >= 0.5,
            "CORROBORATED": bool(site and not parent and {x[3]["device"] for x in scene if x[3]["state"] == "accepted"} - {r["device"]}),
        }
        codes += [k for k, v in checks.items() if v]
        score = 1.0
        for c in codes:
            score += DELTAS.get(c, 0.0)
        score = max(0.0, min(1.0, score))
        r["state"] = "merged" if parent else "held" if score < RULES.hold_below else "pending"
        r["site"], r["dup"] = site or (r["id"] if r["state"] == "pending" else None), parent
        if checks["FLOODING"]:
            for c in mine:
                if c["state"] == "pending" and c["received_us"] >= now - HOUR:
                    c["state"] = "held"
                    out[c["id"]][1].append("FLOODING_RETRO")
        past.append(r)
        out[r["id"]] = [score, codes]
    return {c["id"]: (c["state"], out[c["id"]][0], c["site"], c["dup"], tuple(out[c["id"]][1])) for c in past}


def report(i, at=0, **more):
    base = dict(id=i, device="a", received_us=at, captured_us=at, lat=37.5665, lon=126.978, accuracy_m=8.0, blur_score=0.2, patch_found=True, quality="good", n_cracks=1, width=0.84, fp=0x1F3C1A7B52D6E084)
    return base | more


def run(spark, reports, actions=None):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in reports], SCHEMA)
    acts = None if actions is None else spark.createDataFrame([(a["action_id"], a["report_id"], a["action"], a["at_us"]) for a in actions], "action_id long, report_id long, action string, at_us long")
    rows = verify.evaluate(df, acts).collect()
    by_site = {}
    for r in sorted(rows, key=lambda r: r.id):
        if r.site_id is not None:
            by_site.setdefault(r.site_id, []).append(r.id)
    return {r.id: r for r in rows}


def crowd(n, seed):
    rng = random.Random(seed)
    walls = [(37.5 + rng.random() * 0.01, 127 + rng.random() * 0.01, rng.getrandbits(63)) for _ in range(12)]
    out = []
    for i in range(1, n + 1):
        lat, lon, fp = rng.choice(walls)
        for b in rng.sample(range(63), rng.choice([0, 2, 5, 9, 12, 17])):
            fp ^= 1 << b
        at = i * rng.choice([400_000_000])
        out.append(report(i, at, device=f"d{rng.randrange(6)}", captured_us=at + rng.choice([0, -30, -200, 20, -60 * 24 * 40]) * MINUTE, lat=lat + rng.choice([0, 1e-5, 3e-4, 9e-4, 3e-3]), lon=lon + rng.choice([0, 1e-5]),
                          accuracy_m=rng.choice([5.0, 30.0, 80.0]), blur_score=rng.choice([0.1, 0.9]), patch_found=rng.random() > 0.2, quality=rng.choice(["good", "poor"]), n_cracks=rng.choice([0, 1, 1]), width=rng.choice([None, 0.5, 80.0])))
    return out


@pytest.mark.parametrize("reviewed", [False, True])
def test_fold_equals_replay(spark, reviewed):
    reports = crowd(250, 5)
    rng = random.Random(9)
    actions = [{"action_id": k, "report_id": (j := rng.randrange(1, 230)), "action": rng.choice(list(ACTION)), "at_us": reports[j - 1]["received_us"] + 1 + rng.randrange(20_000_000_000)} for k in range(80)] if reviewed else None
    want, got = replay(reports, actions or ()), run(spark, reports, actions)
    same_site = {}
    for i, (state, score, site, dup, codes) in want.items():
        r = got[i]
        assert (r.state, r.score, r.duplicate_of, tuple(r.codes)) == (state, score, dup, codes), i
        assert (r.site_id is None) == (site is None), i
        if site is not None:
            assert same_site.setdefault(site, r.site_id) == r.site_id
    assert len(set(same_site.values())) == len(same_site)


def test_examples(spark):
    far = 70 / 111.32
    rows = [
        report(1, 0), report(2, DAY, fp=0x0123456789ABCDEF, patch_found=False, blur_score=0.9, accuracy_m=120.0, device="b", lat=38.5),
        report(3, HOUR, fp=0x1F3C1A7B52D6E084 ^ 0b11111), report(4, 40 * DAY, lat=37.5665 + far, device="c"), report(5, 41 * DAY, captured_us=41 * DAY + 120 * MINUTE, width=80.0, lat=39.0, fp=0x0F0F0F0F0F0F0F0F, device="e"),
        report(6, 42 * DAY, n_cracks=0, width=None, lat=40.0, fp=0x3333333333333333, device="f"),
    ]
    got = run(spark, rows)
    assert got[1].state == "pending" and got[1].site_id is not None
    assert got[2].state == "held" and got[2].score == 0.49999999999999994 and len(got[2].codes) == 3
    assert got[3].state == "merged" and got[3].duplicate_of == 1 and got[3].site_id == got[1].site_id
    assert got[4].state == "held" and got[4].codes == ["PHOTO_REUSED_ELSEWHERE"]
    assert set(got[5].codes) == {"IMPLAUSIBLE_WIDTH", "FUTURE_TIMESTAMP"}
    assert got[6].state == "pending" and got[6].score == 0.5


def test_nothing(spark):
    assert verify.evaluate(spark.createDataFrame([], SCHEMA)).collect() == []
