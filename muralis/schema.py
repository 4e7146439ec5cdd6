"""The report payload: schema, decoding and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "schema_version int, client_uuid string, captured_at string, "
    "location struct<lat:double, lon:double, accuracy_m:double, geohash:string>, "
    "calibration struct<patch_found:boolean, delta_e_after:double, quality:string>, "
    "detection struct<engine:string, cracks:array<struct<width_mm:double, width_ci_mm:array<double>, length_mm:double, orientation_deg:double, polyline:array<array<double>>, confidence:double>>>, "
    "image_meta struct<w:int, h:int, blur_score:double, exif_stripped:boolean>, phash string, note string, consent_image_upload boolean"
)


def violations(p: Column) -> Column:
    """Names of the constraints that a decoded payload breaks; empty if it's valid."""
    loc, cracks = p["location"], p["detection"]["cracks"]
    between = lambda x, a, b: x.isNotNull() & (x >= a) & (x <= b)
    crack_ok = lambda c: (
        between(c["width_mm"], 0, 500) & (F.size(c["width_ci_mm"]) == 2) & (c["length_mm"] >= 0) & (c["orientation_deg"] >= 0) & (c["orientation_deg"] < 180)
        & (F.size(c["polyline"]) <= 32) & F.forall(c["polyline"], lambda q: (F.size(q) == 2) & F.forall(q, lambda v: between(v, 0, 1))) & between(c["confidence"], 0, 1))
    checks = {
        "payload": p.isNotNull(), "schema_version": p["schema_version"] == 1, "client_uuid": p["client_uuid"].isNotNull(), "captured_at": F.try_to_timestamp(p["captured_at"]).isNotNull(),
        "lat": between(loc["lat"], -90, 90), "lon": between(loc["lon"], -180, 180), "accuracy_m": loc["accuracy_m"] >= 0, "geohash": between(F.length(loc["geohash"]), 4, 12),
        "quality": p["calibration"]["quality"].isin("good", "fair", "poor"), "patch_found": p["calibration"]["patch_found"].isNotNull(), "engine": p["detection"]["engine"].isNotNull(),
        "cracks": cracks.isNotNull() & (F.size(cracks) <= 16) & F.forall(cracks, crack_ok), "blur_score": between(p["image_meta"]["blur_score"], 0, 1),
        "phash": p["phash"].rlike("^[0-9a-f]{16,64}$"), "note": F.length(F.coalesce(p["note"], F.lit(""))) <= 500,
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())


def decode(raw: DataFrame, column: str = "payload") -> DataFrame:
    """``raw`` with the decoded ``report``, its ``violations`` and ``valid``; unknown fields are ignored."""
    out = raw.withColumn("report", F.from_json(F.col(column), PAYLOAD, {"mode": "PERMISSIVE"}))
    return out.withColumn("violations", violations(F.col("report"))).withColumn("valid", F.size("violations") == 0)
