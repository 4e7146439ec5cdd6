"""Image kernels on generated walls; rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis.functions import hashing
from muralis.operators import metrics, pairs, vision
from muralis.plans.registry import query
from muralis.sources import synthetic


def walls(spark, n=16, size=96):
    return synthetic.walls(spark, n, size=size).repartition(8, "item_id")


@query("src_synth_wall")
def src_synth_wall(spark, d):
    return walls(spark).select("item_id", "size", "width_px", "has_crack", F.length("gray").alias("bytes"))


@query("src_sim_events")
def src_sim_events(spark, d):
    return synthetic.events(spark, 225)


@query("simulate_and_score")
def simulate_and_score(spark, d):
    """The labelled stream through verification, scored."""
    from muralis.operators.simulation import rates
    from muralis.operators.verify import evaluate

    e = synthetic.events(spark, 225)
    full = e.withColumns({"patch_found": F.lit(True), "quality": F.lit("good"), "blur_score": F.lit(0.2), "n_cracks": (F.col("kind") != "prank_junk").cast("int"), "width": F.when(F.col("kind") != "prank_junk", 0.5)})
    return rates(e.select("id", "kind", "wall").join(evaluate(full), "id"))


@query("detect_classic")
def detect_classic(spark, d):
    return vision.detection_counts(walls(spark))


@query("eval_detection")
def eval_detection(spark, d):
    return metrics.ratios(metrics.confusion(vision.detection_counts(walls(spark)), ["has_crack"]))


@query("phash64")
def phash64(spark, d):
    return vision.fingerprints(walls(spark))


@query("thin_zhang_suen")
def thin_zhang_suen(spark, d):
    return vision.thinned(walls(spark))


@query("measure_widths")
def measure_widths(spark, d):
    return vision.width_samples(walls(spark, 8))


@query("analyze_photo")
def analyze_photo(spark, d):
    return vision.analyze(walls(spark, 8)).select("item_id", "engine", F.size("cracks").alias("n_cracks"), "phash", "blur_score", "warnings")


@query("hash_study")
def hash_study(spark, d):
    """Share of pairs within each number of bits, by kind of wall: shots of one scene, one photo sent twice, and
    different walls."""
    shots = vision.retakes(synthetic.walls(spark, 64, size=96).repartition(8, "item_id")).select("item_id", F.col("has_crack").alias("g"), "kind", hashing.fingerprint(F.col("phash")).alias("fp"))
    base = shots.filter("kind = 'base'").select("item_id", "g", "fp")
    again = shots.filter("kind <> 'base'").join(base.select("item_id", F.col("fp").alias("own")), "item_id").select("g", "kind", hashing.hamming(F.col("fp"), F.col("own")).alias("distance"))
    other = pairs.same_group_pairs(base, "g", "item_id", "fp").select("g", F.lit("different").alias("kind"), "distance")
    return metrics.threshold_curve(again.unionByName(other), ["g", "kind"])
