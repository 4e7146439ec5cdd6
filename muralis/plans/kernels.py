"""Each image kernel as a query over generated walls or cards: shape, mean and spread of what it makes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from muralis.kernels import filters, geometry, profile, retake
from muralis.operators import vision
from muralis.plans.registry import query
from muralis.scratch import fresh_dir
from muralis.sources import images, synthetic

_OUT = "item_id long, n long, mean double, spread double"


def _rgb(g):
    return np.repeat(g[:, :, None], 3, axis=2)


def _lut(g):
    """Colour correction of 8-bit values by a table of 256 entries."""
    table = np.clip((np.arange(256) / 255 - 0.02) / 0.9, 0, 1)
    return table[np.round(g * 255).astype(int)]


_UP = np.array([[0.0, 1.0]])


def _middle(g):
    return np.array([[g.shape[1] / 2, g.shape[0] / 2]])


def _section(g):
    return profile.sections(g, _middle(g), _UP, 12)


def _points(m):
    pts = np.argwhere(m)[:, ::-1].astype(float)
    return pts if len(pts) else np.zeros((1, 2))


#: Kernel by name, of a grey image and its mask.
KERNELS = {
    "downscale_area": lambda g, m: filters.downscale_area(g, 40), "to_gray": lambda g, m: filters.to_gray((_rgb(g) * 255).astype(np.uint8)), "gaussian_blur": lambda g, m: filters.blur(g, 2.0),
    "sobel2": lambda g, m: np.stack(filters.sobel2(g)), "flatten": lambda g, m: filters.flatten(g), "ridge_response": lambda g, m: filters.ridge_response(filters.flatten(g)),
    "hysteresis": lambda g, m: filters.hysteresis(filters.ridge_response(filters.flatten(g))), "connected_components": lambda g, m: filters.components(m)[0], "shape_filter": lambda g, m: filters.shape_filter(m),
    "adaptive_dark": lambda g, m: filters.adaptive_dark(g, 15), "open3": lambda g, m: filters.open3(m), "mask_dt": lambda g, m: 2 * filters.distance_transform(m), "metric_counts": lambda g, m: np.array(filters.metric_counts(m, m)),
    "normalize_tensor": lambda g, m: filters.normalize_tensor(_rgb(g) * 255), "resize_bilinear": lambda g, m: filters.resize_bilinear(g, 50, 70), "pad32": lambda g, m: filters.pad32(g[:50, :70]),
    "blur_score": lambda g, m: np.array([filters.blur_score(g)]), "apply_correction_image": lambda g, m: _lut(g), "convex_hull": lambda g, m: geometry.convex_hull(_points(m)), "min_area_rect": lambda g, m: np.array(geometry.min_area_rect(_points(m))),
    "trace_polyline": lambda g, m: np.array(geometry.trace_polyline(_points(filters.thin(m)), m.shape)), "erase_card": lambda g, m: geometry.erase_card(m, np.array([[0.5, 0, 5], [0, -0.5, 60], [0, 0, 1.0]])),
    "reshoot": lambda g, m: retake.reshoot(g, np.random.default_rng(3)), "centre_crop": lambda g, m: retake.centre_crop(g),
    "profile_sample": lambda g, m: _section(g)[1], "fwhm_area": lambda g, m: np.array(profile.valleys(*_section(g), np.array([6.0]))), "smooth1d": lambda g, m: profile.smooth(g, 2.0),
    "chord": lambda g, m: profile.chords(m, _middle(m), _UP), "direction_pca": lambda g, m: np.abs(profile.directions(filters.thin(m), _middle(m).astype(int))[0]),
}


def _register(name: str) -> None:
    def run(spark, d):
        def one(r):
            out = np.asarray(KERNELS[name](vision.gray_of(r.gray, r.size), vision.mask_of(r.mask, r.size)), float)
            return [(r.item_id, out.size, float(out.mean()) if out.size else None, float(out.std()) if out.size else None)]

        return vision.per_image(synthetic.walls(spark, 8, size=96), one, _OUT)

    run.__module__ = __name__
    query(name)(run)


for _name in KERNELS:
    _register(_name)


@query("detect_card")
def detect_card(spark, d):
    """Rendered cards found again: pixels per millimetre, found and true."""

    def one(r):
        rng = np.random.default_rng(r.id)
        turn, s = rng.uniform(-0.15, 0.15), rng.uniform(4, 5)
        h = np.array([[s * np.cos(turn), s * np.sin(turn), 60], [s * np.sin(turn), -s * np.cos(turn), 340], [0, 0, 1]])
        card = geometry.detect_card(geometry.render_card((420, 600), h))
        at = np.array([300.0, 200.0])
        return [(r.id, card is not None, geometry.local_scale(card["h"], at)[0] if card else None, geometry.local_scale(h, at)[0])]

    return vision.per_image(spark.range(4), one, "item_id long, found boolean, px_per_mm double, true_px_per_mm double")


def png(img: np.ndarray) -> bytes:
    """An 8-bit grey or RGB image as a PNG file."""
    h, w = img.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _files(spark, named: dict[str, bytes]) -> str:
    """Files in the shared folder, written by the driver."""
    from pyarrow import fs

    where = fresh_dir(spark, "files")
    system, root = fs.FileSystem.from_uri(where)
    system.create_dir(root, recursive=True)
    for name, data in named.items():
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    return where


@query("src_image_file")
def src_image_file(spark, d):
    shots = {f"w{i}.png": png((_rgb(synthetic.wall(7, i, 32)[0]) * 255).astype(np.uint8)) for i in range(4)}
    return images.rgb_images(spark, _files(spark, shots)).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "h", "w", F.length("rgb").alias("bytes"))


@query("src_mask_file")
def src_mask_file(spark, d):
    shots = {f"w{i}.png": png(synthetic.wall(7, i, 32)[1].astype(np.uint8) * 255) for i in range(4)}
    return images.masks(spark, _files(spark, shots)).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "h", "w", F.length("mask").alias("bytes"))


@query("src_raw_golden")
def src_raw_golden(spark, d):
    return images.raw_arrays(spark, _files(spark, {"a.f32": np.arange(12, dtype="<f4").tobytes()})).select(F.size("values").alias("n"), F.element_at("values", -1).alias("last"))


@query("src_text_table")
def src_text_table(spark, d):
    """Published colour difference pairs, three of them, as a text table: computed against stated values."""
    from muralis.functions import color

    lines = b"50.0 2.6772 -79.7751 50.0 0.0 -82.7485 2.0425\n50.0 3.1571 -77.2803 50.0 0.0 -82.7485 2.8615\n50.0 -1.0 2.0 50.0 0.0 0.0 2.3669\n"
    t = images.number_table(spark, _files(spark, {"pairs.txt": lines}), ["xl", "xa", "xb", "yl", "ya", "yb", "stated"])
    out = color.with_delta_e(t, tuple(F.col(c) for c in ("xl", "xa", "xb")), tuple(F.col(c) for c in ("yl", "ya", "yb")), "computed")
    return out.select("stated", "computed", (F.abs(F.col("stated") - F.col("computed")) < 1e-4).alias("close"))


@query("src_synth_sets")
def src_synth_sets(spark, d):
    """The development and test sets, 50 walls with a crack and 15 without: seeds 1000 and 2000."""
    dev, test = (synthetic.walls(spark, 65, seed, 64, cracked=50).repartition(8, "item_id").select(F.lit(name).alias("part"), "item_id", "width_px", "has_crack") for name, seed in (("dev", 1000), ("test", 2000)))
    return dev.unionByName(test)


@query("src_seed_demo")
def src_seed_demo(spark, d):
    demo = synthetic.events(spark, 40)
    return synthetic.seed_if_empty(demo.limit(0), demo)
