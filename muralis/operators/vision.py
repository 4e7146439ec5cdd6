"""Kernels over tables of images, a row at a time in Arrow batches; a failure becomes a warning of its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from muralis import config
from muralis.kernels import filters, geometry, profile, retake

#: Detectors by name: image in 0..1 to mask.
DETECTORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"classic": filters.detect_classic}


def gray_of(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(size, -1).astype(float)


def mask_of(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(size, -1).astype(bool)


def per_image(images: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(row)`` gives a list of output rows for each image row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([o for r in b.itertuples(index=False) for o in f(r)], columns=names)

    return images.mapInPandas(run, schema)


def detection_counts(images: DataFrame, detector: str = "classic") -> DataFrame:
    """``(item_id, has_crack, tp, fp, fn, tol_p_hit, tol_p_all, tol_r_hit, tol_r_all)`` against the true masks."""
    find = DETECTORS[detector]

    def one(r):
        return [(r.item_id, r.has_crack, *filters.metric_counts(find(gray_of(r.gray, r.size)), mask_of(r.mask, r.size)))]

    counts = ", ".join(f"{c} long" for c in ("tp", "fp", "fn", "tol_p_hit", "tol_p_all", "tol_r_hit", "tol_r_all"))
    return per_image(images, one, f"item_id long, has_crack boolean, {counts}")


def fingerprints(images: DataFrame) -> DataFrame:
    return per_image(images, lambda r: [(r.item_id, filters.phash64(gray_of(r.gray, r.size)), filters.blur_score(gray_of(r.gray, r.size)))], "item_id long, phash string, blur_score double")


def width_samples(images: DataFrame) -> DataFrame:
    """Samples along the centreline of each true mask."""

    def one(r):
        flat = filters.flatten(gray_of(r.gray, r.size))
        return [(r.item_id, *s) for s in profile.measure_widths(flat, mask_of(r.mask, r.size))]

    return per_image(images, one, "item_id long, " + ", ".join(f"{c} double" for c in profile.FIELDS))


def thinned(images: DataFrame) -> DataFrame:
    return per_image(images, lambda r: [(r.item_id, int(mask_of(r.mask, r.size).sum()), int(filters.thin(mask_of(r.mask, r.size)).sum()))], "item_id long, area long, skeleton long")


def analyze(images: DataFrame, detector: str = "classic", fallback: str = "classic") -> DataFrame:
    """The whole chain on grey images: card, mask, card erased, centreline, widths of each component with three or
    more samples, the 16 longest, hash and blur.  Without a card widths stay in pixels."""

    def one(r):
        warnings, gray = [], gray_of(r.gray, r.size)
        rgb = np.repeat(gray[:, :, None], 3, axis=2)
        card = geometry.detect_card(rgb)
        engine = detector
        try:
            mask = DETECTORS[detector](gray)
        except Exception as e:  # the detector's own failure, reported with the row
            warnings.append(f"{detector}: {e}")
            engine, mask = fallback, DETECTORS[fallback](gray)
        scale = None
        if card is None:
            warnings.append("no card")
        else:
            mask = geometry.erase_card(mask, card["h"])
            scale = geometry.local_scale(card["h"], np.array([gray.shape[1] / 2, gray.shape[0] / 2]))[0]
        samples = profile.measure_widths(filters.flatten(gray), mask)
        label, stats = filters.components(mask)
        cracks = []
        for k in range(len(stats)):
            own = [s for s in samples if label[int(s[1]), int(s[0])] == k + 1]
            if len(own) < 3:
                continue
            skeleton = np.argwhere(filters.thin(label == k + 1))[:, ::-1].astype(float)
            px = float(np.percentile([s[6] for s in own], 100 * config.REPRESENTATIVE))
            cracks.append((float(len(skeleton)), px, px / scale if scale else None, geometry.trace_polyline(skeleton, gray.shape)))
        cracks.sort(key=lambda c: -c[0])
        cracks = [{"length_px": a, "width_px": b, "width_mm": c, "polyline": p} for a, b, c, p in cracks[:16]]
        return [(r.item_id, engine, cracks, filters.phash64(gray), filters.blur_score(gray), warnings)]

    names = ["item_id", "engine", "cracks", "phash", "blur_score", "warnings"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([o for r in b.itertuples(index=False) for o in one(r)], columns=names)

    crack = "array<struct<length_px:double,width_px:double,width_mm:double,polyline:array<array<double>>>>"
    return images.mapInPandas(run, f"item_id long, engine string, cracks {crack}, phash string, blur_score double, warnings array<string>")


def retakes(images: DataFrame, variants: int = 5, seed: int = 7) -> DataFrame:
    """``(item_id, has_crack, kind, phash)``: fingerprints of the middle of each photo (``base``), of ``variants`` other
    shots of its scene (``same_scene``) and of the photo sent again (``same_photo``)."""

    def one(r):
        rng, gray = np.random.default_rng([seed, r.item_id]), gray_of(r.gray, r.size)
        shots = [("base", gray), *(("same_scene", retake.reshoot(gray, rng)) for _ in range(variants)), ("same_photo", retake.reshoot(gray, rng, geometric=False))]
        return [(r.item_id, bool(r.has_crack), kind, filters.phash64(retake.centre_crop(x))) for kind, x in shots]

    return per_image(images, one, "item_id long, has_crack boolean, kind string, phash string")


def model_masks(images: DataFrame, model_path: str, threshold: float = 0.6) -> DataFrame:
    """Masks of an ONNX model, one session for each Python worker; RGB tensors, padded to multiples of 32."""
    sessions: dict = {}

    def one(r):
        import onnxruntime

        if model_path not in sessions:
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            sessions[model_path] = onnxruntime.InferenceSession(model_path, options)
        gray = gray_of(r.gray, r.size)
        rgb = filters.pad32(np.repeat(gray[:, :, None] * 255, 3, axis=2))
        s = sessions[model_path]
        logits = s.run(None, {s.get_inputs()[0].name: filters.normalize_tensor(rgb)[None].astype(np.float32)})[0][0, 0]
        mask = 1 / (1 + np.exp(-logits[: gray.shape[0], : gray.shape[1]])) >= threshold
        return [(r.item_id, mask.astype(np.uint8).tobytes())]

    return per_image(images, one, "item_id long, mask binary")
