"""The same wall photographed again: another stand, light and focus.  Grey images; no JPEG artefacts."""

from __future__ import annotations

import numpy as np

from muralis.kernels import filters

#: Ranges of a second shot (fixed values): turn in degrees, zoom, shift as a share of the side, exposure, stray light,
#: blur, and how often it's blurred; then the share of the side that a fingerprint looks at.
TURN, ZOOM, SHIFT, EXPOSURE, FLARE, BLUR, BLURRED = 6.0, (0.9, 1.1), 0.06, (0.7, 1.15), 0.03, (0.5, 1.5), 0.5
CENTRE = 0.85


def moved(img: np.ndarray, degrees: float, zoom: float, shift: tuple[float, float]) -> np.ndarray:
    """The image turned and zoomed about its middle, then shifted by ``(x, y)`` pixels; bilinear, mirrored borders."""
    h, w = img.shape
    yy, xx = np.mgrid[:h, :w]
    back = np.exp(-1j * np.radians(degrees)) / zoom  # a turn and a zoom is one complex factor
    at = ((xx - w / 2 - shift[0]) + 1j * (yy - h / 2 - shift[1])) * back
    x, y = at.real + w / 2, at.imag + h / 2

    def cell(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.floor(v).astype(int)
        fold = lambda k: np.minimum(k % (2 * n), 2 * n - 1 - k % (2 * n))
        return fold(low), fold(low + 1), v - low

    (x0, x1, fx), (y0, y1, fy) = cell(x, w), cell(y, h)
    top, bottom = img[y0, x0] * (1 - fx) + img[y0, x1] * fx, img[y1, x0] * (1 - fx) + img[y1, x1] * fx
    return top * (1 - fy) + bottom * fy


def reshoot(img: np.ndarray, rng: np.random.Generator, geometric: bool = True) -> np.ndarray:
    """Another shot of the scene, or with ``geometric`` off the same photo sent again in other light."""
    out = img
    if geometric:
        h, w = img.shape
        out = moved(out, rng.uniform(-TURN, TURN), rng.uniform(*ZOOM), (rng.uniform(-SHIFT, SHIFT) * w, rng.uniform(-SHIFT, SHIFT) * h))
    out = out * rng.uniform(*EXPOSURE) + rng.uniform(0, FLARE)
    if rng.random() < BLURRED:
        out = filters.blur(out, float(rng.uniform(*BLUR)))
    return np.clip(out, 0, 1)


def centre_crop(img: np.ndarray, share: float = CENTRE) -> np.ndarray:
    """The middle of an image, ``share`` of each side."""
    cut = [int(n * (1 - share) / 2) for n in img.shape]
    return img[cut[0] : img.shape[0] - cut[0], cut[1] : img.shape[1] - cut[1]]
