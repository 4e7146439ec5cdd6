"""Parameters of the engine.  Values are part of the contract (fixed values)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from types import MappingProxyType
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Check(NamedTuple):
    """A rule of verification: its code, what it adds to a report's score, the numbers that it compares with, and, if
    it looks at the report alone, the condition under which it fires, made of those numbers."""

    code: str
    delta: float
    limits: tuple[float, ...] = ()
    fires: Callable[..., Column] | None = None


def _lateness(unit_us: float) -> Column:
    return (F.col("received_us") - F.col("captured_us")) / F.lit(unit_us)


#: In the order in which rules apply (fixed values).
CHECKS = (
    Check("PHOTO_REUSED_ELSEWHERE", -0.6, (8, 200.0)),  # bits, metres at least
    Check("SCENE_ELSEWHERE", -0.6, (12, 500.0)),  # bits, metres at most
    Check("CALIBRATION_MISSING", -0.15, (), lambda: ~F.col("patch_found")),
    Check("CALIBRATION_POOR", -0.10, (), lambda: F.col("patch_found") & (F.col("quality") == "poor")),
    Check("GPS_IMPRECISE", -0.15, (50.0,), lambda metres: F.col("accuracy_m") > metres),
    Check("IMAGE_BLURRY", -0.20, (0.6,), lambda blur: F.col("blur_score") > blur),
    Check("NO_DETECTION", -0.50, (), lambda: F.col("n_cracks") == 0),
    Check("IMPLAUSIBLE_WIDTH", -0.30, (50.0,), lambda mm: F.coalesce(F.col("width") > mm, F.lit(False))),
    Check("FUTURE_TIMESTAMP", -0.30, (10.0,), lambda minutes: -_lateness(6e7) > minutes),
    Check("STALE_PHOTO", -0.20, (30.0,), lambda days: _lateness(8.64e10) > days),
    Check("FLOODING", -0.60, (6,)),  # earlier reports within the hour
    Check("DEVICE_HISTORY", -0.30, (3, 0.5)),  # reviewed reports, share rejected
    Check("CORROBORATED", 0.10),
)


class Link(NamedTuple):
    """When two reports belong together: fingerprint bits that may differ, hours and metres between them."""

    bits: int
    hours: float
    metres: float


#: Reports of one scene, of one device's repeated photo, and of one photo by any device (fixed values).  A scene's
#: radius is the position's accuracy, within ``LEAST_M`` and ``metres``.
LINKS = {"scene": Link(18, float("inf"), 50.0), "device": Link(18, 24.0, 50.0), "photo": Link(8, 2.0, 50.0)}
LEAST_M, HOLD_BELOW = 15.0, 0.5


class Rules(NamedTuple):
    """What verification goes by; pass another instance to change it."""

    checks: tuple[Check, ...] = CHECKS
    links: Mapping[str, Link] = MappingProxyType(LINKS)
    least_m: float = LEAST_M
    hold_below: float = HOLD_BELOW

    def limits(self, code: str) -> tuple[float, ...]:
        return next(c.limits for c in self.checks if c.code == code)

    def own(self) -> dict[str, Column]:
        """Conditions of the rules that look at the report alone, by code, in order."""
        return {c.code: c.fires(*c.limits) for c in self.checks if c.fires}


RULES = Rules()
DELTAS = {c.code: c.delta for c in CHECKS}

EARTH_M, DEGREE_M = 6371000.0, 111320.0
VISIBLE = ("pending", "accepted", "closed")
TRANSITIONS = {"accept": "accepted", "reject": "rejected", "close": "closed", "hold": "held", "reopen": "pending"}
EXPERT_MM = 0.3
HOLD, EXPERT, OBSERVE = "판정 보류", "전문가 점검 권장", "관찰 필요"

#: Width summary.
REPRESENTATIVE, FLOOR_PX, MEASURABLE_PX, MAX_SCALE_UNCERTAINTY, HYBRID_SWITCH_PX = 0.9, 0.5, 1.5, 0.15, 4.0

#: Classic detector.
CLASSIC = {"flatten_sigma": 20.0, "scales": (2.0, 3.0, 4.0, 6.0), "beta": 0.5, "c": 0.5, "high": 0.3, "low": 0.2, "min_length": 32, "min_elongation": 8.0}

#: Reference card in millimetres, origin lower left.
CARD = {"w": 90.0, "h": 56.0, "fiducial": 7.0, "margin": 3.0, "swatch": 12.0, "gap": 2.0, "x0": 25.0, "y0": 20.0, "rows": 2, "cols": 3}
SWATCHES = {"white": (243, 243, 242), "gray50": (122, 122, 121), "black": (52, 52, 52), "red": (175, 54, 60), "blue": (56, 61, 150), "gray18": (85, 85, 85)}
NEUTRALS = ("white", "gray50", "black", "gray18")
QUALITY_GOOD, QUALITY_FAIR = 3.0, 6.0
#: Image sources of the crack data set by file name prefix, first match wins: (prefix, source, allowed).
NEGATIVE_SOURCES, WALL_SOURCES = ("noncrack",), ("noncrack", "rissbilder", "volker", "masonry")
