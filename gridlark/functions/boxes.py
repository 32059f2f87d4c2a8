"""Box geometry and the quality score, as column expressions that stay inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Columns of a box in centre form, in shares of the image."""

    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in ("xc", "yc", "w", "h")])


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def corners(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x - b.w / 2, b.y - b.h / 2, b.x + b.w / 2, b.y + b.h / 2


def centred(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """Corner form to centre form, clamped to the image."""
    x1, y1, x2, y2 = clamp(x1), clamp(y1), clamp(x2), clamp(y2)
    return Box((x1 + x2) / 2, (y1 + y2) / 2, F.greatest(x2 - x1, F.lit(0.0)), F.greatest(y2 - y1, F.lit(0.0)))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    wide = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    high = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    common = wide * high
    union = F.greatest(F.lit(0.0), ax2 - ax1) * F.greatest(F.lit(0.0), ay2 - ay1) + F.greatest(F.lit(0.0), bx2 - bx1) * F.greatest(F.lit(0.0), by2 - by1) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def pixels(b: Box, width: Column, height: Column, inside: bool = True) -> list[Column]:
    """Corner pixels, truncated; clamped to the image if ``inside``."""
    at = [(c * s).cast("int") for c, s in zip(corners(b), (width, height, width, height), strict=True)]
    return [F.greatest(F.lit(0), F.least(c, (s - 1).cast("int"))) for c, s in zip(at, (width, height, width, height), strict=True)] if inside else at


def undo_view(kind: Column, b: Box, crop: float = 0.85) -> Box:
    """A box found in a view of an image, in the image itself: flips, central crop, quarter turn, or none."""
    edge = (1 - crop) / 2
    pick = lambda same, h, v, c, r: F.when(kind == "hflip", h).when(kind == "vflip", v).when(kind == "crop", c).when(kind == "rot90", r).otherwise(same)
    return Box(
        pick(b.x, 1 - b.x, b.x, clamp(edge + b.x * crop), 1 - b.y),
        pick(b.y, b.y, 1 - b.y, clamp(edge + b.y * crop), b.x),
        pick(b.w, b.w, b.w, clamp(b.w * crop), b.h),
        pick(b.h, b.h, b.h, clamp(b.h * crop), b.w),
    )


@dataclass(frozen=True)
class QualityRules:
    """Fixed values of the score: weights, limits of area, aspect and edge."""

    min_area: float = 0.0005
    max_area: float = 0.70
    max_aspect: float = 6.0
    edge_margin: float = 0.002
    weights: tuple[float, float, float, float] = (0.42, 0.25, 0.15, 0.18)
    area_share: float = 0.70
    unknown_folder: float = 0.75


def geometry_score(b: Box, rules: QualityRules = QualityRules()) -> Column:
    """Soft score of the area, mixed with the aspect ratio's."""
    area, a = b.w * b.h, aspect(b)
    by_area = F.when(area < rules.min_area, F.greatest(F.lit(0.0), area / rules.min_area))
    by_area = by_area.when(area > rules.max_area, F.greatest(F.lit(0.0), 1 - (area - rules.max_area) / rules.max_area)).otherwise(1.0)
    by_aspect = F.coalesce(F.greatest(F.lit(0.0), 1 - (a - 1) / (rules.max_aspect - 1)), F.lit(0.0))
    return rules.area_share * by_area + (1 - rules.area_share) * by_aspect


def aspect(b: Box) -> Column:
    """The longer side over the shorter; null for boxes without extent."""
    return F.when((b.w > 0) & (b.h > 0), F.greatest(b.w / b.h, b.h / b.w))


def touches_edge(b: Box, margin: float) -> Column:
    x1, y1, x2, y2 = corners(b)
    return (x1 < margin) | (y1 < margin) | (x2 > 1 - margin) | (y2 > 1 - margin)


def folder_score(found: Column, expected: Column, unknown: float = 0.75) -> Column:
    return F.when(expected.isNull(), unknown).when(expected == found, 1.0).otherwise(0.0)


def quality(found: Column, confidence: Column, threshold: Column, b: Box, expected: Column, rules: QualityRules = QualityRules()) -> tuple[Column, Column]:
    """The composite score and the ordered reasons against a predicted box."""
    threshold = F.coalesce(threshold, F.lit(0.5))
    area = b.w * b.h
    terms = [F.least(F.lit(1.0), confidence / F.greatest(threshold, F.lit(1e-6))), geometry_score(b, rules), F.when(touches_edge(b, rules.edge_margin), 0.0).otherwise(1.0), folder_score(found, expected, rules.unknown_folder)]
    score = sum((w * t for w, t in zip(rules.weights[1:], terms[1:], strict=True)), rules.weights[0] * terms[0])
    against = [
        (confidence < threshold, "below_dynamic_threshold"),
        (area < rules.min_area, "small_box"),
        (area > rules.max_area, "large_box"),
        ((b.w <= 0) | (b.h <= 0), "non_positive_box"),
        (aspect(b) > rules.max_aspect, "bad_aspect_ratio"),
        (touches_edge(b, rules.edge_margin), "edge_contact"),
        (expected.isNotNull() & (expected != found), "folder_class_mismatch"),
    ]
    return score, F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in against]))


def dynamic_threshold(ap: Column, base: float = 0.55, target: float = 0.90, pull: float = 0.30, least: float = 0.40, most: float = 0.85) -> Column:
    """A class's confidence threshold: stricter the further its average precision stays under the target."""
    raised = base + F.greatest(F.lit(0.0), target - F.coalesce(ap, F.lit(target))) * pull
    return F.greatest(F.lit(least), F.least(F.lit(most), raised))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-even rounding, as formatted text rounds."""
    return F.bround(value, digits)
