"""Rectangle algebra over four Columns x0, y0, x1, y1: pure expressions, so joins keep whole-stage code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", sep: str = "") -> "Rect":
        """The rectangle in columns like a_x0, a_y0, a_x1, a_y1."""
        return cls(*[F.col(f"{prefix}{sep}{c}") for c in ("x0", "y0", "x1", "y1")])

    @classmethod
    def of_array(cls, c: Column) -> "Rect":
        return cls(*[F.get(c, F.lit(i)) for i in range(4)])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in (("x0", self.x0), ("y0", self.y0), ("x1", self.x1), ("y1", self.y1))]


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Of the smaller span, which counts as 1 at least."""
    return overlap_length(a0, a1, b0, b1) / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def x_overlap(a: Rect, b: Rect) -> Column:
    return overlap_ratio(a.x0, a.x1, b.x0, b.x1)


def y_overlap(a: Rect, b: Rect) -> Column:
    return overlap_ratio(a.y0, a.y1, b.y0, b.y1)


def x_gap(a: Rect, b: Rect) -> Column:
    return axis_gap(a.x0, a.x1, b.x0, b.x1)


def y_gap(a: Rect, b: Rect) -> Column:
    return axis_gap(a.y0, a.y1, b.y0, b.y1)


def intersection_area(a: Rect, b: Rect) -> Column:
    return overlap_length(a.x0, a.x1, b.x0, b.x1) * overlap_length(a.y0, a.y1, b.y0, b.y1)


def coverage(inner: Rect, outer: Rect) -> Column:
    """How much of inner lies in outer."""
    return intersection_area(inner, outer) / F.greatest(F.lit(1.0), inner.area)


def iou(a: Rect, b: Rect) -> Column:
    i = intersection_area(a, b)
    return i / F.greatest(F.lit(1.0), a.area + b.area - i)


def smaller_coverage(a: Rect, b: Rect) -> Column:
    return intersection_area(a, b) / F.greatest(F.lit(1.0), F.least(a.area, b.area))


def area_similarity(a: Rect, b: Rect) -> Column:
    return F.least(a.area, b.area) / F.greatest(F.lit(1.0), F.greatest(a.area, b.area))


def edge_delta(a: Rect, b: Rect) -> Column:
    return F.greatest(F.abs(a.x0 - b.x0), F.abs(a.y0 - b.y0), F.abs(a.x1 - b.x1), F.abs(a.y1 - b.y1))


def union(a: Rect, b: Rect) -> Rect:
    return Rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def clip(a: Rect, to: Rect) -> Rect:
    return Rect(F.greatest(a.x0, to.x0), F.greatest(a.y0, to.y0), F.least(a.x1, to.x1), F.least(a.y1, to.y1))


def almost_equal(a: Rect, b: Rect, tolerance: float = 0.75) -> Column:
    return edge_delta(a, b) <= tolerance


def contains(outer: Rect, inner: Rect) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def gap_rect(a: Rect, b: Rect) -> Rect:
    """The rectangle between two that are apart, down first, then across; all zero if they are not apart."""
    down, up = a.y1 <= b.y0, b.y1 <= a.y0
    right, left = a.x1 <= b.x0, b.x1 <= a.x0
    pick = lambda d, u, r, l: F.when(down, d).when(up, u).when(right, r).when(left, l).otherwise(0.0)  # noqa: E731,E741
    x0, x1 = F.greatest(a.x0, b.x0), F.least(a.x1, b.x1)
    y0, y1 = F.greatest(a.y0, b.y0), F.least(a.y1, b.y1)
    return Rect(pick(x0, x0, a.x1, b.x1), pick(a.y1, b.y1, y0, y0), pick(x1, x1, b.x0, a.x0), pick(b.y0, a.y0, y1, y1))


def same_side(caption: Rect, group: Rect, candidate: Rect) -> Column:
    """Whether a candidate stays on the side of the caption where the group lies: above, below, left or right of it."""
    return (
        F.when(caption.y0 >= group.y1 - 8, candidate.y1 <= caption.y0 + 2)
        .when(caption.y1 <= group.y0 + 8, candidate.y0 >= caption.y1 - 2)
        .when(caption.x0 >= group.x1 - 8, candidate.x1 <= caption.x0 + 2)
        .when(caption.x1 <= group.x0 + 8, candidate.x0 >= caption.x1 - 2)
        .otherwise(True)
    )


def background_penalty(a: Rect, page: Rect) -> Column:
    """The larger the share of the page, the less it is a figure."""
    share = a.area / F.greatest(F.lit(1.0), page.area)
    return F.when(share >= 0.90, 10.0).when((share >= 0.76) & (edge_delta(a, page) <= 8), 7.0).when(share >= 0.72, 3.0).otherwise(0.0)


def in_page(a: Rect, width: Column, height: Column) -> Column:
    """Finite, not empty, and inside 0..width, 0..height."""
    finite = ~F.isnan(a.x0) & ~F.isnan(a.y0) & ~F.isnan(a.x1) & ~F.isnan(a.y1)
    return F.coalesce(finite & (a.x0 >= 0) & (a.x0 < a.x1) & (a.x1 <= width) & (a.y0 >= 0) & (a.y0 < a.y1) & (a.y1 <= height), F.lit(False))


def to_pixels(a: Rect, page_crop: Rect, dpi: Column | int) -> Rect:
    """Page points to pixels of a crop."""
    z = (dpi if isinstance(dpi, Column) else F.lit(dpi)) / F.lit(72.0)
    return Rect((a.x0 - page_crop.x0) * z, (a.y0 - page_crop.y0) * z, (a.x1 - page_crop.x0) * z, (a.y1 - page_crop.y0) * z)
