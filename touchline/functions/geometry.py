"""Box, pitch and height expressions. Every function takes and returns columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numbering of a side, the pitch template in metres.
ROLES = {
    1: "loosehead prop", 2: "hooker", 3: "tighthead prop", 4: "lock", 5: "lock", 6: "blindside flanker", 7: "openside flanker", 8: "number 8",
    9: "halfback", 10: "first-five-eighth", 11: "left wing", 12: "inside centre", 13: "outside centre", 14: "right wing", 15: "fullback",
}
MAX_JERSEY = 23
PITCH_LENGTH, PITCH_WIDTH = 120.0, 70.0
UPRIGHT_LINES = {"L try": 10.0, "L 22m": 32.0, "L 10m": 50.0, "halfway": 60.0, "R 10m": 70.0, "R 22m": 88.0, "R try": 110.0}
CROSS_LINES = {"low flag": 0.0, "5m low": 5.0, "15m low": 15.0, "15m up": 55.0, "5m up": 65.0, "up flag": 70.0}
OTHER_POINTS = {"halfway / centre (kickoff)": (60.0, 35.0), "L post base (lower)": (10.0, 32.2), "L post base (upper)": (10.0, 37.8), "R post base (lower)": (110.0, 32.2), "R post base (upper)": (110.0, 37.8)}


class Box:
    """The four columns of a box, by prefix: x1, y1, x2, y2 or e.g. a_x1."""

    def __init__(self, prefix: str = ""):
        self.x1, self.y1, self.x2, self.y2 = (F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        zero = F.lit(0.0)
        return F.greatest(self.width, zero) * F.greatest(self.height, zero)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2


def contains(box: Box, x, y) -> Column:
    return (box.x1 <= x) & (box.x2 >= x) & (box.y1 <= y) & (box.y2 >= y)


def clamp(box: Box, width: float, height: float) -> list[Column]:
    """Corners moved into the frame."""
    keep = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), F.lit(most - 1.0))
    return [keep(box.x1, width), keep(box.y1, height), keep(box.x2, width), keep(box.y2, height)]


def clamp_sorted(box: Box, width: float, height: float, least: float = 4.0) -> list[Column]:
    """Corners put in order, moved into the frame, and at least ``least`` pixels apart."""
    out = []
    for a, b, most in ((box.x1, box.x2, width), (box.y1, box.y2, height)):
        low = F.least(F.greatest(F.least(a, b), F.lit(0.0)), F.lit(most - 1.0 - least))
        high = F.least(F.greatest(F.greatest(a, b), low + least), F.lit(most - 1.0))
        out.append((low, high))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, zero) * F.greatest(h, zero)


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def dist2(a: Box, b: Box) -> Column:
    dx, dy = a.cx - b.cx, a.cy - b.cy
    return dx * dx + dy * dy


def project(h, x: Column, y: Column, least: float = 1e-12) -> tuple[Column, Column]:
    """A homography's image of (x, y): null where the denominator vanishes. h: nine numbers or columns, by rows."""
    h = [c if isinstance(c, Column) else F.lit(float(c)) for c in h]
    w = h[6] * x + h[7] * y + h[8]
    good = F.abs(w) >= least
    return F.when(good, (h[0] * x + h[1] * y + h[2]) / w), F.when(good, (h[3] * x + h[4] * y + h[5]) / w)


def inverse(h) -> list[Column]:
    """The inverse of a 3 x 3 matrix in closed form."""
    a, b, c, d, e, f, g, k, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in h)
    det = a * (e * m - f * k) - b * (d * m - f * g) + c * (d * k - e * g)
    cofactors = [e * m - f * k, c * k - b * m, b * f - c * e, f * g - d * m, a * m - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]
    return [F.when(F.abs(det) > 1e-15, x / det) for x in cofactors]


def to_size(box: Box) -> tuple[Column, Column, Column, Column]:
    """Corner, width and height of a box."""
    return box.x1, box.y1, box.width, box.height


def to_corners(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    return x, y, x + width, y + height


def plausible_refinement(new: Box, old: Box) -> Column:
    """Whether a refined box may stand for the old one: 0.1 to 4 times its area, with a tenth of itself inside it."""
    area = new.width * new.height
    ratio = area / F.greatest(F.lit(1.0), old.width * old.height)
    inside = F.greatest(F.lit(0.0), F.least(new.x2, old.x2) - F.greatest(new.x1, old.x1)) * F.greatest(F.lit(0.0), F.least(new.y2, old.y2) - F.greatest(new.y1, old.y1))
    return (new.width > 1) & (new.height > 1) & ratio.between(0.10, 4.0) & (inside / F.greatest(F.lit(1.0), area) >= 0.10)


def foot(box: Box, h) -> tuple[Column, Column]:
    """Where a player stands, in metres: the middle of the box's lower edge on the pitch."""
    return project(h, box.cx, F.greatest(box.y1, box.y2))


def zone(box: Box, width: float, height: float) -> tuple[Column, Column]:
    return box.cx / width, box.cy / height


def expected_height(slope, intercept, cy: Column) -> Column:
    return slope * cy + intercept


def height_plausible(height: Column, expected: Column, spread: Column, tolerance: float = 3.0) -> Column:
    return F.abs(height - expected) <= F.greatest(tolerance * spread, 0.35 * F.greatest(expected, F.lit(1.0)))


def is_wide_deep(zx: Column, zy: Column) -> Column:
    return F.coalesce(((zx < 0.26) | (zx > 0.74)) & (zy < 0.42), F.lit(False))


def zone_supports(number: Column, zx: Column, zy: Column) -> Column:
    """Whether a play zone fits a shirt number; null where there is no expectation."""
    wide, deep = (zx < 0.30) | (zx > 0.70), zy < 0.45
    return F.when(zx.isNull() | number.isNull(), F.lit(None)).when(number.isin(11, 14, 15), wide | deep).when(number.between(1, 8), zx.between(0.25, 0.75))


def role(number: Column) -> tuple[Column, Column]:
    """Role and group (forward or back) of a shirt number; a literal map of fifteen entries, so no join."""
    named = F.element_at(F.create_map(*[x for n, r in ROLES.items() for x in (F.lit(n), F.lit(r))]), number.cast("int"))
    group = F.when(number.between(1, 8), "forward").when(number.between(9, 15), "back")
    return named, group


def valid_number(text: Column) -> Column:
    """A read's digits as a shirt number 1 to 23, else null."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    value = F.when(digits.rlike("^[0-9]{1,2}$"), digits.try_cast("int"))
    return F.when(value.between(1, MAX_JERSEY), value)


def strict_number(text: Column) -> Column:
    """As valid_number, but a vote with anything else than digits doesn't count."""
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(value.between(1, MAX_JERSEY), value)


def landmarks(spark):
    """The named points of the pitch: every upright line crossed with every cross line, kick-off and post bases."""
    points = {f"{u} / {c}": (x, y) for u, x in UPRIGHT_LINES.items() for c, y in CROSS_LINES.items()} | OTHER_POINTS
    return spark.createDataFrame([(n, *p) for n, p in points.items()], "name string, x double, y double")
