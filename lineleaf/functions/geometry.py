"""Row-level geometry and sizing rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH = 25.4


def mm_to_px(mm: Column, dpi: Column) -> Column:
    """Half-even rounding."""
    return F.bround(mm * dpi / F.lit(MM_PER_INCH)).cast("int")


def margin_sides(value: Column) -> Column:
    """One value for all sides, two for vertical and horizontal, four for left, right, top, bottom; else null.

    array of left, right, top, bottom.
    """
    v = F.transform(F.split(F.trim(value), r"[\s,]+"), lambda x: x.try_cast("double"))
    one, two = F.element_at(v, 1), F.try_element_at(v, F.lit(2))
    return (
        F.when(F.size(v) == 1, F.array(one, one, one, one))
        .when(F.size(v) == 2, F.array(two, two, one, one))
        .when(F.size(v) == 4, v)
    )


def fit_along(a: dict[str, Column], b: dict[str, Column], along: str, across: str, length: Column, gap_weight: float, size_weight: float, cap: float) -> Column:
    """How well two boxes side by side along one axis fit together: overlap across, times nearness and unlikeness of size."""
    low, high = f"{along}0", f"{along}1"
    shared = F.greatest(F.lit(0), F.least(a[f"{across}1"], b[f"{across}1"]) - F.greatest(a[f"{across}0"], b[f"{across}0"]))
    union = F.greatest(a[f"{across}1"], b[f"{across}1"]) - F.least(a[f"{across}0"], b[f"{across}0"])
    overlap = F.when(union > 0, shared / union).otherwise(0.0)
    gap = F.greatest(F.lit(0), F.greatest(a[low], b[low]) - F.least(a[high], b[high]))
    near = F.greatest(F.lit(0.0), 1 - F.when(length > 0, gap / length).otherwise(0.0) / F.lit(max(cap, 1e-6)))
    sizes = [F.greatest(F.lit(0), x[high] - x[low]) for x in (a, b)]
    unlike = F.when(F.greatest(*sizes) > 0, 1 - F.least(*sizes) / F.greatest(*sizes)).otherwise(0.0)
    return overlap * (F.lit(gap_weight) * near + F.lit(size_weight) * unlike)


def pair_score(
    a: dict[str, Column], b: dict[str, Column], page_w: Column, page_h: Column, gap_weight: float = 0.4, width_weight: float = 0.6, cap: float = 0.15, bonus: float = 0.0
) -> Column:
    """How well two boxes merge: the better of side by side and one above the other, and a bonus for contrast."""
    beside = fit_along(a, b, "x", "y", page_w, gap_weight, width_weight, cap)
    stacked = fit_along(a, b, "y", "x", page_h, gap_weight, width_weight, cap)
    return F.greatest(beside, stacked) + F.lit(bonus)


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Homogeneous line of two points as array a, b, c."""
    return F.array(y1 - y2, x2 - x1, x1 * y2 - x2 * y1)


def normalized(line: Column) -> Column:
    n = F.sqrt(line[0] * line[0] + line[1] * line[1])
    return F.transform(line, lambda v: F.when(n > 0, v / n).otherwise(v))


def point_line_distance(x: Column, y: Column, line: Column) -> Column:
    n = F.sqrt(line[0] * line[0] + line[1] * line[1])
    return F.when(n > 0, F.abs(line[0] * x + line[1] * y + line[2]) / n)


def line_angle(line: Column) -> Column:
    """Degrees in [-90, 90)."""
    turn = F.degrees(F.atan2(-line[0], line[1]))
    half = turn - 180 * F.floor((turn + 90) / 180)
    return F.when(half >= 90, half - 180).otherwise(half)


def margin_tilt(line: Column) -> Column:
    """Degrees from the vertical."""
    return F.when(line[0] != 0, F.degrees(F.atan(-line[1] / line[0]))).otherwise(F.lit(90.0))


def polygon_area(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def is_convex(xs: Column, ys: Column) -> Column:
    n = F.size(xs)

    def turn(i: Column) -> Column:
        j, k = (i + 1) % n, (i + 2) % n
        return (xs[j] - xs[i]) * (ys[k] - ys[j]) - (ys[j] - ys[i]) * (xs[k] - xs[j])

    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)


def mat_mul(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices as arrays of nine."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def apply_h(h: Column, x: Column, y: Column) -> Column:
    """A point under a homography as array x, y."""
    w = h[6] * x + h[7] * y + h[8]
    return F.array((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w)


def rotation_about(x: Column, y: Column, degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, x - c * x + s * y, s, c, y - s * x - c * y, zero, zero, one)


def scaling(sx: Column, sy: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(sx, zero, zero, zero, sy, zero, zero, zero, one)


def warp_extent(h: Column, w: Column, height: Column) -> Column:
    """Bounds of an image's corners under a homography: x0, y0, x1, y1."""
    corners = [apply_h(h, x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, height), (F.lit(0.0), height))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


#: Shapes (spans, points) that a batched fit is padded to.
BUCKETS = ((30, 1300), (40, 1700), (55, 2300), (75, 3100), (95, 4200), (120, 6000))


def pick_bucket(spans: Column, points: Column) -> Column:
    """Index of the smallest shape that holds both, or null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(BUCKETS))):
        s, p = BUCKETS[i]
        out = F.when((spans <= s) & (points <= p), i).otherwise(out)
    return out


def target_size(width: Column, height: Column, dpi: Column, target: float, least: int = 64) -> Column:
    """Size at the target resolution: unchanged up to 1.1 times; without a resolution 12 inches at most."""
    long_edge = F.greatest(width, height)
    scale = F.when(dpi > 0, F.when(dpi <= target * 1.1, 1.0).otherwise(F.lit(target) / dpi)).otherwise(F.least(F.lit(1.0), F.lit(12.0 * target) / long_edge))
    side = lambda n: F.when(scale < 1, F.greatest(F.lit(least), F.floor(n * scale))).otherwise(n).cast("int")
    return F.array(side(width), side(height))


def scale_box(box: Column, page_w: Column, page_h: Column, base: int = 1024, steps: int = 999) -> Column:
    """A box on a padded square of 0..999 as page pixels, clamped and in order."""
    side = F.greatest(page_w, page_h).cast("double")
    dx, dy = (side - page_w) / 2, (side - page_h) / 2

    def to(v: Column, off: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most, F.floor(v / steps * side - off))).cast("int")

    x0, y0, x1, y1 = to(box[0], dx, page_w), to(box[1], dy, page_h), to(box[2], dx, page_w), to(box[3], dy, page_h)
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def det_to_pixels(box: Column, w: Column, h: Column, scale: float = 1000.0) -> Column:
    """The first four numbers of a detected box as pixels; null for fewer."""
    at = lambda i, most: F.greatest(F.lit(0), F.least(most, (box[i] * most / scale).cast("int")))
    x0, y0, x1, y1 = at(0, w), at(1, h), at(2, w), at(3, h)
    return F.when(F.size(box) >= 4, F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)))


def backoff_minutes(attempt: Column, most_attempts: int = 10) -> Column:
    """Minutes to the next look: 1, 2, 4 to 512; null when the attempts are used up."""
    return F.when(attempt < most_attempts, F.least(F.lit(512), F.pow(F.lit(2), attempt)).cast("int"))


def card_aspect_fits(width: Column, height: Column, tolerance: float = 0.08) -> Column:
    """Whether a quad has the proportions of an identity card."""
    aspect = F.greatest(width, height) / F.least(width, height)
    return F.abs(aspect / F.lit(85.60 / 53.98) - 1) <= tolerance
