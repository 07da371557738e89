"""Curled pages: a height field over the page, its projection, its fit to points of text lines, and flattening.

A sheet has a profile along x, whose amplitude grows along y by a twist. ``params`` are a rotation vector and a
shift (3 + 3), two slopes of the cubic profile, then for every span its y, for every point its x, then the
coefficients and the twist of the other profiles. Image points are in units of half the longer side, from the middle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship_package
from . import kernels as K

#: Names of the profiles, older names, and bounds of the parameters.
CUBIC, SINES, SPLINE, BOUND = "cylindrical", "sine_twist", "bspline_twist", "flat_spline"
OLDER = {"spline_twist": SINES, "flat-spline": BOUND}
MOST_SLOPE, MOST_COEFFICIENT, MOST_TWIST = 0.5, 0.5, 4.0
FOCAL = 1.2
FIXED = 8


def kind_of(name: str | None) -> str:
    low = (name or CUBIC).lower()
    return OLDER.get(low, low)


def knots(free: int, grading: float = 1.0) -> np.ndarray:
    """Clamped cubic knots for ``free`` inner control points, crowding to 1 with the grading."""
    if free < 2:
        raise ValueError("a spline needs two free control points")
    inner = 1 - (1 - np.linspace(0, 1, free)) ** max(grading, 1.0)
    return np.concatenate([[0.0] * 3, inner, [1.0] * 3])


def spline(t: np.ndarray, control: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """A spline's values by repeated interpolation of its control points (de Boor)."""
    t = np.clip(np.asarray(t, float), at[degree], at[-degree - 1])
    cell = np.clip(np.searchsorted(at, t, "right") - 1, degree, len(control) - 1)
    d = control[cell[..., None] + np.arange(-degree, 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            low, high = at[cell + j - degree], at[cell + j - r + 1]
            share = np.where(high > low, (t - low) / np.where(high > low, high - low, 1), 0)
            d[..., j] = (1 - share) * d[..., j - 1] + share * d[..., j]
    return d[..., degree]


def far_weights(free: int, grading: float = 1.0) -> np.ndarray:
    """Weights of the inner control points that grow with the square of their distance from the binding."""
    inner = np.lib.stride_tricks.sliding_window_view(knots(free, grading)[1:-1], 3)[1:-1]
    return (1 - inner.mean(1)) ** 2


@dataclass(frozen=True)
class Sheet:
    kind: str
    coefficients: tuple[float, ...] = ()
    twist: float = 0.0
    width: float = 1.0
    height: float = 1.0
    grading: float = 1.0
    flip: bool = False
    support_x: tuple[float, float] | None = None
    support_y: tuple[float, float] | None = None
    decay: float | None = None

    @property
    def splined(self) -> bool:
        return self.kind in (SPLINE, BOUND)

    def control(self) -> np.ndarray:
        return np.concatenate([[0.0], self.coefficients, [0.0]])

    def parameter(self, x: np.ndarray) -> np.ndarray:
        t = np.asarray(x, float) / self.width
        return np.clip(1 - t if self.flip else t, 0, 1)

    def profile(self, x: np.ndarray) -> np.ndarray:
        """Height over the page; the cubic one doesn't know the width."""
        x = np.asarray(x, float)
        if self.kind == CUBIC:
            a, b = self.coefficients
            return np.polyval([a + b, -2 * a - b, a, 0], x)
        if self.splined:
            return spline(self.parameter(x), self.control(), knots(len(self.coefficients), self.grading), 3)
        k = np.arange(1, len(self.coefficients) + 1)
        return np.sin(x[..., None] * k * np.pi / self.width) @ np.asarray(self.coefficients)

    def slope(self, x: np.ndarray) -> np.ndarray:
        """The profile's derivative; a spline's is the spline of one degree less over differences of control points."""
        x = np.asarray(x, float)
        if self.kind == CUBIC:
            a, b = self.coefficients
            return np.polyval([3 * (a + b), -4 * a - 2 * b, a], x)
        if self.splined:
            at, c = knots(len(self.coefficients), self.grading), self.control()
            steps = 3 * np.diff(c) / (at[4 : 3 + len(c)] - at[1 : len(c)])
            return spline(self.parameter(x), steps, at[1:-1], 2) * (-1 if self.flip else 1) / self.width
        k = np.arange(1, len(self.coefficients) + 1) * np.pi / self.width
        return np.cos(x[..., None] * k) @ (k * np.asarray(self.coefficients))

    def extended(self, x: np.ndarray) -> np.ndarray:
        """Beyond the support the profile goes on along its tangent, with a decay bounded and flat at the page's edge."""
        if self.support_x is None:
            return self.profile(x)
        low, high = self.support_x
        inside = np.clip(x, low, high)
        out = np.asarray(x, float) - inside
        if not self.decay:
            return self.profile(inside) + self.slope(inside) * out
        reach = np.sign(out) * self.decay * -np.expm1(-np.abs(out) / self.decay)
        room = np.where(out < 0, max(low, 1e-9), max(self.width - high, 1e-9))
        fade = (1 + np.cos(np.pi * np.clip(np.abs(out) / room, 0, 1))) / 2
        return (self.profile(inside) + self.slope(inside) * reach) * fade

    def z(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Height at points of the page; the twist stays as at the edge beyond the lines that were fitted."""
        if self.kind == CUBIC:
            return self.profile(x)
        y = np.asarray(y, float) if self.support_y is None else np.clip(y, *self.support_y)
        return (1 + self.twist * (y / self.height - 0.5)) * self.extended(x)

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Heights along the last axis that every coefficient alone gives: the profile is linear in them."""
        made = [replace(self, coefficients=tuple(c)) for c in np.eye(len(self.coefficients))]
        return np.stack([m.profile(x) if self.kind == CUBIC else m.extended(x) for m in made], -1)

    def middle_slope(self, x: np.ndarray) -> np.ndarray:
        return self.slope(x if self.support_x is None else np.clip(x, *self.support_x))

    def bends(self) -> np.ndarray:
        """The linear parts whose squares are the bending energy: second differences, or modes by their square."""
        c = np.asarray(self.coefficients, float)
        if self.splined:
            return max(len(c) - 1, 1) ** 2 * np.diff(self.control(), 2)
        return c * np.arange(1, len(c) + 1) ** 2

    def bending_energy(self) -> float:
        return float((self.bends() ** 2).sum())

    def arc_length(self, n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions along the middle row and the length of the sheet up to them."""
        return K.arc_length(lambda x: np.gradient(self.extended(x) if self.kind != CUBIC else self.profile(x), x), self.width, n)


def split_params(params: np.ndarray, sheet: Sheet) -> tuple[np.ndarray, Sheet]:
    """Parameters without those of the profile, and the sheet that they make, within bounds."""
    p = np.asarray(params, float)
    if sheet.kind == CUBIC:
        return p, replace(sheet, coefficients=tuple(np.clip(p[6:8], -MOST_SLOPE, MOST_SLOPE)))
    n = len(sheet.coefficients) + 1
    c = np.clip(p[-n:-1], -MOST_COEFFICIENT, MOST_COEFFICIENT)
    return p[:-n], replace(sheet, coefficients=tuple(c), twist=float(np.clip(p[-1], -MOST_TWIST, MOST_TWIST)))


def rotation(r: np.ndarray) -> np.ndarray:
    """The matrix of a rotation vector (Rodrigues)."""
    angle = float(np.linalg.norm(r))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = np.asarray(r, float) / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def rotations(r: np.ndarray) -> np.ndarray:
    """``rotation`` of every row."""
    angle = np.linalg.norm(r, axis=1)
    x, y, z = (r / np.where(angle < 1e-12, 1.0, angle)[:, None]).T
    o = np.zeros(len(r))
    cross = np.stack([o, -z, y, z, o, -x, -y, x, o], 1).reshape(-1, 3, 3)
    angle = angle[:, None, None]
    turned = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
    return np.where(angle < 1e-12, np.eye(3), turned)


def project(points: np.ndarray, params: np.ndarray, sheet: Sheet, focal: float = FOCAL) -> np.ndarray:
    """Image points of points x, y of the page."""
    points = np.asarray(points, float).reshape(-1, 2)
    _, made = split_params(params, sheet)
    space = np.column_stack([points, made.z(points[:, 0], points[:, 1])]) @ rotation(params[:3]).T + np.asarray(params)[3:6]
    return focal * space[:, :2] / space[:, 2:]


def page_points(params: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The page's corner, then the points that the parameters say for the span number of each point."""
    span = np.asarray(span, int)
    spans = int(span.max(initial=-1)) + 1
    p = np.asarray(params, float)
    xy = np.column_stack([p[FIXED + spans : FIXED + spans + len(span)], p[FIXED + span]])
    return np.vstack([[0.0, 0.0], xy])


def project_params(params: np.ndarray, span: np.ndarray, sheet: Sheet, focal: float = FOCAL) -> np.ndarray:
    return project(page_points(params, span), params, sheet, focal)


def page_size(corner: np.ndarray, rough: tuple[float, float], params: np.ndarray, sheet: Sheet, focal: float = FOCAL, rounds: int = 50) -> np.ndarray:
    """Width and height of the page whose far corner is seen at ``corner``, by Newton steps from a rough size."""
    size = np.asarray(rough, float)
    for _ in range(rounds):
        seen = project(np.array([size, size + [1e-6, 0], size + [0, 1e-6]]), params, sheet, focal)
        step = np.linalg.lstsq((seen[1:] - seen[0]).T / 1e-6, np.asarray(corner, float).ravel() - seen[0], rcond=None)[0]
        size = size + step
        if np.abs(step).max() < 1e-10:
            break
    return size


class Pages:
    """Pages of equal numbers of points, spans and parameters: arrays by page, then as for one page."""

    def __init__(self, span: np.ndarray, sheet: Sheet, focal: float = FOCAL):
        self.span, self.sheet, self.focal = np.asarray(span, int), sheet, focal
        self.n, self.spans = self.span.shape[1], int(self.span.max(initial=-1)) + 1
        self.own = len(sheet.coefficients) + 1 if sheet.kind != CUBIC else 0
        first = FIXED + self.spans
        self.xs = np.arange(first, first + self.n)
        self.shared = np.concatenate([np.arange(first), np.arange(first + self.n, first + self.n + self.own)])
        self.curved = slice(len(self.shared) - self.own, len(self.shared) - 1) if self.own else slice(6, 8)  # coefficients among the shared

    def of(self, pages: np.ndarray) -> Pages:
        out = copy(self)
        out.span = self.span[pages]
        return out

    def coefficients(self, p: np.ndarray) -> np.ndarray:
        return p[:, self.shared[self.curved]]

    def points(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        corner = np.zeros((len(p), 1))
        return np.hstack([corner, p[:, self.xs]]), np.hstack([corner, np.take_along_axis(p, FIXED + self.span, 1)])

    def growth(self, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the profile is multiplied with, and how it moves with the twist."""
        if not self.own:
            return np.ones_like(y), np.zeros_like(y)
        y = y if self.sheet.support_y is None else np.clip(y, *self.sheet.support_y)
        by_twist = y / self.sheet.height - 0.5
        return 1 + np.clip(p[:, -1:], -MOST_TWIST, MOST_TWIST) * by_twist, by_twist

    def heights(self, p: np.ndarray, basis: np.ndarray) -> np.ndarray:
        most = MOST_COEFFICIENT if self.own else MOST_SLOPE
        return (basis @ np.clip(self.coefficients(p), -most, most)[:, :, None])[:, :, 0]

    def space(self, p: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.stack([x, y, z], -1) @ rotations(p[:, :3]).transpose(0, 2, 1) + p[:, None, 3:6]

    def project(self, p: np.ndarray) -> np.ndarray:
        """Image points of the corner and of the points of every page."""
        x, y = self.points(p)
        space = self.space(p, x, y, self.growth(p, y)[0] * self.heights(p, self.sheet.basis(x)))
        return self.focal * space[:, :, :2] / space[:, :, 2:]

    def derivatives(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of image points by the shared parameters (pages, points, 2, parameters), and by the points' own x (pages, points, 2)."""
        x, y = self.points(p)
        basis = self.sheet.basis(x)
        profile, (grown, by_twist) = self.heights(p, basis), self.growth(p, y)
        z = grown * profile
        turn, space = rotations(p[:, :3]), self.space(p, x, y, z)
        lens = np.zeros((*x.shape, 2, 3))  # image by space
        lens[:, :, 0, 0] = lens[:, :, 1, 1] = self.focal / space[:, :, 2]
        lens[:, :, :, 2] = -self.focal * space[:, :, :2] / space[:, :, 2:] ** 2
        seen_by = lens @ turn[:, None]  # image by x, y, z of the page
        out = np.zeros((*x.shape, 2, len(self.shared)))
        points = np.stack([x, y, z], -1)
        for i in range(3):
            moved = p[:, :3].copy()
            h = 1e-7 * np.maximum(1.0, np.abs(moved[:, i]))
            moved[:, i] += h
            by_turn = points @ ((rotations(moved) - turn) / h[:, None, None]).transpose(0, 2, 1)
            out[:, :, :, i] = (lens @ by_turn[:, :, :, None])[:, :, :, 0]
        out[:, :, :, 3:6] = lens
        c, most = self.coefficients(p), MOST_COEFFICIENT if self.own else MOST_SLOPE
        free = (c >= -most) & (c < most)
        out[:, :, :, self.curved] = seen_by[:, :, :, 2:] * (grown[:, :, None] * basis * free[:, None])[:, :, None]
        if self.own:
            free = (p[:, -1:] >= -MOST_TWIST) & (p[:, -1:] < MOST_TWIST)
            out[:, :, :, -1] = seen_by[:, :, :, 2] * (by_twist * profile * free)[:, :, None]
        rise_x = grown * (self.heights(p, self.sheet.basis(x + 1e-7)) - profile) / 1e-7
        rise_y = (self.growth(p, y + 1e-7)[0] - grown) * profile / 1e-7
        by_x = seen_by[:, 1:, :, 0] + seen_by[:, 1:, :, 2] * rise_x[:, 1:, None]
        by_y = seen_by[:, 1:, :, 1] + seen_by[:, 1:, :, 2] * rise_y[:, 1:, None]
        out[np.arange(len(p))[:, None], np.arange(1, self.n + 1), :, FIXED + self.span] = by_y
        return out, by_x


def fit_pages(
    targets: np.ndarray, span: np.ndarray, params: np.ndarray, sheet: Sheet, focal: float = FOCAL, twisted: bool = True,
    shear_cost: float = 0.0, bend_cost: float = 0.0, flat_cost: float = 0.0, huber: float = 0.0, rounds: int = 100,
) -> tuple[np.ndarray, np.ndarray]:
    """Parameters that bring the projected points of every page to their targets, and the costs, by damped Gauss-Newton steps.

    Targets are the page's corner, then one a point. The pages have equal numbers of points, spans and parameters and go
    on together, each with its own damping until it is done. A point's x moves that point alone, so these parameters are
    eliminated: what is solved has one row a shared parameter.
    """
    pages = Pages(span, sheet, focal)
    p, n = np.array(params, float), pages.n
    targets = np.asarray(targets, float).reshape(len(p), n + 1, 2)
    if pages.own and not twisted:
        p[:, -1] = 0.0
    # what is kept small beside the distances, linear in the shared parameters as they are, and in the clipped coefficients
    linear = np.zeros((1, len(pages.shared)))
    linear[0, 0] = np.sqrt(shear_cost)
    far = np.zeros(0)
    if pages.own:
        bends = np.stack([replace(sheet, coefficients=tuple(c)).bends() for c in np.eye(pages.own - 1)], -1)
        linear = np.vstack([linear, np.zeros((len(bends), linear.shape[1]))])
        linear[1:, pages.curved] = np.sqrt(bend_cost) * bends
        if flat_cost > 0 and sheet.kind == BOUND:
            far = np.sqrt(flat_cost * far_weights(pages.own - 1, sheet.grading))

    def parts(at: Pages, q: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = q[:, at.shared] @ linear.T
        if len(far):
            extra = np.hstack([extra, far * np.clip(at.coefficients(q), -MOST_COEFFICIENT, MOST_COEFFICIENT)])
        return at.project(q) - goal, extra

    def costs(miss: np.ndarray, extra: np.ndarray) -> np.ndarray:
        square = (miss**2).sum(2)
        robust = 2 * huber**2 * (np.sqrt(1 + square / huber**2) - 1) if huber > 0 else square
        value = robust.sum(1) + (extra**2).sum(1)
        return np.where(np.isfinite(value), value, np.inf)

    def equations(at: Pages, q: np.ndarray, miss: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, ...]:
        """Normal matrix and slope of the shared parameters, the own ones' diagonal and slope, and what couples both."""
        jac, by_x = at.derivatives(q)
        if pages.own and not twisted:
            jac[..., -1] = 0.0
        if huber > 0:
            weight = (1 / (1 + (miss**2).sum(2) / huber**2) ** 0.25)[:, :, None]
            jac, by_x, miss = jac * weight[..., None], by_x * weight[:, 1:], miss * weight
        rows = jac.reshape(len(q), 2 * (n + 1), -1)
        kept = np.broadcast_to(linear, (len(q), *linear.shape))
        if len(far):
            c, held = at.coefficients(q), np.zeros((len(q), len(far), linear.shape[1]))
            held[:, :, at.curved] = np.eye(len(far)) * far * ((c >= -MOST_COEFFICIENT) & (c < MOST_COEFFICIENT))[:, None]
            kept = np.concatenate([kept, held], 1)
        rows, b = np.concatenate([rows, kept], 1), np.hstack([miss.reshape(len(q), -1), extra])
        if pages.own and not twisted:
            rows[..., -1] = 0.0
        across = rows.transpose(0, 2, 1)
        return across @ rows, (across @ b[:, :, None])[:, :, 0], (by_x**2).sum(2), (by_x * miss[:, 1:]).sum(2), (by_x[..., None] * jac[:, 1:]).sum(2)

    def steps(normal, slope, own, own_slope, couple, damping):  # noqa: ANN001
        own = own + damping[:, None] * (own + 1e-12)
        diagonal = np.diagonal(normal, axis1=1, axis2=2) + 1e-12
        left = normal - (couple / own[:, :, None]).transpose(0, 2, 1) @ couple
        right = slope - ((own_slope / own)[:, None] @ couple)[:, 0]
        unit = 1 / np.sqrt(diagonal)
        left = left * unit[:, :, None] * unit[:, None] + damping[:, None, None] * np.eye(len(unit[0]))
        good = np.isfinite(left).all((1, 2)) & np.isfinite(right).all(1)
        left[~good] = np.eye(len(unit[0]))
        shared = unit * np.linalg.solve(left, (unit * right)[:, :, None])[:, :, 0]
        shared[~good] = np.nan
        return shared, (own_slope - (couple @ shared[:, :, None])[:, :, 0]) / own

    with np.errstate(all="ignore"):
        miss, extra = parts(pages, p, targets)
        best, damping, done_rounds = costs(miss, extra), np.full(len(p), 1e-3), np.zeros(len(p), int)
        live = np.arange(len(p) if rounds > 0 else 0)
        known = equations(pages, p, miss, extra) if len(live) else ()
        while len(live):
            shared, own = steps(*known, damping[live])
            q = p[live]
            q[:, pages.shared] -= shared
            q[:, pages.xs] -= own
            at = pages.of(live)
            tried = parts(at, q, targets[live])
            new = costs(*tried)
            better = new < best[live]
            took, same = live[better], live[~better]
            small = best[took] - new[better] <= 1e-14 + 1e-10 * best[took]
            p[took], best[took] = q[better], new[better]
            damping[took], damping[same] = np.maximum(damping[took] / 10, 1e-12), damping[same] * 10
            done_rounds[took] += 1
            stays = np.empty(len(live), bool)
            stays[better], stays[~better] = ~small & (done_rounds[took] < rounds), damping[same] < 1e12
            fresh = better & stays
            for old, value in zip(known, equations(pages.of(live[fresh]), q[fresh], tried[0][fresh], tried[1][fresh])) if fresh.any() else ():
                old[fresh] = value
            live, known = live[stays], known if stays.all() else tuple(old[stays] for old in known)
    return p, best


def fit(targets: np.ndarray, span: np.ndarray, params: np.ndarray, sheet: Sheet, *rest, **options) -> tuple[np.ndarray, float]:
    """``fit_pages`` of one page."""
    p, cost = fit_pages(np.asarray(targets, float).reshape(1, -1), np.asarray(span, int)[None], np.asarray(params, float)[None], sheet, *rest, **options)
    return p[0], float(cost[0])


def fewer_spans(ys: np.ndarray, sizes: np.ndarray, most_spans: int, most_points: int) -> list[int] | None:
    """Spans that stay when there are too many: the one of the least points times the gap it would leave goes, again and again.

    The first and the last stay; None when that isn't enough. Of equal ones the first goes.
    """
    n, points = len(ys), int(np.sum(sizes))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    worth = lambda i: float(sizes[i]) * abs(float(ys[after[i]]) - float(ys[before[i]]))
    now = {i: worth(i) for i in range(1, n - 1)}
    heap = [(v, i) for i, v in now.items()]
    heapq.heapify(heap)
    left = n
    while left > most_spans or points > most_points:
        if not heap:
            return None
        value, i = heapq.heappop(heap)
        if now.get(i) != value:
            continue
        del now[i]
        left, points = left - 1, points - int(sizes[i])
        after[before[i]], before[after[i]] = after[i], before[i]
        for j in (before[i], after[i]):
            if j in now:
                now[j] = worth(j)
                heapq.heappush(heap, (now[j], j))
    return [0, *sorted(now), n - 1] if n > 1 else list(range(n))


def sample_grid(sheet: Sheet, params: np.ndarray, size: tuple[float, float], shape: tuple[int, int], focal: float = FOCAL) -> np.ndarray:
    """Image points, rows by columns by 2, of a grid that is even along the paper itself."""
    rows, columns = shape
    _, made = split_params(params, replace(sheet, width=size[0]) if sheet.kind == CUBIC else sheet)
    x, length = replace(made, width=size[0]).arc_length() if made.kind == CUBIC else made.arc_length()
    inside = x <= size[0]
    x, length = x[inside], length[inside]
    xs = np.interp(np.linspace(0, length[-1], columns), length, x)
    grid = np.stack(np.meshgrid(xs, np.linspace(0, size[1], rows)), -1)
    return project(grid.reshape(-1, 2), params, sheet, focal).reshape(rows, columns, 2)


def flattened(pixels: np.ndarray, sheet: Sheet, params: np.ndarray, size: tuple[float, float], shape: tuple[int, int], focal: float = FOCAL) -> np.ndarray:
    """The page of ``shape`` (rows, columns) pixels, read from the picture along the sheet: also how a stored fit is replayed."""
    h, w = pixels.shape[:2]
    seen = sample_grid(sheet, params, size, shape, focal) * max(h, w) / 2 + [w / 2, h / 2]
    return K.sample(pixels, seen[..., 0], seen[..., 1])


FITTED = "key long, params array<double>, cost double"
#: Pages that are fitted together: so many, or fewer when their derivatives are more numbers than this.
TOGETHER, NUMBERS = 1024, 1 << 21


def fit_frame(frame: pd.DataFrame, sheet: Sheet, **options) -> pd.DataFrame:
    """Fits of rows key, targets, span, params; pages of equal shape are fitted together."""
    params, costs = [None] * len(frame), [None] * len(frame)
    shapes: dict[tuple[int, int, int], list[int]] = {}
    problems = [None if any(v is None for v in row) else tuple(map(np.asarray, row)) for row in zip(frame["targets"], frame["span"], frame["params"])]
    for i, problem in enumerate(problems):
        if problem is not None:
            span = problem[1].astype(int)
            shapes.setdefault((len(span), int(span.max(initial=-1)), len(problem[2])), []).append(i)
    for (n, _, size), rows in shapes.items():
        most = max(1, min(TOGETHER, NUMBERS // (2 * (n + 1) * max(size - n, 1))))
        for first in range(0, len(rows), most):
            chosen = rows[first : first + most]
            fitted, cost = fit_pages(*(np.stack([problems[i][k] for i in chosen]) for k in range(3)), sheet, **options)
            for i, p, c in zip(chosen, fitted.tolist(), cost.tolist()):
                params[i], costs[i] = p, c
    return pd.DataFrame({"key": frame["key"], "params": params, "cost": costs})


def fit_sheets(problems: DataFrame, sheet: Sheet, **options) -> DataFrame:
    """Fits of rows key, targets (x and y in turn), span, params in one narrow stage; null rows have no fit."""
    ship_package(problems.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fit_frame(frame, sheet, **options)

    return problems.select("key", "targets", "span", "params").mapInPandas(run, FITTED)
