"""Curled sheets against closed forms, shared margins against brute force, settings by precedence."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from lineleaf.operators import margins as A
from lineleaf.operators import sheet as S
from lineleaf.plans import settings


@pytest.mark.parametrize("grading", [1.0, 2.5])
def test_spline_profiles_are_pinned_and_have_their_slope(grading):
    c = tuple(np.random.default_rng(3).normal(size=5) * 0.1)
    sheet = S.Sheet(S.BOUND, c, width=2.0, height=3.0, grading=grading)
    x = np.linspace(0, 2, 101)
    z = sheet.profile(x)
    assert abs(z[0]) < 1e-12 and abs(z[-1]) < 1e-12
    rise = (sheet.profile(x[1:-1] + 1e-6) - sheet.profile(x[1:-1] - 1e-6)) / 2e-6
    assert np.allclose(rise, sheet.slope(x[1:-1]), atol=1e-8)
    turned = S.Sheet(S.BOUND, c, width=2.0, grading=grading, flip=True)
    assert np.allclose(turned.profile(x), z[::-1]) and np.allclose(turned.slope(x[1:-1]), -sheet.slope(x[1:-1])[::-1], atol=1e-9)


def test_two_free_points_are_a_bernstein_cubic():
    t = np.linspace(0, 1, 21)
    z = S.Sheet(S.SPLINE, (0.3, -0.2)).profile(t)
    assert np.allclose(z, 0.9 * t * (1 - t) ** 2 - 0.6 * t**2 * (1 - t))
    assert np.allclose(S.far_weights(2), [4 / 9, 1 / 9])
    with pytest.raises(ValueError):
        S.knots(1)


def test_support_goes_on_along_the_tangent_and_ends_flat():
    plain = S.Sheet(S.SINES, (0.2, 0.1), width=1.0, support_x=(0.2, 0.7))
    assert np.isclose(plain.extended(np.array([0.9]))[0], plain.profile(np.array([0.7]))[0] + 0.2 * plain.slope(np.array([0.7]))[0])
    fading = S.Sheet(S.SINES, (0.2, 0.1), width=1.0, support_x=(0.2, 0.7), decay=0.05)
    assert np.allclose(fading.extended(np.array([0.0, 1.0])), 0, atol=1e-12)
    assert np.isclose(fading.extended(np.array([0.7 + 1e-9]))[0], plain.profile(np.array([0.7]))[0])
    held = S.Sheet(S.SINES, (0.2,), twist=1.0, support_y=(0.25, 0.75))
    assert held.z(np.array([0.5]), np.array([0.9])) == held.z(np.array([0.5]), np.array([0.75]))


def test_bending_energy_and_arc_length():
    assert np.isclose(S.Sheet(S.SINES, (0.1, 0.2)).bending_energy(), 0.1**2 + 0.8**2)
    assert np.isclose(S.Sheet(S.SPLINE, (0.1, 0.3)).bending_energy(), 0.1**2 + 0.5**2)
    assert np.isclose(S.Sheet(S.SINES, (0.0,), width=2.0).arc_length()[1][-1], 2.0)
    x = np.linspace(0, 1, 200_001)
    whole = np.hypot(np.diff(x), np.diff(0.2 * np.sin(np.pi * x))).sum()
    assert np.isclose(S.Sheet(S.SINES, (0.2,)).arc_length()[1][-1], whole, rtol=1e-5)


def test_parameters_are_split_within_bounds_and_names_are_old_or_new():
    rest, sheet = S.split_params(np.array([0.0] * 8 + [0.9, -0.1, 7.0]), S.Sheet(S.SINES, (0.0, 0.0)))
    assert len(rest) == 8 and sheet.coefficients == (0.5, -0.1) and sheet.twist == 4.0
    assert [S.kind_of(n) for n in (None, "spline_twist", "Flat-Spline")] == [S.CUBIC, S.SINES, S.BOUND]


def test_projection_without_rotation_is_a_division():
    params = np.array([0, 0, 0, 0.1, -0.2, 2.0, 0, 0.0])
    assert np.allclose(S.project([[0.5, 0.4]], params, S.Sheet(S.CUBIC, (0, 0))), [[1.2 * 0.6 / 2, 1.2 * 0.2 / 2]])
    turn = S.rotation(np.array([0, 0, np.pi / 2]))
    assert np.allclose(turn @ [1, 0, 0], [0, 1, 0]) and np.allclose(turn @ turn.T, np.eye(3))


@pytest.mark.parametrize(("kind", "extra"), [(S.CUBIC, 0), (S.SINES, 3), (S.SPLINE, 4), (S.BOUND, 4)])
def test_fit_finds_points_and_page_size(kind, extra):
    r = np.random.default_rng(5)
    span = np.repeat(np.arange(5), 6)
    tail = [*(r.normal(size=extra) * 0.05), 0.3] if extra else []
    true = np.concatenate([[0.05, -0.03, 0.02, -0.5, -0.4, 1.4], [0, 0] if extra else [0.2, -0.1], np.linspace(0.1, 0.9, 5), np.tile(np.linspace(0.05, 0.95, 6), 5), tail])
    sheet = S.Sheet(kind, (0.0,) * (extra or 2))
    seen = S.project_params(true, span, sheet)
    for options in ({}, {"huber": 0.1}):
        found, cost = S.fit(seen, span, true + r.normal(size=len(true)) * 0.01, sheet, **options)
        assert cost < 1e-8 and np.allclose(S.project_params(found, span, sheet), seen, atol=1e-4)
    assert np.allclose(S.page_size(S.project([[0.9, 0.8]], true, sheet), (1.0, 1.0), true, sheet), [0.9, 0.8])
    if extra:
        flat, _ = S.fit(seen, span, true, sheet, twisted=False, bend_cost=0.1, shear_cost=0.1, flat_cost=0.1)
        assert flat[-1] == 0


def test_flat_page_is_read_as_it_is():
    pixels = np.arange(100, dtype=np.uint8).reshape(10, 10)
    params = np.array([0, 0, 0, -1, -1, 1.2, 0, 0.0])  # the page fills the picture
    seen = S.sample_grid(S.Sheet(S.CUBIC, (0, 0)), params, (2.0, 2.0), (3, 5))
    assert np.allclose(seen[:, 0, 0], -1) and np.allclose(seen[0, :, 0], np.linspace(-1, 1, 5)) and np.allclose(seen[2, :, 1], 1)
    out = S.flattened(pixels, S.Sheet(S.CUBIC, (0, 0)), params, (1.8, 1.8), (10, 10))
    assert np.array_equal(out, pixels)


def test_null_problems_have_no_fit(spark):
    rows = spark.createDataFrame([(1, None, None, None)], "key long, targets array<double>, span array<int>, params array<double>")
    assert [tuple(r) for r in S.fit_sheets(rows, S.Sheet(S.CUBIC, (0, 0))).collect()] == [(1, None, None)]
    assert S.fit_sheets(rows.where("key > 1"), S.Sheet(S.CUBIC, (0, 0))).count() == 0


def a_page(kind, seed, spans=5, points=6):
    r = np.random.default_rng(seed)
    sheet, span = S.Sheet(kind, (0.0,) * (2 if kind == S.CUBIC else 4)), np.repeat(np.arange(spans), points)
    tail = [] if kind == S.CUBIC else [*(r.normal(size=4) * 0.05), 0.3]
    true = np.concatenate([[0.05, -0.03, 0.02, -0.5, -0.4, 1.4], [0.2, -0.1] if kind == S.CUBIC else [0, 0], np.linspace(0.1, 0.9, spans), np.tile(np.linspace(0.05, 0.95, points), spans), tail])
    return sheet, span, S.project_params(true, span, sheet), true + r.normal(size=len(true)) * 0.01


@pytest.mark.parametrize("kind", [S.CUBIC, S.SINES, S.SPLINE, S.BOUND])
def test_pages_project_like_one_page_and_have_their_derivatives(kind):
    sheet, span, _, one = a_page(kind, 3)
    sheet = replace(sheet, support_x=(0.2, 0.8), support_y=(0.2, 0.7), decay=0.1)
    params = np.stack([one, a_page(kind, 4)[3]])
    params[1, :3] = 0  # not turned
    if kind != S.CUBIC:
        params[0, -2], params[1, -1] = 0.9, 5.0  # beyond the bounds
    pages = S.Pages(np.stack([span, span[::-1]]), sheet)
    want = [S.project_params(p, v, sheet) for p, v in zip(params, pages.span)]
    assert np.allclose(pages.project(params), want, atol=1e-14)
    shared, own = pages.derivatives(params)
    for place, i in enumerate(pages.shared):
        h = np.eye(params.shape[1])[i] * 1e-6
        assert np.allclose((pages.project(params + h) - pages.project(params - h)) / 2e-6, shared[..., place], atol=1e-5)
    h = np.isin(np.arange(params.shape[1]), pages.xs) * 1e-6
    assert np.allclose(((pages.project(params + h) - pages.project(params - h)) / 2e-6)[:, 1:], own, atol=1e-5)


def test_fits_of_many_pages_equal_the_fit_of_each(monkeypatch):
    pages = {key: a_page(S.SPLINE, key, *((5, 6) if key % 3 else (4, 7))) for key in range(20)}
    sheet = pages[0][0]
    pages[7][2][1, 1] = np.nan
    rows = [(k, t.ravel(), v, p) for k, (_, v, t, p) in pages.items()]
    frame = pd.DataFrame([*rows, (20, None, None, None)], columns=["key", "targets", "span", "params"])
    calls, fit_pages = [], S.fit_pages
    monkeypatch.setattr(S, "fit_pages", lambda t, *rest, **options: calls.append(len(t)) or fit_pages(t, *rest, **options))
    for options in ({}, {"bend_cost": 1e-3, "shear_cost": 1e-2, "huber": 0.05}, {"twisted": False, "flat_cost": 0.1}):
        calls.clear()
        out = S.fit_frame(frame, sheet, **options)
        assert sorted(calls) == [7, 13] and out["key"].tolist() == list(range(21))
        for key, (_, span, seen, params) in pages.items():
            if key != 7:
                p, cost = S.fit(seen, span, params, sheet, **options)
                assert np.isclose(out["cost"][key], cost, rtol=1e-6, atol=1e-12)
                assert np.allclose(S.project_params(out["params"][key], span, sheet), S.project_params(p, span, sheet), atol=1e-5)
        assert out["cost"][7] == np.inf and np.array_equal(out["params"][7][:-1], pages[7][3][:-1])
        assert out["params"][20] is None and pd.isna(out["cost"][20])


def test_sheet_fits_spreads_a_small_file(spark, tmp_path):
    from lineleaf import catalogue

    keys = [-3, None, *range(3000)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.QUERIES["sheet_fits"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((k, True) for k in keys), key=str)


def slow_runs(values, tolerance):
    left, out, number = list(range(len(values))), [0] * len(values), 0
    if len(values) <= 2:
        return out
    while left:
        counts = [sum(abs(values[i] - values[j]) <= tolerance for j in left) for i in left]
        best = values[left[counts.index(max(counts))]]
        middle = float(np.median([values[i] for i in left if abs(values[i] - best) <= tolerance]))
        near = [i for i in left if abs(values[i] - middle) <= tolerance] or [i for i in left if abs(values[i] - best) <= tolerance]
        for i in near:
            out[i] = number
        left, number = [i for i in left if i not in near], number + 1
    return out


def test_margin_runs_equal_the_slow_way():
    r = np.random.default_rng(11)
    for _ in range(200):
        values = r.integers(0, 60, r.integers(0, 15)).tolist()
        assert A.margin_runs(np.array(values), 5.0).tolist() == slow_runs(values, 5.0)


def test_justified_lines(spark):
    rows = [(1, 10, 90), (1, 11, 91), (1, 12, 89), (1, 40, 90), (1, None, 90), (2, 10, 90), (2, 10, 90)]
    df = spark.createDataFrame(rows, "page long, l long, r long")
    got = A.justified(df, ["page"], "l", "r", 3, 3).where("justified").select("page", "l").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (1, 11), (1, 12)]
    assert A.justified(df.where("page > 5"), ["page"], "l", "r", 3).count() == 0


def test_settings_by_precedence():
    env = {"LINELEAF_OCR_DPI": "150", "LINELEAF_CONFIDENCE_GATE": "3", "LINELEAF_COMPLEMENT": "Other"}
    assert settings.ocr_dpi({"ocr_dpi": 300}, env=env) == 150 and settings.ocr_dpi({"ocr_dpi": 300}, env={"LINELEAF_OCR_DPI": "x"}) == 300
    assert settings.ocr_dpi({}, env={}) == 200
    assert settings.confidence_gate({}, env=env) == 1.0 and settings.confidence_gate({"confidence_gate": -1}, env={}) == 0.7
    assert settings.complement_engine(None, ["other"], env=env) == "other" and settings.complement_engine("none", ["surya"], env={}) == "none"
    assert settings.complement_engine("unknown", ["a", "surya"], env={}) == "surya" and settings.complement_engine(None, [], env={}) == "none"
    assert settings.page_workers(16, 6.0) == 3 and settings.page_workers(1, None) == 1
    assert settings.model_slots(24_000, 0.85) == 8 and settings.model_slots(8_000, 0.85) == 3 and settings.model_slots(None, 0.85) == 1


def slow_fewer(ys, sizes, most_spans, most_points):
    kept = list(range(len(ys)))
    while len(kept) > most_spans or sum(sizes[i] for i in kept) > most_points:
        inner = kept[1:-1]
        if not inner:
            return None
        kept.remove(min(inner, key=lambda i: (sizes[i] * abs(ys[kept[kept.index(i) + 1]] - ys[kept[kept.index(i) - 1]]), i)))
    return kept


def test_fewer_spans_equal_the_slow_way():
    r = np.random.default_rng(9)
    for _ in range(200):
        n = int(r.integers(2, 14))
        ys, sizes = np.sort(r.integers(0, 30, n)).tolist(), r.integers(1, 6, n).tolist()
        limits = int(r.integers(1, 14)), int(r.integers(1, 50))
        assert S.fewer_spans(ys, sizes, *limits) == slow_fewer(ys, sizes, *limits)


def test_pitch_has_its_pole():
    index = np.arange(8.0)
    ys = (2 + 3 * index) / (1 + 0.05 * index)  # crowds at 60
    assert np.allclose(A.pitch_vanishing_point(ys, x=5.0), [5, 60, 1])
    assert A.pitch_vanishing_point(ys[:3]) is None and A.pitch_vanishing_point(4 * index) is None


def test_scaled_pages_and_slim_catalogue(spark, tmp_path):
    from lineleaf.operators import kernels as K
    from lineleaf.sources import readers

    rows = [(1, "", bytes(range(12)), 3, 4, 1, 72.0, "{}"), (2, "", bytes(12), 2, 2, 3, 72.0, "{}")]
    got = K.scaled_pages(spark.createDataFrame(rows, K.PAGES), spark.createDataFrame([(1, 2.0)], "page long, scale double")).orderBy("page").collect()
    assert [(r.width, len(r.pixels)) for r in got] == [(8, 24), (2, 12)]
    nodes = spark.createDataFrame([(1, None, 1, 7), (2, 1, 1, 8), (3, 2, 1, 9)], "id long, parent_id long, root_id long, image_id long")
    images = spark.createDataFrame([(7,), (8,), (9,)], "image_id long")
    counts = readers.write_slim(nodes, nodes.where("id <> 2"), images, {}, str(tmp_path))
    assert counts == {"nodes": (3, 2), "images": (3, 2)}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/nodes.parquet").select("id", "parent_id").orderBy("id").collect()] == [(1, None), (3, 1)]


def test_left_runs_of_blocks(spark):
    rows = [(1, 3, 50.0), (1, 1, 10.0), (1, 2, 11.0), (1, 4, 12.0), (1, 5, None), (2, 1, 7.0)]
    df = spark.createDataFrame(rows, "block long, line long, x double")
    got = A.left_runs(df, ["block"], "line", "x", 3.0)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 0), (2, 1, 0)]
    assert A.left_runs(df.where("block > 5"), ["block"], "line", "x", 3.0).count() == 0
