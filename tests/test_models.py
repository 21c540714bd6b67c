"""Models and order statistics against plain versions, on cases that the tables don't hold."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import inference as inf
from chronopanel.operators import isotonic as iso
from chronopanel.operators import newton as nt
from chronopanel.operators import order_statistics as od
from chronopanel.operators import selection as se

# ---- order statistics


def test_quantiles_ranks_and_tiles_are_those_of_a_sort(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, float("nan"), -0.0, 0.0, 1.5, 1.5, round(rng.gauss(0, 1), 3)]), rng.choice([None, 2.0, 2.0, rng.random()])) for k in ("a", "b", None) for i in range(rng.choice([1, 300, 500]))]
    rows += [("none", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(7)
    of = {}
    for k, _, x, y in rows:
        of.setdefault(k, ([], []))
        if x is not None and not math.isnan(x):
            of[k][0].append(x)
        if y is not None:
            of[k][1].append(y)
    for r in od.quantiles(df, ["x", "y"], {"low": 0.01, "mid": 0.5, "most": 1.0}, ["k"]).collect():
        for c, values in zip("xy", of[r.k], strict=True):
            for name, p in (("low", 0.01), ("mid", 0.5), ("most", 1.0)):
                expected = np.quantile(values, p) if values else None
                assert r[f"{c}_{name}"] == (pytest.approx(expected, abs=1e-12) if values else None)
    assert od.quantiles(df.where("false"), ["x"], {"mid": 0.5}).collect()[0].x_mid is None
    for r in od.with_average_rank(df, "x", "rank", ["k"]).collect():
        if r.x is None or math.isnan(r.x):
            assert r["rank"] is None
        else:
            values = of[r.k][0]
            assert r["rank"] == sum(v < r.x for v in values) + (sum(v == r.x for v in values) + 1) / 2
    tiles = {(r.k, r.i): r.tile for r in od.with_tile(df, ["y", "i"], 3, "tile", ["k"]).collect()}
    for k in of:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[3] is not None, r[3] or 0, r[1]))
        assert [tiles[k, r[1]] for r in mine] == [t + 1 for t, part in enumerate(np.array_split(np.arange(len(mine)), 3)) for _ in part]


def test_state_contrast_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(i, float(i % 2), rng.gauss(0, 1)) for i in range(300)]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        r = inf.state_contrast(spark.createDataFrame(rows, "idx int, score double, x double").repartition(seed + 1), "score", "x", 3).first()
        found.add((round(r.contrast, 12), round(r.t, 9)))
    assert len(found) == 1
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert found.pop()[0] == pytest.approx(np.mean([r[2] for r in ordered[200:]]) - np.mean([r[2] for r in ordered[:100]]), abs=1e-9)


# ---- nested selection of ridges


def _ridge(x, y, w, penalty):
    w = w / 1.0
    mx, my = (x * w[:, None]).sum(0) / w.sum(), (y * w).sum() / w.sum()
    xc, yc = x - mx, y - my
    b = np.linalg.solve(xc.T @ (xc * w[:, None]) + penalty * np.eye(x.shape[1]), xc.T @ (yc * w))
    return my - mx @ b, b


def _ranks(v):
    order = np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    return order


def test_ten_columns_select_and_predict_as_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    k, n_dates, n_names = 10, 70, 12
    names = [f"f{i}" for i in range(k)]
    days = [datetime.date(2001, 1, 5) + datetime.timedelta(days=7 * d) for d in range(n_dates + 2)]
    truth = rng.normal(size=k) * (np.arange(k) < 3)
    x = rng.normal(size=(n_dates, n_names, k))
    y = x @ truth + rng.normal(size=(n_dates, n_names)) * 3
    rows = [(days[d], f"n{s}", days[d + 2], *map(float, x[d, s]), float(y[d, s])) for d in range(n_dates) for s in range(n_names) if rng.random() > 0.05]
    rows.append((days[3], "gap", days[5], *([1.0] * (k - 1)), None, 0.5))
    df = spark.createDataFrame(rows, "date date, sid string, label_end date, " + ", ".join(f"{c} double" for c in names) + ", y double").repartition(5)
    recipes = [se.Recipe("all_weak", 0.5, 3), se.Recipe("all_strong", 200.0, 2), se.Recipe("three", 0.5, 1, tuple(names[:3]))]
    least, block, least_blocks, error_block, most = 20, 5, 2, 3, 30
    years = spark.createDataFrame([(2001, days[45]), (2002, days[60])], "year int, cutoff date")
    refits = [(days[d], days[d + 1]) for d in range(18, n_dates - 1, 6)]
    chosen, out = se.nested_selection(df, names, "y", recipes, years, spark.createDataFrame(refits, "refit date, predict_from date"), least, block, least_blocks, error_block, most)

    panel = {}
    for r in rows:
        if None not in r:
            panel.setdefault(r[0], []).append((r[1], np.array(r[3:-1]), r[-1]))
    dates = sorted(panel)

    def fit(span, recipe):
        kept = [names.index(c) for c in (recipe.columns or names)]
        xs = np.array([f[kept] for d in span for _, f, _ in panel[d]])
        ys = np.array([t for d in span for _, _, t in panel[d]])
        w = np.array([1 / len(panel[d]) for d in span for _ in panel[d]])
        a, b = _ridge(xs, ys, w, recipe.penalty)
        full = np.zeros(k)
        full[kept] = b
        return a, full

    ic = {}
    for f in range((len(dates) - least) // block):
        for r in recipes:
            a, b = fit(dates[: least + f * block], r)
            for d in dates[least + f * block : least + (f + 1) * block]:
                p = np.array([a + v @ b for _, v, _ in panel[d]])
                ic.setdefault((r.name, f), []).append(np.corrcoef(_ranks(p), _ranks(np.array([t for _, _, t in panel[d]])))[0, 1])
    for row in chosen.collect():
        cutoff = days[45] if row.year == 2001 else days[60]
        blocks = (sum(days[days.index(d) + 2] <= cutoff for d in dates) - least) // block
        series = {r.name: np.concatenate([ic[r.name, f] for f in range(blocks)]) for r in recipes}
        best = max(recipes, key=lambda r: (series[r.name].mean(), -r.capacity)).name
        close = []
        for r in recipes:
            gap = series[best] - series[r.name]
            means = np.array([gap[i : i + error_block].mean() for i in range(len(gap) - error_block + 1)])
            if gap.mean() <= means.std() * math.sqrt(error_block / len(gap)) + 1e-12:
                close.append(r)
        expected = min(close, key=lambda r: r.capacity)
        assert (row.recipe, row.n_blocks, row.one_se_members) == (expected.name, blocks, "|".join(sorted(r.name for r in close)))
        assert row.mean_ic == pytest.approx(series[expected.name].mean(), abs=1e-9)
    of_year = {r.year: r.recipe for r in chosen.collect()}
    assert set(of_year) == {2001, 2002}
    mine = {(r.date, r.sid): r for r in out.collect()}
    seen = 0
    for d in sorted(panel):
        past = [r for r in refits if r[1] <= d]
        if not past or d.year not in of_year:
            continue
        legal = [x for x in dates if days[days.index(x) + 2] <= past[-1][0]]
        if len(legal) < least:
            assert not any(key[0] == d for key in mine)
            continue
        a, b = fit(legal[-most:], next(r for r in recipes if r.name == of_year[d.year]))
        for s, v, _ in panel[d]:
            assert mine[d, s].prediction == pytest.approx(a + v @ b, abs=1e-8) and mine[d, s].refit == past[-1][0]
            seen += 1
    assert seen == len(mine) > 300


# ---- logistic fits of many keys


def test_all_keys_end_where_their_gradient_is_nothing(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in range(6):
        b = rng.normal(size=4)
        for _ in range(150):
            v = rng.normal(size=3) * [1, 5, 0.1]
            rows.append((key, *map(float, v), int(rng.random() < 1 / (1 + math.exp(-(b[0] + v @ b[1:]))))))
    rows += [(77, 1.0, 2.0, 3.0, 1)] * 5 + [(88, float(i), 0.0, 0.0, int(i > 5)) for i in range(10)] + [(0, None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, y int").repartition(4)
    fits = {r.key: r for r in nt.logistic_fits(df, ["key"], ["a", "b", "c"], "y", 0.7).collect()}
    assert fits[77].status == "one_class" and fits[77].beta is None and fits[77].n == 5
    for key, r in fits.items():
        if key == 77:
            continue
        assert r.status == "converged"
        x = np.array([[1, *row[1:4]] for row in rows if row[0] == key and row[1] is not None])
        y = np.array([row[4] for row in rows if row[0] == key and row[1] is not None])
        beta = np.array(r.beta)
        gradient = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - 0.7 * np.array([0, *beta[1:]])
        assert np.abs(gradient).max() < 1e-6 and r.n == len(y)
    plain = {r.key: r for r in nt.logistic_fits(df.where("key = 88 OR key = 1"), ["key"], ["a"], "y", rounds=15).collect()}
    assert plain[88].status != "converged" and plain[1].status == "converged"


def _basis(x, knots):
    """Quadratic B-splines by the plain recursion, straight beyond the outer knots."""
    t0, t1, t2 = knots
    t = [t0 - 2 * (t1 - t0), t0 - (t1 - t0), t0, t1, t2, t2 + (t2 - t1), t2 + 2 * (t2 - t1)]

    def b(i, d, v):
        if d == 0:
            return float(v == t2 if i == 3 and v >= t2 else t[i] <= v < t[i + 1] and v != t2)
        return (v - t[i]) / (t[i + d] - t[i]) * b(i, d - 1, v) + (t[i + d + 1] - v) / (t[i + d + 1] - t[i + 1]) * b(i + 1, d - 1, v)

    inside = min(max(x, t0), t2)
    step = 1e-6 * (1 if inside < t2 else -1)
    return [b(i, 2, inside) + (x - inside) * (b(i, 2, inside + step) - b(i, 2, inside)) / step for i in (1, 2, 3)]


def test_spline_fits_use_knots_of_the_past_alone(spark):
    rng = np.random.default_rng(6)
    rows = [(f, float(rng.normal() * (1 + f)), float(rng.normal()), None if f == 3 and i % 5 == 0 else int(rng.random() < 0.4)) for f in range(4) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y int").repartition(3)
    out, fits = nt.walk_forward_logistic(df, ["a", "b"], "y", 1.0, splines=True)
    assert {r.status for r in fits.collect()} == {"converged"}
    for fold in (1, 3):
        past = [r for r in rows if r[0] < fold and r[3] is not None]
        x = np.array([r[1:3] for r in past])
        low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
        cut = np.clip(x, low, high)
        mean, dev = cut.mean(0), cut.std(0, ddof=1)
        z = (cut - mean) / dev
        knots = [np.quantile(z[:, c], [0, 0.5, 1]) for c in range(2)]
        design = np.array([[1, *_basis(r[0], knots[0]), *_basis(r[1], knots[1])] for r in z])
        y, beta = np.array([r[3] for r in past]), np.zeros(7)
        shrink = np.diag([0.0] + [1.0] * 6)
        for _ in range(40):
            p = 1 / (1 + np.exp(-design @ beta))
            beta = beta + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + shrink, design.T @ (y - p) - shrink @ beta)
        now = [r for r in rows if r[0] == fold]
        zn = (np.clip(np.array([r[1:3] for r in now]), low, high) - mean) / dev
        expected = sorted(np.array([[1, *_basis(r[0], knots[0]), *_basis(r[1], knots[1])] for r in zn]) @ beta)
        mine = sorted(r.raw for r in out.where(F.col("fold") == fold).collect())
        assert mine == pytest.approx(expected, abs=1e-4)
    assert out.where("fold = 0").isEmpty()


# ---- isotonic regression


def _brute(points):
    """Isotonic values of (x, weight, total) in order, by the largest of least means."""
    w, s = np.cumsum([0, *(p[1] for p in points)]), np.cumsum([0, *(p[2] for p in points)])
    n = len(points)
    return [max(min((s[k + 1] - s[j]) / (w[k + 1] - w[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising"])
def test_isotonic_blocks_are_those_of_all_rows_at_once(spark, shape):
    rng = random.Random(7)
    make = {"noise": lambda i: rng.gauss(i / 40, 1), "falling": lambda i: -float(i), "rising": lambda i: float(i)}[shape]
    rows = [(k, float(i // 2), make(i), rng.choice([1.0, 2.0])) for k in ("a", "b") for i in range(90)] + [("a", None, 1.0, 1.0), ("a", 3.0, None, 1.0), ("one", 5.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double").repartition(4)
    blocks = iso.isotonic_blocks(df, "x", "y", ["k"], "w", group=8)
    got = blocks.collect()
    for k in ("a", "b", "one"):
        points = {}
        for key, x, y, w in rows:
            if key == k and x is not None and y is not None:
                at = points.setdefault(x, [x, 0, 0])
                at[1] += w
                at[2] += w * y
        points = [points[x] for x in sorted(points)]
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.low)
        for p, value in zip(points, _brute(points), strict=True):
            assert next(r for r in mine if r.low <= p[0] <= r.high).value == pytest.approx(value, abs=1e-9)
        assert all(a.high < b.low and a.value < b.value for a, b in zip(mine, mine[1:], strict=False))
    at = spark.createDataFrame([("a", v) for v in (-5.0, 0.0, 7.5, 44.0, 900.0, None)], "k string, x double")
    steps = sorted((r for r in got if r.k == "a"), key=lambda r: r.low)
    xs = [v for r in steps for v in (r.low, r.high)]
    for r in iso.isotonic_values(at, blocks, "x", ["k"]).collect():
        assert r.fitted == (None if r.x is None else pytest.approx(np.interp(r.x, xs, [v.value for v in steps for _ in range(2)]), abs=1e-9))


# ---- states


def test_states_over_blocks_are_those_of_a_walk(spark):
    from chronopanel.operators import portfolio as po

    rng = random.Random(9)
    flag = lambda p: None if rng.random() < 0.05 else rng.random() < p
    rows = [(k, w, flag(0.1), flag(0.2), flag(0.2)) for k in "ab" for w in range(1, 120)]
    got = {(r.k, r.week): r.state for r in po.reentry_states(spark.createDataFrame(rows, "k string, week int, alert boolean, confirmed boolean, calm boolean").repartition(3), ["k"], block=7).collect()}
    now = {}
    for k, w, alert, confirmed, calm in rows:
        was = now.get(k, "ARMED")
        now[k] = "DEFENSE" if alert and was != "DEFENSE" else "RECOVERY" if confirmed and was == "DEFENSE" else "ARMED" if calm and was == "RECOVERY" else was
        assert got[k, w] == now[k]
