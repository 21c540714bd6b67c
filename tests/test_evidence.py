"""Tails, positive ridges, name scores, panels by change dates, evidence of skips, chains and bundles against plain versions."""

import datetime
import difflib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import plans
from chronopanel.functions import text as tx
from chronopanel.operators import actions as ac
from chronopanel.operators import entities as en
from chronopanel.operators import fundamentals as fu
from chronopanel.operators import positive_ridge as pr
from chronopanel.operators import repair as rp
from chronopanel.operators import signed_ranks as sr
from chronopanel.sources import store


def _mean_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_signed_rank_tails_are_those_of_all_signs(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([0.0, round(rng.gauss(0.3, 1), 1), float(rng.randint(-3, 3))])) for n in range(3, 17) for _ in range(n)] + [(99, None), (99, float("nan")), (99, 2.0)]
    df = spark.createDataFrame(rows, "k int, d double").repartition(3)
    for r in sr.signed_rank_test(df, "d", ["k"]).collect():
        values = [d for k, d in rows if k == r.k and d is not None and not math.isnan(d) and d]
        ranks = _mean_ranks([abs(v) for v in values])
        w = sum(q for q, v in zip(ranks, values, strict=True) if v > 0)
        sums = [sum(itertools.compress(ranks, signs)) for signs in itertools.product((0, 1), repeat=len(values))]
        assert (r.n, r.w_plus, r.is_exact) == (len(values), w, True) and r.p_greater == pytest.approx(sum(s >= w for s in sums) / len(sums), abs=1e-12)
    many = spark.createDataFrame([(i, rng.gauss(0.1, 1)) for i in range(120)], "i int, d double")
    exact, near = (sr.signed_rank_test(many, "d", exact_most=m).first() for m in (300, 10))
    assert exact.is_exact and not near.is_exact and near.p_greater == pytest.approx(exact.p_greater, abs=2e-3)


def test_positive_ridge_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(8)]
    rows = []
    for key in range(5):
        truth = rng.normal(size=8) * (rng.random(8) < 0.6)
        x = rng.normal(size=(60, 8))
        x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=60)
        rows += [(key, *map(float, v), float(3 + v @ truth + rng.normal())) for v in x]
    rows += [(7, *([1.0] * 8), float(i)) for i in range(4)] + [(0, None, *([1.0] * 7), 1.0)]
    df = spark.createDataFrame(rows, "key int, " + ", ".join(f"{c} double" for c in names) + ", y double").repartition(4)
    for r in pr.positive_ridge(pr.keyed_moments(df, ["key"], names, "y"), ["key"], names, 0.5).collect():
        mine = np.array([v[1:] for v in rows if v[0] == r.key and v[1] is not None])
        x, y = mine[:, :8], mine[:, 8]
        b = np.array(r.beta[1:])
        residual = y - r.beta[0] - x @ b
        gradient = x.T @ residual - 0.5 * b
        assert r.n == len(y) and (b >= 0).all() and abs(residual.sum()) < 1e-6
        assert (gradient <= 1e-6).all() and np.abs(gradient[b > 0]).max(initial=0) < 1e-6


def test_name_scores_are_those_of_a_plain_matcher(spark):
    rng = random.Random(4)
    said = ["", "a", "acme tools", "acme tool works", "tools of acme", "aaaa", "aabaa", "müller söhne"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = [(a, b) for a in said for b in rng.sample(said, 12)] + [(None, "a"), ("a", None)]
    out = spark.createDataFrame(rows, "a string, b string").withColumn("r", tx.sequence_ratio(F.col("a"), F.col("b"))).withColumn("s", tx.name_score(F.col("a"), F.col("b")))
    for r in out.collect():
        if r.a is None or r.b is None:
            assert r.r is None and r.s == 0
        else:
            ratio = difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
            assert r.r == pytest.approx(ratio, abs=1e-12)
            words = lambda s: set(s.split(" "))
            expected = 0 if not r.a or not r.b else 1 if r.a == r.b else 0.6 * ratio + 0.4 * len(words(r.a) & words(r.b)) / len(words(r.a) | words(r.b))
            assert r.s == pytest.approx(expected, abs=1e-12)
    names = spark.createDataFrame([(1, "Acme Tool Works Inc"), (2, "Bolt & Nut Co")], "sid long, name string")
    lookup = spark.createDataFrame([(10, "acme tool works"), (11, "bolt and small nut"), (12, "other nut")], "cik long, name string")
    found = {(r.sid, r.cik): (r.is_exact, r.score) for r in en.scored_candidates(names, lookup).collect()}
    assert found[1, 10] == (True, 1.0) and set(found) == {(1, 10), (2, 11)} and 0.6 < found[2, 11][1] < 1


def test_panel_computes_a_state_for_each_change_and_no_more(spark):
    rng = random.Random(5)
    day = lambda d: datetime.date(2000, 1, 1) + datetime.timedelta(days=d)
    facts = [(rng.choice("ABC"), rng.choice(["x", "y", "other"]), float(rng.randint(0, 9)), day(rng.randint(0, 300)), day(rng.randint(0, 300))) for _ in range(60)]
    mapping = [("s1", "A", day(0), None), ("s2", "B", day(50), day(200)), ("s3", "none", day(10), day(20)), ("s1b", "A", day(100), day(101))]
    df = spark.createDataFrame(facts, "entity string, metric_id string, value double, period_end date, available date")
    mp = spark.createDataFrame(mapping, "sid string, entity string, effective_from date, effective_to date")
    states = fu.change_date_states(df, ["x", "y"])
    assert states.count() <= sum(f[1] != "other" for f in facts)
    factors = {"ratio": F.try_divide("x", "y"), "x": F.col("x")}
    panel = fu.change_date_panel(df, mp, ["x", "y"], factors)
    assert panel.count() <= 2 * (2 * states.count() + len(mapping))
    signals = [day(d) for d in range(0, 320, 3)]
    out = fu.at_signals(panel, spark.createDataFrame([(d,) for d in signals], "signal_date date"))
    got = {(r.sid, r.signal_date, r.factor_id): (r.value, r.reason) for r in out.collect()}
    expected = {}
    for sid, entity, a, z in mapping:
        for d in signals:
            if a <= d and (z is None or d < z):
                last = {}
                for m in ("x", "y"):
                    known = [(f[3], f[4], f[2]) for f in facts if f[:2] == (entity, m) and max(f[3], f[4]) <= d]
                    last[m] = max(known)[2] if known else None
                missing = ";".join(f"missing_metric:{m}" for m in ("x", "y") if last[m] is None) or "undefined"
                ratio = last["x"] / last["y"] if last["x"] is not None and last["y"] else None
                expected[sid, d, "ratio"] = (ratio, None if ratio is not None else missing)
                expected[sid, d, "x"] = (last["x"], None if last["x"] is not None else missing)
    assert got == expected


def test_each_kind_of_gap_is_found(spark):
    opens = {"a": {0, 1, 2, 6, 7}, "b": {0, 1, 9}, "c": {0, 1}, "d": {0, 200}}
    spine = spark.createDataFrame([(s, i, 1.0 if i in opens[s] else None) for s in opens for i in range(201)], "sid string, idx int, open double")
    gaps = spark.createDataFrame([("a", 4), ("b", 3), ("b", 5), ("c", 4), ("d", 70)], "sid string, idx int")
    actions = spark.createDataFrame([("a", 4), ("b", 6), ("b", 40), ("c", 5), ("d", 96)], "source_sid string, apply_idx int")
    got = {(r.sid, r.idx): tuple(r)[2:] for r in ac.skip_evidence(gaps, actions, spine, 25).collect()}
    assert got == {
        ("a", 4): (4, "same_open", 2, 6, True),
        ("b", 3): (6, "pending_action", 1, 9, True),
        ("b", 5): (6, "pending_action", 1, 9, True),
        ("c", 4): (5, "pending_action", 1, None, False),
        ("d", 70): (None, "none", 0, 200, False),
    }


def test_chains_are_those_of_a_step_by_step_walk(spark):
    edges = [(i, i + 1, 1 + i % 3 / 2) for i in range(1, 70)] + [(100, 101, 2.0), (101, 102, 2.0), (102, 100, 2.0), (99, 100, 3.0), (98, 99, 1.0), (200, 200, 1.0), (300, 301, 1.0), (300, 302, 1.0), (299, 300, 4.0)]
    got = {r.source: tuple(r)[1:] for r in rp.chained_conversions(spark.createDataFrame(edges, "source long, target long, ratio double").repartition(3)).collect()}
    out = {}
    for s, t, r in edges:
        out.setdefault(s, []).append((t, r))
    for s in out:
        if len(out[s]) > 1:
            assert got[s] == (None, None, None, "ambiguous")
            continue
        at, ratio, steps, seen = s, 1.0, 0, []
        while at in out and len(out[at]) == 1 and at not in seen:
            seen.append(at)
            at, ratio, steps = out[at][0][0], ratio * out[at][0][1], steps + 1
        if at in seen:
            assert got[s] == (None, None, None, "cycle" if at == s else "into_cycle")
        else:
            assert got[s][0] == at and got[s][1] == pytest.approx(ratio) and got[s][2:] == (steps, "chain")
    assert set(got) == set(out)


def test_a_bundle_is_seen_when_its_manifest_is_and_not_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/bundle"
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(4).selectExpr("id AS k", "'x|y' AS said")
    plain, calls = store.content_hash, []

    def stops(df, columns):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return plain(df, columns)

    monkeypatch.setattr(store, "content_hash", stops)
    with pytest.raises(OSError):
        store.publish_bundle({"a": (a, ["k"]), "b": (b, ["k"])}, path)
    with pytest.raises(FileNotFoundError):
        store.read_bundle(spark, path, "a")
    monkeypatch.setattr(store, "content_hash", plain)
    with pytest.raises(ValueError):
        store.publish_bundle({"a": (a.union(a), ["k"])}, path)
    with pytest.raises(FileNotFoundError):
        store.bundle_manifest(spark, path)
    store.publish_bundle({"a": (a, ["k"]), "b": (b, ["k"])}, path, "second try")
    assert store.bundle_manifest(spark, path)["note"] == "second try"
    assert sorted(r.k for r in store.read_bundle(spark, path, "a").collect()) == list(range(10)) and store.read_bundle(spark, path, "b").dtypes == b.dtypes
    assert {tuple(r) for r in store.bundle_audit(spark, path).collect()} == {("a", 10, True), ("b", 4, True)}
    with pytest.raises(FileExistsError):
        store.publish_bundle({"a": (a, ["k"])}, path)
    folder = next(e["folder"] for e in store.bundle_manifest(spark, path)["tables"] if e["name"] == "b")
    b.where("k < 3").write.mode("overwrite").parquet(f"{path}/{folder}")
    assert {tuple(r) for r in store.bundle_audit(spark, path).collect()} == {("a", 10, True), ("b", 3, False)}


def test_written_tables_go_when_they_are_cleared(spark):
    own = spark.newSession()
    at = store.shared_folder(own)
    table = store.materialized(own.range(5))
    assert table.count() == 5 and at == store.shared_folder(spark)
    fs, path = store._file_system(own, f"{at}/tables/{own.sparkContext.applicationId}")
    assert fs.exists(path)
    store.clear(own)
    assert not fs.exists(path)


def test_a_hash_tells_separators_and_nulls_apart(spark):
    rows = spark.createDataFrame([("2001-01-01", "a|b", "c"), ("2001-01-01", "a", "b|c"), ("2001-01-01", None, ""), ("2001-01-01", "", None)], "date string, x string, y string").withColumn("date", F.to_date("date"))
    assert store.hashed_rows(rows, ["x", "y"], "s", 1).select("record_hash").distinct().count() == 4


def test_rekeyed_totals_are_sums_of_rekeyed_rows(spark):
    rng = random.Random(26)
    day = lambda n: datetime.date(1969, 6, 1) + datetime.timedelta(n)
    odd = [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), None]
    symbols = ["A", "B", "C", None]
    rows = [(rng.choice(symbols), day(rng.randrange(300)) if rng.random() < 0.9 else None, rng.choice([None, 2.0**60, *(float(rng.randrange(1000)) for _ in range(6))])) for _ in range(400)]
    rows += [("A", day(77), float("nan")), ("B", day(130), float("inf")), ("D", day(400), None)]
    maps = [(rng.randrange(60), rng.choice([*symbols, "D", "E"]), *(day(rng.randrange(-20, 420)) if rng.random() < 0.8 else rng.choice(odd) for _ in range(2))) for _ in range(300)]
    maps += maps[:5] + [(70, "A", day(0), None), (71, "A", day(77), day(78)), (72, "A", day(78), day(77)), (73, "D", day(0), None)]
    mappings = spark.createDataFrame(maps, "sid int, symbol string, effective_from date, effective_to date").repartition(3)

    def check(history):
        found = {r.sid: (r.n, r.total) for r in en.rekeyed_totals(history, mappings, "close").collect()}
        pairs = en.rekeyed(history, mappings).groupBy("sid").agg(F.count("*").alias("n"), F.sum("close").alias("total"))
        assert found == {r.sid: (r.n, r.total if r.total is None else pytest.approx(r.total, rel=1e-14, nan_ok=True)) for r in pairs.collect()}
        return found

    history = lambda made: spark.createDataFrame(made, "symbol string, date date, close double").repartition(3)
    found = check(history(rows))
    assert math.isnan(found[70][1]) and 72 not in found and found[73] == (1, None) and any(math.isfinite(t or 0) for _, t in found.values())
    assert len(check(history(rows[-2:-1]))) > 0 and check(history([])) == {}
    # The first day that there is, and the last.
    assert len(check(history([*rows, ("A", odd[0], 1.0), ("B", odd[1], 3.0)]))) > 0


def test_rekeyed_history_makes_no_row_for_each_pair(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    n, start = 3000, datetime.date(1994, 1, 1)
    orders = [(900 * i, datetime.datetime(1995, 1, 1) + datetime.timedelta(i * 7 % 900), i + 0.25) for i in range(n)]
    own.createDataFrame(orders, "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    own.createDataFrame([(900 * i,) for i in range(n)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    df = plans.QUERIES["src_26_rekeyed_history"](own, str(tmp_path))
    found = {r.sid: (r.n, r.total) for r in df.collect()}
    expected = {}
    for sid in range(0, 900 * n, 900):
        first = start + datetime.timedelta(sid % 2500)
        held = [v for _, d, v in orders if first <= d.date() < first + datetime.timedelta(500)]
        if held:
            expected[sid] = (len(held), sum(held))
    assert found == expected and sum(k for k, _ in expected.values()) > 1_000_000

    def made(node):
        rows = node.metrics().get("numOutputRows")
        below = node.children()
        return max([rows.get().value() if rows.isDefined() else 0, *(made(below.apply(i)) for i in range(below.size()))])

    assert made(df._jdf.queryExecution().executedPlan()) < 50 * n
