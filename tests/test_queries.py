"""Every registered panel query against DuckDB, and operators on cases that the tables don't hold."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronopanel import plans
from chronopanel.functions import columns as C
from chronopanel.functions import text as tx
from chronopanel.operators import point_in_time as pit
from chronopanel.operators import portfolio as po
from chronopanel.operators import regimes as rg
from chronopanel.sources import store

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return str(v.date())
    return v if isinstance(v, bool) or v is None else float(v) if isinstance(v, int) else str(v)


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=str)


def _close(a, b):
    """Row by row the same but for the last digits of numbers."""
    alike = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.5e-6 + 1e-6 * abs(y)
    return len(a) == len(b) and all(alike(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = _sorted(df.select(*columns).collect())
    if name in plans.ORACLES:
        theirs = duck.sql(plans.ORACLES[name])
        assert sorted(theirs.columns) == columns
        expected = _sorted(theirs.select(*(f'"{c}"' for c in columns)).fetchall())
        assert mine == expected or _close(mine, expected)
    else:
        assert mine


# ---- cases


def _dates(spark, rows, *names):
    return spark.createDataFrame([tuple(datetime.date.fromisoformat(x) if isinstance(x, str) and x[:2] in ("19", "20", "99") else x for x in r) for r in rows], ", ".join(f"{n} {'date' if n.startswith(('date', 'effective', 'at')) else 'string'}" for n in names))


def test_membership_is_half_open(spark):
    iv = _dates(spark, [("A", "2020-01-01", None), ("B", "2020-01-01", "2020-02-01"), ("C", "2020-02-01", None)], "sid", "effective_from", "effective_to")
    days = _dates(spark, [("2020-01-31",), ("2020-02-01",), ("2019-12-31",)], "date")
    found = sorted((str(r.date), r.sid) for r in pit.members_on(iv, days).collect())
    assert found == [("2020-01-31", "A"), ("2020-01-31", "B"), ("2020-02-01", "A"), ("2020-02-01", "C")]
    assert pit.interval_faults(iv).count() == 0
    assert pit.members_on(iv.limit(0), days).count() == 0


def test_merged_intervals_keep_open_ends_and_nested_ones(spark):
    iv = _dates(spark, [("A", "2020-01-01", "2020-03-01"), ("A", "2020-01-15", "2020-01-20"), ("A", "2020-03-01", None), ("B", "2020-01-01", "2020-01-05"), ("B", "2020-01-06", "2020-01-07")], "sid", "effective_from", "effective_to")
    found = sorted((r.sid, str(r.effective_from), str(r.effective_to)) for r in pit.merged(iv).collect())
    assert found == [("A", "2020-01-01", "None"), ("B", "2020-01-01", "2020-01-05"), ("B", "2020-01-06", "2020-01-07")]


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_join_across_buckets(spark, inclusive):
    t = lambda m, d: datetime.datetime(2020, m, d)
    left = spark.createDataFrame([("a", t(1, 5), 1), ("a", t(3, 1), 2), ("a", t(6, 1), 3), ("b", t(1, 1), 4), (None, t(1, 1), 5)], "k string, ts timestamp, n int")
    right = spark.createDataFrame([("a", t(1, 5), 10), ("a", t(1, 20), 20), ("a", t(4, 2), 30), ("c", t(1, 1), 40)], "k string, ts timestamp, v int")
    found = {r.n: r.v for r in pit.asof_backward(left, right, ["k"], "ts", ["v"], inclusive=inclusive).collect()}
    assert found == {1: 10 if inclusive else None, 2: 20, 3: 30, 4: None, 5: None}


def test_a_late_revision_of_an_old_year_is_not_current(spark):
    d = datetime.date
    rows = [("e", 2019, d(2019, 12, 31), "a1", d(2020, 2, 1), 1.0), ("e", 2020, d(2020, 12, 31), "a2", d(2021, 2, 1), 2.0), ("e", 2019, d(2019, 12, 31), "a3", d(2021, 6, 1), 1.5)]
    fl = spark.createDataFrame([(*r[:4], r[4], r[4], r[5]) for r in rows], "entity string, fiscal_year int, period_end date, accession string, available date, accepted_at date, value double")
    signals = spark.createDataFrame([(d(2021, 3, 1),), (d(2021, 7, 1),)], "signal_date date")
    found = {str(r.signal_date): (r.current_accession, r.prior_accession) for r in pit.latest_filings(fl, signals).collect()}
    assert found == {"2021-03-01": ("a2", "a1"), "2021-07-01": ("a2", "a3")}


def test_book_values_match_a_day_by_day_pass(spark):
    import math
    import random

    rng = random.Random(1)
    days, names = 40, ["x", "y", "z"]
    px = {(s, i): (math.exp(rng.gauss(0, 0.05)) * 10, math.exp(rng.gauss(0, 0.05)) * 10) for s in names for i in range(1, days + 1)}
    gone = {("y", 18), ("y", 19)}
    targets = {3: {"x": 0.5, "y": 0.3}, 15: {"y": 0.6, "z": 0.2}, 27: {"x": 0.9}}
    rf, cost = 0.001, 0.002
    cash, shares, navs, last = 1.0, {}, {}, {}
    for i in range(1, days + 1):
        price = lambda s, k, i=i: last.get(s) if (s, i) in gone else px[s, i][k]  # noqa: B023, E731
        if i in targets:
            value = cash + sum(n * price(s, 0) for s, n in shares.items())
            was = {s: n * price(s, 0) / value for s, n in shares.items()}
            new = targets[i]
            value *= 1 - cost * sum(abs(new.get(s, 0) - was.get(s, 0)) for s in names)
            shares = {s: w * value / price(s, 0) for s, w in new.items()}
            cash = value * (1 - sum(new.values()))
        for s in names:
            if (s, i) not in gone:
                last[s] = px[s, i][1]
        if i >= 3:
            cash *= 1 + rf
            navs[i] = cash + sum(n * last[s] for s, n in shares.items())
    spine = spark.createDataFrame([(s, i, *((None, None) if (s, i) in gone else px[s, i])) for s in names for i in range(1, days + 1)], "sid string, idx int, open double, close double")
    market = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(i), i, rf) for i in range(1, days + 1)], "date date, idx int, rf double")
    wanted = spark.createDataFrame([(i, s, w) for i, t in targets.items() for s, w in t.items()], "execution_idx int, sid string, weight double")
    nav, steps = po.book_values(wanted, spine, market, cost * 1e4)
    assert {r.idx: r.nav for r in nav.collect()} == pytest.approx(navs, rel=1e-12)
    free, free_steps = po.book_values(wanted, spine, market)
    replay = po.replay_linear_cost(free, free_steps, [cost * 1e4])
    assert {r.idx: r.nav for r in replay.collect()} == pytest.approx(navs, rel=1e-12)


def test_states_with_gaps(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, 0.9, None, 0.7, 0.5, 0.7, 0.95])], "idx int, x double")
    found = [r.s for r in rows.select("idx", rg.hysteresis(F.col("x"), 0.8, 0.6).alias("s")).orderBy("idx").collect()]
    assert found == [False, True, True, True, False, False, True]
    runs = rg.runs(rows.withColumn("state", F.when(F.col("x") > 0.6, "hi").when(F.col("x").isNotNull(), "lo"))).orderBy("first").collect()
    assert [(r.state, r.first, r.length) for r in runs] == [("lo", 0, 1), ("hi", 1, 1), ("hi", 3, 1), ("lo", 4, 1), ("hi", 5, 2)]


def test_average_ranks_and_returns(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 5.0), (1, None), (2, 1.0)], "k int, x double")
    found = sorted((r.k, r.x or 0, r.r, r.c) for r in rows.select("k", "x", C.average_rank(F.col("x"), ["k"]).alias("r"), C.centered_rank(F.col("x"), ["k"]).alias("c")).fillna(-9).collect())
    assert found == [(1, -9.0, -9.0, -9.0), (1, 2.0, 1.5, -0.5), (1, 2.0, 1.5, -0.5), (1, 5.0, 3.0, 1.0), (2, 1.0, 1.0, -9.0)]
    assert spark.range(1).select(C.simple_return(F.lit(0.0), F.lit(2.0)).alias("r")).first().r is None


def test_tables_are_written_once_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    at = str(tmp_path / "t")
    store.write_once(df, at, ["k"])
    assert store.is_intact(spark, at)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.write_once(df, at, ["k"])
    with pytest.raises(ValueError, match="repeated keys"):
        store.write_once(df.union(df), str(tmp_path / "u"), ["k"])
    same = [store.content_hash(x, ["k", "v"]).first().content for x in (df, df.orderBy(F.desc("k")), df.withColumn("v", F.coalesce("v", F.lit(""))))]
    assert same[0] == same[1] != same[2]


def test_strict_booleans(spark):
    rows = spark.createDataFrame([(" TRUE",), ("0",), (None,)], "x string")
    assert [r.b for r in rows.select(tx.strict_boolean(F.col("x")).alias("b")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(tx.strict_boolean(F.col("x")).alias("b")).collect()


def test_stream_windows_go_on_from_the_checkpoint(spark, tmp_path):
    from chronopanel.streaming import vintages

    t = lambda d, h: datetime.datetime(2024, 1, d, h)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, user_id long, value double"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = vintages.tumbling(vintages.read_events(spark, source, schema), "ts", ["user_id"], "1 day", "1 day")
        vintages.run_available(stream, out, mark)

    put([(t(1, 1), 1, 1.0), (t(1, 2), 1, 2.0), (t(1, 3), 2, 5.0), (t(2, 1), 1, 4.0)])
    put([(t(1, 23), 1, 8.0), (t(5, 1), 1, 1.0)])
    put([(t(1, 5), 1, 100.0), (t(9, 1), 1, 1.0)])
    found = sorted((r.user_id, r.start.day, r.n, r.total) for r in spark.read.parquet(out).collect())
    assert found == [(1, 1, 3, 11.0), (1, 2, 1, 4.0), (1, 5, 1, 1.0), (2, 1, 1, 5.0)]


def test_provider_files(spark, tmp_path):
    import json

    from chronopanel.sources import files

    at = tmp_path / "vix.csv"
    at.write_text("DATE,Open,Close \n01/02/2020,12,13.5\n2020-01-03,13,14\n")
    assert [(str(r.date), r.close, r.provider) for r in files.read_closes(spark, str(at), "p").orderBy("date").collect()] == [("2020-01-02", 13.5, "p"), ("2020-01-03", 14.0, "p")]
    at.write_text("date,close\n2020-01-02,1\n01/02/2020,2\n")
    with pytest.raises(ValueError, match="more than once"):
        files.read_closes(spark, str(at), "p")
    at.write_text("date,price\n2020-01-02,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_closes(spark, str(at), "p")
    at.write_text("date,rf_return\n2020-01-02,0.0001\n2020-01-03,0.5\n")
    with pytest.raises(ValueError, match="beyond"):
        files.read_rates(spark, str(at))
    day = {"date": "2020-01-02T00:00:00.000Z", **{k: 10.0 for k in ("open", "high", "low", "close", "adjOpen", "adjHigh", "adjLow", "adjClose")}, "volume": 5, "divCash": 0.0, "splitFactor": 1.0}
    js = tmp_path / "p.json"
    js.write_text(json.dumps([day, {**day, "date": "2020-01-03", "splitFactor": 2.0}]))
    assert [(str(r.date), r.sid, r.tr_close, r.stock_splits) for r in files.read_prices(spark, str(js), "A").orderBy("date").collect()] == [("2020-01-02", "A", 10.0, 0.0), ("2020-01-03", "A", 10.0, 2.0)]
    js.write_text(json.dumps([{**day, "adjOpen": 0.0}]))
    with pytest.raises(ValueError, match="not positive"):
        files.read_prices(spark, str(js), "A")
    wide = spark.createDataFrame([("2020-01-02", 1.0, 2.0, 3.0)], "date string, `close:A` double, `close:B` double, `open:A` double")
    assert sorted((r.sid, r.close, r.open) for r in files.long_fields(wide).collect()) == [("A", 1.0, 3.0), ("B", 2.0, None)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_adjusted_p_values_of_large_families(spark, keys):
    import random

    from chronopanel.operators import inference as inf

    rng = random.Random(4)
    rows = [("big" if i % 10 else rng.choice(["small", None]), i, None if i % 97 == 0 else round(rng.random() ** 3, 4)) for i in range(5000)]
    rows += [("ties", 9000 + i, 0.25) for i in range(700)] + [("none", 9900, None)]
    q, holm = {}, {}
    for family in {r[0] for r in rows} if keys else {""}:
        have = sorted((p, i) for k, i, p in rows if p is not None and (not keys or k == family))
        m, low, high = len(have), 1.0, 0.0
        for r in range(m, 0, -1):
            low = q[have[r - 1][1]] = min(low, have[r - 1][0] * m / r)
        for r in range(1, m + 1):
            high = max(high, (m - r + 1) * have[r - 1][0])
            holm[have[r - 1][1]] = min(1.0, high)
    tests = spark.createDataFrame(rows, "k string, i int, p double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for made, expected in ((inf.with_false_discovery_rate(tests, "p", "i", keys), q), (inf.with_holm(tests, "p", "i", keys), holm)):
            assert made.columns[:3] == tests.columns and len(made.columns) == 4
            found = made.withColumn("task", F.spark_partition_id()).collect()
            assert {r[1]: r[3] for r in found if r[3] is not None} == pytest.approx(expected, abs=1e-12)
            assert sorted(r[1] for r in found) == sorted(r[1] for r in rows)
            assert len({r.task for r in found if r.k == "big"}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert inf.with_holm(tests.limit(0), "p", "i", keys).count() == 0


@pytest.mark.parametrize("name", ["sta_10_false_discovery_rate", "sta_12_holm"])
def test_every_order_has_an_adjusted_p_value(spark, name):
    assert plans.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


@pytest.mark.parametrize(("name", "table", "by", "key"), [("val_06_action_faults", "orders", "action_id", "o_orderkey"), ("val_07_action_sessions", "orders", "action_id", "o_orderkey"), ("jon_08_name_candidates", "supplier", "sid", "s_suppkey")])
def test_ids_beyond_the_first_have_verdicts(spark, name, table, by, key):
    """Some of the upper half of the ids are found, and of the suppliers all."""
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    ids = {r[by] for r in plans.QUERIES[name](spark, SF).select(by).collect()}
    assert max(ids) > whole.agg(F.max(key)).first()[0] / 2
    assert table != "supplier" or len(ids) == whole.count()


def test_every_name_has_a_borrow_rate(spark):
    from chronopanel.sources import panel

    assert plans.QUERIES["sim_13_borrow_rates"](spark, SF).count() == panel.prices(spark, SF).count()


def test_rows_of_one_time_are_put_in_order(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 50, 2)], "k string, ts int, n int")
    right = spark.createDataFrame([("a", 5, v) for v in (3, 9, 1)], "k string, ts int, v int")
    for parts in (1, 3):
        found = pit.asof_backward(left, right.repartition(parts), ["k"], "ts", ["v"], F.floor(F.col("ts") / 10))
        assert {r.n: r.v for r in found.collect()} == {1: 9, 2: 9}
    days = _dates(spark, [("2020-01-01",), ("2020-01-02",)], "date")
    first = datetime.date(2020, 1, 1)
    steps = spark.createDataFrame([(first, 0.5, 2), (first, 0.9, 1)], "date date, w double, o int")
    assert [r.w for r in pit.held(steps, days, "w").collect()] == [0.9, 0.9]
    assert [r.w for r in pit.held(steps, days, "w", order="o").collect()] == [0.5, 0.5]


def test_an_overlap_with_any_earlier_interval_is_a_fault(spark):
    iv = _dates(spark, [("A", "2020-01-01", "2020-12-31"), ("A", "2020-02-01", "2020-02-10"), ("A", "2020-03-01", "2020-03-05"), ("B", "2020-01-01", None), ("B", "2020-02-01", "2020-02-02"), ("B", "2020-03-01", "2020-03-02")], "sid", "effective_from", "effective_to")
    found = sorted((r.sid, str(r.effective_from), r.fault) for r in pit.interval_faults(iv).collect())
    assert found == [("A", "2020-02-01", "overlap"), ("A", "2020-03-01", "overlap"), ("B", "2020-02-01", "open_not_last"), ("B", "2020-03-01", "open_not_last")]
    ends = _dates(spark, [("A", "2020-01-01", "9999-12-31"), ("B", "2020-01-01", None)], "sid", "effective_from", "effective_to")
    assert sorted((r.sid, str(r.effective_to)) for r in pit.merged(ends).collect()) == [("A", "9999-12-31"), ("B", "None")]


def test_the_row_before_across_buckets(spark):
    rows = spark.createDataFrame([(i, f"v{i}" if i != 7 else None) for i in (1, 2, 7, 25, 26, 60)], "id int, v string").repartition(3)
    found = {r.id: r.b for r in pit.with_previous(rows, "id", F.col("v"), F.floor(F.col("id") / 10), "b").collect()}
    assert found == {1: None, 2: "v1", 7: "v2", 25: None, 26: "v25", 60: "v26"}


def test_joins_hold_to_their_cardinality(spark):
    from chronopanel.operators import contracts as ct

    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "k int, y int")
    assert ct.checked_join(two, one, ["k"], "n:1").count() == 2
    with pytest.raises(Exception, match="right: more than one row for 1"):
        ct.checked_join(one, two, ["k"], "1:1").collect()


def test_logistic_fit_is_where_the_gradient_is_zero(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = rng.random(300) < 1 / (1 + np.exp(-(0.4 - 1.3 * x)))
    from chronopanel.operators import models as mo

    rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)] + [(None, True)], "x double, y boolean")
    found = mo.logistic(rows, "x", "y").first()
    p = 1 / (1 + np.exp(-(found.intercept + found.slope * x)))
    assert found.n == 300 and abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6


def test_price_delay_against_two_fits(spark):
    import numpy as np

    from chronopanel.operators import market_factors as mf

    rng = np.random.default_rng(4)
    n = 70
    first = datetime.date(2020, 1, 1)
    market = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    name = 50 * np.exp(np.cumsum(np.r_[0, 0.6 * np.diff(np.log(market))] + rng.normal(0, 0.01, n)))
    days = [first + datetime.timedelta(7 * i) for i in range(n)]
    m = spark.createDataFrame([(d, i, True, float(c)) for i, (d, c) in enumerate(zip(days, market, strict=True))], "date date, idx int, week_last boolean, close double")
    s = spark.createDataFrame([(d, "A", i, True, float(c)) for i, (d, c) in enumerate(zip(days, name, strict=True))], "date date, sid string, idx int, week_last boolean, close double")
    found = {r.date: r.delay for r in mf.price_delay(s, m).collect()}
    x, y = market[1:] / market[:-1] - 1, name[1:] / name[:-1] - 1
    for end in (50, 60, n - 1):
        rows = [t for t in range(max(0, end - 51), end + 1) if t >= 5]
        fits = []
        for lags in (1, 5):
            a = np.array([[1, *(x[t - 1 - k] for k in range(lags))] for t in rows])
            b = np.array([y[t - 1] for t in rows])
            rest = b - a @ np.linalg.solve(a.T @ a, a.T @ b)
            fits.append(1 - (rest @ rest) / ((b - b.mean()) @ (b - b.mean())))
        assert abs(found[days[end]] - (1 - fits[0] / fits[1])) < 1e-9
