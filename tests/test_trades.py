import datetime as dt
import math
import statistics

import pytest
from evidex.functions import scalars as S
from evidex.functions import semantics as M
from evidex.operators import costs, drawdown, nulls, temporal, timing
from evidex.operators import trades as T
from evidex.plans import trade_battery
from evidex.sources import synthetic
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def bars_of(spark, opens, symbol="@ES"):
    rows = [(symbol, i, T0 + dt.timedelta(hours=i), float(o), float(o) + 1, float(o) - 1, float(o), 1.0) for i, o in enumerate(opens)]
    return spark.createDataFrame(rows, "symbol string, bar_idx bigint, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def trades_of(spark, rows, opens, symbol="@ES"):
    out = []
    for i, (e, x, d) in enumerate(rows):
        g = d * (opens[x] - opens[e]) * 2.0
        out.append((0, i, symbol, d, T0 + dt.timedelta(hours=e), T0 + dt.timedelta(hours=x), float(opens[e]), float(opens[x]), 1, g, g - 5.4, 2.2, 0.5))
    return spark.createDataFrame(out, "strategy_id bigint, trade_id bigint, symbol string, direction int, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, contracts int, gross_pnl double, net_pnl double, comm_side double, slip_side double")


def pnl_of(spark, values):
    return spark.createDataFrame([(0, i, T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i, hours=1), float(v)) for i, v in enumerate(values)], "strategy_id bigint, trade_id bigint, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl double")


def test_baseline_is_the_mean_of_forward_returns(spark):
    opens = [100, 102, 101, 105, 104, 108]
    b = bars_of(spark, opens)
    j = T.join_bars(trades_of(spark, [(0, 1, 1), (1, 3, -1)], opens), b)
    got = {r.trade_id: (r.base_mean, r.base_win) for r in T.with_baseline(j, b).collect()}
    f1 = [y / x - 1 for x, y in zip(opens, opens[1:], strict=False)]
    f2 = [y / x - 1 for x, y in zip(opens, opens[2:], strict=False)]
    assert got[0] == pytest.approx((statistics.mean(f1), sum(f > 0 for f in f1) / 5))
    assert got[1] == pytest.approx((-statistics.mean(f2), sum(f < 0 for f in f2) / 4))


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([100, -50, -70, 30, 200, -20, -300, 50, 100, 500], [(0, 2, 4, -120.0), (4, 6, 9, -320.0)]),
        ([-100, -100, 300, 50], [(-1, 1, 2, -200.0)]),
        ([100, -50], [(0, 1, None, -50.0)]),
        ([5, 5], []),
    ],
)
def test_drawdown_episodes(spark, values, want):
    p = pnl_of(spark, values)
    got = drawdown.episodes(drawdown.equity(p)).orderBy("peak_i").collect()
    assert [(r.peak_i, r.trough_i, r.recovery_i, r.depth) for r in got] == want


def brute_equity(pnl):
    eq = top = 0.0
    out, start, low = [], None, None
    eps = []
    for k, x in enumerate(pnl):
        eq += x
        top = max(top, eq)
        out.append((k, eq, eq - top))
        if eq < top:
            start = k - 1 if start is None else start
            low = (eq - top, k) if low is None or eq - top < low[0] else low
        elif start is not None:
            eps.append((start, low[1], k, low[0]))
            start = low = None
    if start is not None:
        eps.append((start, low[1], None, low[0]))
    return out, eps


def test_one_hot_strategy_is_scanned_in_ranges(spark):
    """Nearly all rows are one strategy's: it lies in many ranges, and equals one pass over all of it. Null is a strategy too."""
    import random

    rng = random.Random(4)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 3)
    by = {1: [float(rng.randint(-9, 9)) for _ in range(3000)], 2: [-5.0, 5.0, 1.0], None: [3.0, -1.0]}
    rows = [(s, k, at(k), at(k + 1), x) for s, xs in by.items() for k, x in enumerate(xs)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pnl = spark.createDataFrame(rows, "strategy_id long, trade_id long, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl double").repartition(3)
        eq = drawdown.equity(pnl)
        parts = {r.part: r.n for r in eq.where("strategy_id = 1").groupBy("part").agg(F.count("*").alias("n")).collect()}
        assert len(parts) > 2 and max(parts.values()) < 2000
        got, eps = eq.collect(), drawdown.episodes(eq).collect()
        deep = drawdown.by_depth(drawdown.episodes(eq)).where("strategy_id = 1").orderBy("rank").collect()
        tail = {r.strategy_id: r.cdar for r in drawdown.cdar(drawdown.episodes(eq)).collect()}
        summary = drawdown.drawdown_summary(pnl).where("strategy_id = 1").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s, xs in by.items():
        want, runs = brute_equity(xs)
        assert sorted((r.seq, r.eq, r.dd) for r in got if r.strategy_id == s) == want
        assert sorted((r.peak_i, r.trough_i, r.recovery_i, r.depth) for r in eps if r.strategy_id == s) == runs
    depths = sorted(-e[3] for e in brute_equity(by[1])[1])
    assert [(r["rank"], -r.depth) for r in deep] == list(enumerate(reversed(depths)))
    worst = depths[::-1][: math.ceil((1.0 - 0.8) * len(depths))]
    assert tail[1] == pytest.approx(sum(worst) / len(worst)) == pytest.approx(summary.cdar)
    assert summary.median_dd == pytest.approx(statistics.median(depths))


def test_drawdown_summary(spark):
    p = pnl_of(spark, [100, -50, -70, 30, 200, -20, -300, 50, 100, 500])
    r = drawdown.drawdown_summary(p).first()
    assert (r.max_dd, r.cdar, r.capital, r.capital_basis, r.median_dd, r.n_unrecovered) == (320, 320, 1600, "5 x CDaR-80", 220, 0)
    assert drawdown.drawdown_summary(p, capital=1000.0).first().capital_basis == "fixed"
    assert drawdown.drawdown_summary(pnl_of(spark, [1, 1])).first().calmar is None
    with pytest.raises(ValueError):
        drawdown.drawdown_summary(p, capital=0.0)


def test_delays_on_a_ramp(spark):
    opens = [100 + i for i in range(31)]
    b = bars_of(spark, opens)
    j = T.join_bars(trades_of(spark, [(10, 20, 1)], opens), b)
    at = lambda *a, **k: {r.k: r.pct for r in timing.shifted(j, b, *a, max_k=12, **k).collect()}
    entry, exit_ = at("entry"), at("exit")
    for k in range(10):
        assert entry[k] == pytest.approx(120 / (110 + k) - 1)
        assert exit_[k] == pytest.approx((120 + k) / 110 - 1)
    assert entry[10] is None and exit_[10] is not None and exit_[11] is None
    assert at("entry", mode="fixed_hold")[3] == pytest.approx(123 / 113 - 1)
    assert at("exit", early=True)[9] == pytest.approx(111 / 110 - 1) and at("exit", early=True)[10] is None
    assert at("entry", early=True)[10] == pytest.approx(120 / 100 - 1) and at("entry", early=True)[11] is None
    for bad in ({"leg": "x"}, {"leg": "entry", "mode": "y"}, {"leg": "entry", "max_k": 0}, {"leg": "entry", "max_k": True}):
        with pytest.raises(ValueError):
            timing.shifted(j, b, **bad)
    c = timing.delay_curve(timing.shifted(j, b, "exit", max_k=12, early=True)).where("k = 12").first()
    assert (c.n_alive, c.total_usd, c.mean_usd) == (0, 0.0, None)


def test_cost_curve(spark):
    opens = [100, 110, 120, 125, 120]
    b = bars_of(spark, opens, "@XX")
    j = T.join_bars(trades_of(spark, [(0, 1, 1), (2, 4, 1)], opens, "@XX"), b)
    based = T.with_baseline(j, b)
    c = costs.cost_per_strategy(j)
    assert (c.first().source, c.first().cost) == ("report", pytest.approx(5.4))
    s = costs.cost_summary(based, c).first()
    assert s.gross_mean_usd == 10 and s.net_pf_1x == pytest.approx((20 - 5.4) / 5.4)
    curve = {r.mult: r.net_mean_usd for r in costs.cost_curve(based, c).collect()}
    assert curve[0.0] == 10 and curve[20.0] == pytest.approx(10 - 108)


def test_checks_name_what_is_wrong(spark):
    opens = [100 + i % 5 for i in range(60)]
    b = bars_of(spark, opens)
    good = trades_of(spark, [(i, i + 3, 1 if i % 2 else -1) for i in range(0, 50)], opens)
    failed = lambda t, **k: {r["name"] for r in T.join_checks(T.join_bars(t, b), b, **k).where("not passed").collect()}
    assert failed(good) == set()
    assert failed(good.withColumn("entry_time", F.expr("entry_time + interval 5 minutes"))) >= {"timestamps_found"}
    assert failed(good.withColumn("entry_price", F.lit(500.0))) >= {"prices_in_bar_range", "point_value_constant"}
    assert failed(good.withColumn("net_pnl", F.lit(0.0))) == {"net_reconciles"}
    assert failed(good.limit(5)) == {"min_trades"}
    interval = spark.createDataFrame([(0, "30 min.")], "strategy_id bigint, interval string")
    assert failed(good, settings=interval) == {"interval_matches_bars"}
    with pytest.raises(T.ValidationFailed):
        trade_battery.run(good.withColumn("entry_price", F.lit(500.0)), b, n_perm=5)


def test_windows_partition_the_trades(spark):
    b = synthetic.make_bars(spark, 801, seed=3).cache()
    j = T.join_bars(synthetic.make_trades(b, 60, seed=3), b)
    w = temporal.window_results(j, b)
    assert w.agg(F.sum("n")).first()[0] == 60 and w.count() == 4
    sizes = sorted(r["count"] for r in temporal.bar_windows(b).groupBy("window").count().collect())
    assert sizes == [200, 200, 200, 201]
    assert temporal.window_score(w).first().windows_total <= 4
    both = temporal.regime_results(j, b)
    assert both.agg(F.sum("n")).first()[0] == 60


def test_battery_passes_a_planted_edge_and_fails_noise(spark):
    b = synthetic.make_bars(spark, 3000, seed=5).cache()
    t = synthetic.make_trades(b, 60, seed=5, edge=True).union(synthetic.make_trades(b, 60, seed=6, strategy_id=1)).cache()
    r = trade_battery.run(t, b, n_perm=99, margin=2000.0)
    v = {x.strategy_id: x for x in r.verdicts.collect()}
    assert v[0].random_entry == "pass" and v[0].cost == "pass" and v[0].gates_passed == 2
    assert v[1].random_entry == "fail"
    n = {x.strategy_id: x for x in r.random_entry.collect()}
    assert n[1].null_mean == pytest.approx(n[1].baseline_mean, abs=4 * n[1].null_std / math.sqrt(99))
    j = r.json().collect()
    assert len(j) == 2 and all("NaN" not in x.json and "Infinity" not in x.json for x in j)
    assert trade_battery.run(t.where("strategy_id = 0").limit(20), b, n_perm=9).verdicts.first().random_entry == "insufficient"
    timed = trade_battery.run_timing(t, b, max_k=3)
    k0 = timed.curves.where("k = 0 and strategy_id = 0").select("total_usd").distinct().collect()
    assert len(k0) == 1 and k0[0][0] == pytest.approx(t.where("strategy_id = 0").agg(F.sum("gross_pnl")).first()[0])
    assert len(timed.json().collect()) == 2


def test_null_is_named_by_its_parts_only(spark):
    b = synthetic.make_bars(spark, 500, seed=1).cache()
    based = T.with_baseline(T.join_bars(synthetic.make_trades(b, 30, seed=1), b), b)
    a = nulls.random_entry_draws(based, b, 20).orderBy("draw").collect()
    assert [x.null_mean for x in a] == pytest.approx([x.null_mean for x in nulls.random_entry_draws(based.repartition(3), b, 20).orderBy("draw").collect()])
    with pytest.raises(ValueError):
        nulls.random_entry_test(based.withColumn("hold", F.lit(500)), b, 5)


def test_scalars(spark):
    d = spark.createDataFrame([("($1,234.50)", "@MNQZ24", "StopATR"), ("12%", "esh25", "SL"), ("x", "@", "fastFAC"), (None, None, None)], "m string, s string, a string")
    got = [tuple(r) for r in d.select(S.money(F.col("m")), S.symbol_root(F.col("s")), S.axis_class(F.col("a"))).collect()]
    assert got[:3] == [(-1234.5, "MNQ", "scale-free"), (12.0, "ES", "price-scaled"), (None, "", "scale-free")]
    assert len(S.COSTS) == 59 or len(S.COSTS) > 50


def test_average_ranks_and_correlation(spark):
    d = spark.createDataFrame([(1, 3.0, 1.0), (1, 3.0, 2.0), (1, 1.0, 3.0), (1, None, 4.0)], "g int, x double, y double")
    assert [r[0] for r in d.orderBy("y").select(M.avg_rank(F.col("x"), ["g"])).collect()].count(2.5) == 2
    r = d.groupBy("g").agg(M.corr0("x", "y").alias("r"), M.corr0(F.lit(1.0), F.col("y")).alias("z")).first()
    assert r.r == pytest.approx(-0.8660254) and r.z == 0.0


def test_cost_table(spark):
    rows = [("@MNQ", 5.74), ("MNQZ26", 5.74), ("mesz26", 4.99), ("@M2K", 7.24), ("ES", 30.0), ("NQ", 35.0), ("@QN", 14.365), ("XYZ", None)]
    got = S.with_round_trip(spark.createDataFrame(rows, "symbol string, want double"))
    assert got.count() == len(rows) and got.where("not reference_cost <=> want").collect() == []
    assert len(S.COSTS) == 79


def test_random_entries_in_groups_and_ranges(spark, monkeypatch):
    """Draws made in groups of trades and ranges of bars are those of the MD5 that names each."""
    from hashlib import md5

    b = synthetic.make_bars(spark, 60, seed=4).select("symbol", "bar_idx", F.when(F.col("bar_idx") % 11 > 0, F.col("open")).otherwise(0.0).alias("open"))
    b = b.where("bar_idx not in (5, 41)").union(spark.createDataFrame([("@ES", 60, 3.0), ("@ES", 61, 4.0)], b.schema))  # as many bars as before, two missing
    rows = [(s, "@ES", "x" * 50 if t == 3 else str(t), 1 - 2 * (t % 2), 1 + t % 3) for s in (1, 23) for t in range(14)]
    based = spark.createDataFrame(rows, "strategy_id long, symbol string, trade_id string, direction int, hold long")
    monkeypatch.setattr(nulls, "RANGE", 16)
    monkeypatch.setattr(nulls, "GROUP", 3)
    got = {(x.strategy_id, x.draw): x.null_mean for x in nulls.random_entry_draws(based, b, 12).collect()}
    opens, want = {x.bar_idx: x.open for x in b.collect()}, {}
    for s, _, t, direction, hold in rows:
        for d in range(12):
            j = min(int(int(md5(f"0|{s}|{d}|{t}".encode()).hexdigest()[:13], 16) / 2**52 * (60 - hold)), 60 - hold - 1)
            if opens.get(j) and j + hold in opens:
                want.setdefault((s, d), []).append(direction * (opens[j + hold] / opens[j] - 1.0))
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in want.items()})
