import math

import pytest
from evidex.operators import components as K
from evidex.operators import grid as G
from evidex.operators import region as R
from evidex.operators import wfc as W
from evidex.plans import grid_battery, views
from evidex.session import cut
from evidex.sources import synthetic
from pyspark.sql import functions as F


def line(spark, n):
    return spark.createDataFrame([("p", i, [float(i)], [i]) for i in range(n)], "project string, combo_id int, params array<double>, pos array<int>")


def surface(spark, values):
    return spark.createDataFrame([("p", 1, i, None if v is None else float(v)) for i, v in enumerate(values)], "project string, window int, combo_id int, x double")


def square(spark, n):
    return spark.createDataFrame([("p", i, [float(i % n), float(i // n)], [i % n, i // n]) for i in range(n * n)], "project string, combo_id int, params array<double>, pos array<int>")


def daily(spark, rows):
    return spark.createDataFrame([("p", c, d, None, float(v)) for c, vs in enumerate(rows) for d, v in enumerate(vs)], "project string, combo_id int, day_idx int, date date, pnl double")


def whole(spark, n, window=1):
    return spark.createDataFrame([("p", window, 0, -1, 0, n - 1, True)], "project string, window int, is_first int, is_last int, oos_first int, oos_last int, complete boolean")


def test_pool_of_a_square(spark):
    s = surface(spark, range(9))
    got = [r.pooled for r in G.pool(s, G.neighbours(square(spark, 3)), "x").orderBy("combo_id").collect()]
    assert got == [2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6]


def test_surface_metrics(spark):
    m = G.surface_metrics(daily(spark, [[10, -30, 5, 40]]), whole(spark, 4)).where("side = 'oos'").first()
    assert (m.net_profit, m.max_dd, m.avg_dd, m.np_over_avgdd) == (25, -30, -13.75, pytest.approx(25 / 13.75))
    flat = G.surface_metrics(daily(spark, [[1, 2]]), whole(spark, 2)).where("side = 'oos'").first()
    assert flat.np_over_avgdd is None


def test_region_ties_and_size(spark):
    t = G.top_k(surface(spark, [1, 5, 5, None, 2, 2, 2, 2, 2, 2]), "x").where("place <= k").orderBy("place").collect()
    assert [r.combo_id for r in t] == [1, 2] and t[0].k == 2
    sizes = spark.range(1, 30).select(G.region_size(F.col("id")).alias("k"), "id").collect()
    assert all(r.k == max(1, round(0.2 * r.id)) for r in sizes)


def test_lift(spark):
    y = [0, 0, 0, 0, 5, 5, 0, 0, 0, 0]
    p = surface(spark, [0, 1, 2, 3, 9, 9, 3, 2, 1, 0]).join(spark.createDataFrame(list(enumerate(map(float, y))), "combo_id int, y double"), "combo_id")
    r = R.region(p, line(spark, 10))
    assert {x.combo_id for x in r.where("in_region").collect()} == {4, 5}
    assert R.lifts(r).first().lift == pytest.approx((5 - 1) / 2)
    assert R.lifts(r.withColumn("y", F.lit(1.0))).first().lift == 0


def test_flips_and_picks_by_hand(spark):
    rows = [[1, 2, 3, 4], [0, 0, 1, 1], [2, -2, 2, -5]]
    b = R.block_sums(daily(spark, rows), whole(spark, 4), 2)
    weights = lambda *w: spark.createDataFrame([("p", 1, i, k, float(v)) for i, ws in enumerate(w) for k, v in enumerate(ws)], "project string, window int, draw int, block int, weight double")
    got = {(r.draw, r.combo_id): r.y for r in R.surface_draws(b, weights((1, 1), (1, -1), (-1, -1))).collect()}
    mean = [sum(c) / 3 for c in zip(*rows, strict=True)]
    for c, row in enumerate(rows):
        dev = [sum(row[0:2]) - sum(mean[0:2]), sum(row[2:4]) - sum(mean[2:4])]
        assert got[0, c] == pytest.approx(sum(row))
        assert got[1, c] == pytest.approx(sum(mean) + dev[0] - dev[1])
        assert got[2, c] == pytest.approx(sum(mean) - sum(dev))
    z = R.surface_draws(R.centred(b), weights((2, 0), (0, 2))).groupBy("combo_id").agg(F.avg("y").alias("y")).collect()
    assert all(r.y == pytest.approx(sum(mean)) for r in z)
    with pytest.raises(ValueError):
        R.block_sums(daily(spark, rows), whole(spark, 4), 0)


@pytest.mark.parametrize("size", [1, 2, 64])
def test_paths_and_surfaces_of_draws_by_hand(spark, size):
    """Three cells over seven days in blocks of three: each draw's path is rebuilt day by day; blocks of cells don't matter."""
    pnl = {0: [5, -2, 0, 1, 1, -9, 4], 1: [0, 0, 0, 0, 0, 0, 0], 2: [1, 2, 3, -4, 0, 6, 2]}
    mean = [sum(pnl[c][k] for c in pnl) / 3 for k in range(7)]
    daily = spark.createDataFrame([("p", c, k + 2, float(x)) for c, xs in pnl.items() for k, x in enumerate(xs)], "project string, combo_id int, day_idx int, pnl double")
    daily = daily.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_idx")))
    windows = spark.createDataFrame([("p", 1, 0, 1, 2, 8)], "project string, window int, is_first int, is_last int, oos_first int, oos_last int")
    signs = {0: [1, 1, 1], 1: [-1, 1, -1], 2: [-1, -1, -1]}
    weights = spark.createDataFrame([("p", 1, d, b, float(w)) for d, ws in signs.items() for b, w in enumerate(ws)], "project string, window int, draw int, block int, weight double")
    want_path, want_np = {}, {}
    for d, ws in signs.items():
        for c, xs in pnl.items():
            eq = top = low = 0.0
            for k, x in enumerate(xs):
                eq += mean[k] + ws[k // 3] * (x - mean[k])
                top = max(top, eq)
                low += eq - top
            want_np[d, c] = eq
            want_path[d, c] = eq / (-low / 7) if low < -1e-12 else None
    got = {(r.draw, r.combo_id): r.y for r in R.path_draws(daily, windows, weights, "NPAvgDD", 3, size).collect()}
    assert got.keys() == want_path.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want_path.items() if v is None or abs(v) < 1e9)
    flat = {(r.draw, r.combo_id): r.y for r in R.path_draws(daily, windows, weights, "NP", 3, size).collect()}
    whole = {(r.draw, r.combo_id): r.y for r in R.surface_draws(R.block_sums(daily, windows, 3), weights, size).collect()}
    assert flat == pytest.approx(want_np) and whole == pytest.approx(want_np)


def test_distinct_patterns_and_reading(spark):
    d = daily(spark, [[1, 2], [1.001, 2.004], [1, 3], [-0.0, 0.0], [0.0, 0.0]])
    assert R.distinct_patterns(d, whole(spark, 2)).first().n_distinct == 3
    cases = [(0.01, 1.0, 1.0, True, "edge"), (0.01, -1.0, 1.0, True, "loser"), (0.2, 1.0, 1.0, True, "plateau"), (0.2, 1.0, -1.0, True, "noise"), (None, 1.0, -1.0, True, "noise"), (0.01, 1.0, 1.0, False, "plateau")]
    c = spark.createDataFrame(cases, "p double, r double, g double, s boolean, want string")
    assert all(x.got == x.want for x in c.select(R.reading(F.col("p"), F.col("r"), F.col("g"), F.col("s")).alias("got"), "want").collect())
    n = spark.createDataFrame([(0.01, 0.2, True), (0.01, 0.02, False), (None, 0.01, True), (None, None, False)], "a double, b double, want boolean")
    assert all(x.got == x.want for x in n.select(R.nulls_disagree(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_correlations_and_bands(spark):
    p = surface(spark, range(20)).withColumn("y", F.col("x") * 2 + 1)
    r = W.correlations(p).first()
    assert (r.spearman, r.pearson, r.insufficient) == (pytest.approx(1), pytest.approx(1), False)
    assert W.correlations(p.withColumn("y", F.lit(3.0))).first().spearman == 0
    b = W.bands(p).orderBy("band").collect()
    assert len(b) == 10 and all(x.n == 2 for x in b) and b[0].is_mean == 18.5
    assert W.bands(p.limit(5)).count() == 0
    assert W.top_n(p).first().median_oos_rank == 3.5
    shape = G.shape(line(spark, 20))
    t = W.torus_draws(p, line(spark, 20), shape)
    assert t.select("draw").distinct().count() == 19 and t.groupBy("draw").agg(F.sum("y").alias("s")).select("s").distinct().count() == 1
    holed = line(spark, 20).where("combo_id <> 7").unionByName(line(spark, 1).withColumn("combo_id", F.lit(50)))
    perm = W.torus_draws(p, holed, G.shape(holed), 5)
    assert perm.select("draw").distinct().count() == 5


def test_plateau(spark):
    picks = spark.createDataFrame([("p", 1, 1)], "project string, window int, pick int")
    p = surface(spark, [2, 2, 2]).withColumn("y", F.when(F.col("combo_id") == 1, 9.0).otherwise(-1.0))
    r = W.plateau(p, picks, line(spark, 3)).first()
    assert r.score_is == 1 and r.positive_share_oos == 0 and r.n_neighbours == 2
    assert r.flat_oos == pytest.approx(max(0, 1 - min(1, math.sqrt(200 / 9) / (7 / 3 + 1e-9))))
    assert W.plateau(p.withColumn("y", F.when(F.col("combo_id") == 1, 1.0)), picks, line(spark, 3)).first().score_oos is None


def test_effective_trials(spark):
    d = lambda rows: daily(spark, rows).withColumn("window", F.lit(1))
    assert W.effective_trials(d([[1, 2, 3, 4], [2, 4, 6, 8], [5, 5, 5, 5]])).first().n_eff == pytest.approx(1)
    assert W.effective_trials(d([[1, -1, 1, -1], [1, 1, -1, -1]])).first().n_eff == pytest.approx(2)


def test_effective_trials_of_many_series(spark):
    """More series than days: the products of days give what the eigenvalues of the correlations do; in tasks of a few series."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 7)) + rng.normal(size=7)
    x[5] = 2.0
    d = daily(spark, x.tolist()).withColumn("window", F.lit(1))
    few = d.where("combo_id < 6").withColumn("window", F.lit(2))
    got = {r.window: r.n_eff for r in W.effective_trials(d.union(few).repartition(6)).collect()}
    for window, rows in ((1, np.delete(x, 5, 0)), (2, x[:5])):
        e = np.linalg.eigvalsh(np.corrcoef(rows))
        assert got[window] == pytest.approx(e.sum() ** 2 / (e**2).sum())


def test_bootstrap_and_reality_check(spark):
    n = spark.createDataFrame([("p", 1, 50)], "project string, window int, n int")
    t = W.bootstrap_days(n, 30)
    assert t.groupBy("draw").agg(F.sum("times").alias("s")).select("s").distinct().collect()[0][0] == 50
    g = synthetic.make_grid(spark, (4, 4), 120, 60, "persistent", signal=60.0, trade_p=1.0, seed=2)
    d = g["grid_daily"].withColumns({"window": F.lit(1), "day": F.col("day_idx")})
    picks = spark.createDataFrame([("demo", 1, 0)], "project string, window int, pick int")
    r = W.reality_check(d, picks, 50).first()
    assert r.p_best < 0.05 < r.p_pick and r.best_index in (5, 6, 9, 10)
    assert W.reality_check(d.where("day < 30"), picks, 5).count() == 0


def test_components_and_members(spark):
    s = surface(spark, [9, 9, 0, 0, 9, 9, 9, 0, 0, 0])
    r = K.ridges(s, line(spark, 10), "x", q=0.5)
    assert sorted(x.combo_id for x in r.collect()) == [4, 5, 6] or sorted(x.combo_id for x in r.collect()) == list(range(10))
    assert K.labels([(0, 0), (1, 1), (3, 3)]).tolist() == [0, 0, 2]
    ramp = surface(spark, range(20)).withColumnRenamed("x", "pooled")
    ridge = K.ridges(ramp, line(spark, 20), "pooled")
    c = K.centres(ramp, ridge, line(spark, 20), "pooled").first()
    assert (c.n_cells, c.is_peak, c.peak) == (4, False, 19) and c.centre in (17, 18)


def test_members_are_spread(spark):
    """Inner cells first, two apart, the best first; a thin ridge takes neighbours; a surface without a ridge has its peak."""
    s = surface(spark, range(20))
    ridge = spark.createDataFrame([("p", 1, i) for i in range(3, 16)], "project string, window int, combo_id int")
    centre = spark.createDataFrame([("p", 1, 9)], "project string, window int, centre int")
    e = K.ensembles(s, ridge, centre, line(spark, 20), "x").first()
    assert (e.members, e.spacing, e.interior) == ([9, 14, 12, 7], 2, True)
    thin = ridge.where("combo_id in (3, 4, 15)")
    e = K.ensembles(s, thin, centre.withColumn("centre", F.lit(4)), line(spark, 20), "x").first()
    assert (e.members, e.spacing, e.interior) == ([4], 1, False)
    e = K.ensembles(s, ridge.where("combo_id < 0"), centre, line(spark, 20), "x").first()
    assert (e.members, e.spacing, e.interior) == ([9], 1, False)


@pytest.mark.parametrize("tile", [1, 9, 4096])
def test_areas_across_tiles(spark, tile):
    """A spiral, a diagonal and single cells: tiles of one cell, of three by three, and one tile give the same areas."""
    rows = ["XXXXXXXXX.X", "........X..", "XXXXXXX.X.X", "X.....X.X..", "X.XXX.X.X.X", "X.X...X.X..", "X.XXXXX.X.X", "X.......X..", "XXXXXXXXX.."]
    on = {(r, c) for r, x in enumerate(rows) for c, v in enumerate(x) if v == "X"}
    ids = {p: k for k, p in enumerate(sorted(on))}
    want = {}
    for p in sorted(on):
        if ids[p] not in want:
            todo = [p]
            while todo:
                q = todo.pop()
                if ids[q] not in want:
                    want[ids[q]] = ids[p]
                    todo += [n for a in (-1, 0, 1) for b in (-1, 0, 1) if (n := (q[0] + a, q[1] + b)) in on]
    cells = spark.createDataFrame([("p", 1, i, list(p)) for p, i in ids.items()] + [("q", 1, 5, [2]), ("q", 1, 6, [3]), ("q", 1, 9, [7])], "project string, window int, combo_id int, pos array<int>")
    got = K.areas(cells, tile_cells=tile).collect()
    assert {r.combo_id: r.root for r in got if r.project == "p"} == want
    assert {r.combo_id: r.root for r in got if r.project == "q"} == {5: 5, 6: 5, 9: 9}


def test_windows(spark):
    days = spark.range(10).select(F.lit("p").alias("project"), F.col("id").cast("int").alias("day_idx"), F.date_add(F.lit("2020-03-25").cast("date"), F.col("id").cast("int")).alias("date"))
    one = G.custom_windows(days, "single").first()
    assert (one.is_first, one.is_last, one.oos_first, one.oos_last) == (0, 4, 5, 9)
    two = G.custom_windows(days, "two").orderBy("window").collect()
    assert [(w.is_first, w.is_last, w.oos_first, w.oos_last) for w in two] == [(0, 2, 3, 5), (3, 5, 6, 9)]
    with pytest.raises(ValueError):
        G.custom_windows(days.limit(5), "single")
    with pytest.raises(ValueError):
        G.custom_windows(days, "three")
    s = spark.createDataFrame([("p", 1, "2020-03-31", "2020-04-10", 1, "Month", False, 3), ("p", 2, "2020-04-01", "2020-04-02", 3, "Day", True, 1), ("p", 3, "2021-01-01", "2021-02-01", 1, "Year", False, 1)], "project string, window int, oos_start string, oos_end string, in_len int, in_type string, anchored boolean, grid_row int")
    w = {r.window: r for r in G.schedule_windows(s.withColumns({"oos_start": F.col("oos_start").cast("date"), "oos_end": F.col("oos_end").cast("date")}), days).collect()}
    assert (w[1].is_first, w[1].is_last, w[1].oos_first, w[1].oos_last, w[1].complete) == (0, 5, 6, 9, False)
    assert (w[2].is_first, w[2].oos_last, w[2].complete, w[2].pick) == (0, 8, True, 0)
    assert w[3].oos_first is None and not w[3].complete


def test_outline_and_profile(spark):
    cells = spark.createDataFrame([("p", 0, 0), ("p", 0, 1)], "project string, r int, c int")
    assert views.outline(cells, ["project"]).count() == 6
    p = surface(spark, range(12)).withColumn("y", -F.col("x"))
    r = views.ranked_profile(p, G.WINDOW).orderBy("place").collect()
    assert r[0].x_pct == 100 and r[0].y_pct == 0 and r[0].rolling == pytest.approx((0 + 100 / 11) / 2)


def test_battery_reads_a_planted_ridge_and_noise(spark):
    g = [synthetic.make_grid(spark, (6, 6), 240, 120, s, signal=40.0, trade_p=1.0, seed=7, project=s) for s in ("persistent", "noise")]
    both = {k: g[0][k].union(g[1][k]).cache() for k in g[0]}
    b = grid_battery.run(both["combos"], both["grid_daily"], both["grid_exits"], both["days"], scheme="single", n_null=99, n_boot=30)
    v = {r.project: r for r in b.verdict.collect()}
    assert v["persistent"].reading == "edge" and v["persistent"].gate == "pass" and v["noise"].reading in ("noise", "plateau")
    base = {r.project: r for r in b.base.collect()}
    assert base["persistent"].confidence == "supported" and base["persistent"].pick_rule == "pooled peak"
    assert base["persistent"].pick in (14, 15, 20, 21)
    assert all("NaN" not in r.json for r in b.json().collect())
    with pytest.raises(ValueError):
        grid_battery.run(both["combos"], both["grid_daily"], both["grid_exits"], both["days"], scheme="x")


def p_values(spark, n_seeds=200, n_null=199, scheme=None, n_days=600, split=300, **options):
    """{seed: (lift, p of the flips, p of the bootstrap)} of planted grids, one job for all seeds."""
    g = synthetic.planted_grids(spark, list(range(n_seeds)), n_days=n_days, split=split, **options)
    daily, combos = cut(g["grid_daily"]), cut(g["combos"])
    w = cut(combos.select("project").distinct().select("project", F.lit(1).alias("window"), F.lit(0).alias("is_first"), F.lit(split - 1).alias("is_last"), F.lit(split).alias("oos_first"), F.lit(n_days - 1).alias("oos_last"), F.lit(True).alias("complete")))
    sides = G.sides(daily, w).groupBy(*G.WINDOW, "combo_id")
    r = cut(R.region(sides.agg(F.sum(F.when(F.col("side") == "is", F.col("pnl"))).alias("x"), F.sum(F.when(F.col("side") == "oos", F.col("pnl"))).alias("y")), combos))
    b = cut(R.block_sums(daily, w))
    lifts, n = R.lifts(r), R.n_blocks(b)
    p = [R.window_p(R.lift_draws(r, x, d), lifts, "null_lift", "lift").select("project", "lift", "p").collect() for x, d in ((b, R.signs(w, n, n_null)), (R.centred(b), R.picks(n, n_null)))]
    boot = {x.project: x.p for x in p[1]}
    return {x.project: (x.lift, x.p, boot[x.project]) for x in p[0]}


@pytest.mark.parametrize(("tail", "most"), [("normal", 0.07), ("jumps", 0.10)])
def test_nulls_keep_their_size(spark, tail, most):
    """Nothing is planted and neighbours share 90 % of their noise: at 5 % the lift passes at most 7 % of 200 grids, the bootstrap 10 %."""
    got = p_values(spark, tail=tail).values()
    assert len(got) == 200
    assert sum(p < 0.05 for _, p, _ in got) <= most * 200 and sum(p < 0.05 for _, _, p in got) <= 0.10 * 200


def test_power_and_decay(spark):
    ridge = p_values(spark, 30, shape=(8, 8), structure="ridge", rho=0.6, trade_p=0.5, n_days=750, split=500).values()
    assert sum(p < 0.05 for _, p, _ in ridge) >= 0.6 * 30
    gone = p_values(spark, 10, shape=(8, 8), structure="decay", trade_p=0.5, n_days=750, split=500).values()
    assert all(p >= 0.05 for _, p, _ in gone) and sum(x for x, _, _ in gone) < 0


def test_planted_noise_is_as_stated(spark):
    for tail in ("normal", "jumps"):
        g = synthetic.planted_grids(spark, [1], tail=tail, trade_p=1.0, n_days=3000)["grid_daily"]
        m, v = g.agg(F.avg("pnl"), F.var_pop("pnl")).first()
        assert abs(m) < 8 and 0.85 < v / 1e4 < 1.15
        a, b, c = (g.where(f"combo_id = {i}").select("day_idx", F.col("pnl").alias(f"p{i}")) for i in (14, 15, 35))
        near, far = a.join(b, "day_idx").join(c, "day_idx").agg(F.corr("p14", "p15"), F.corr("p14", "p35")).first()
        assert near > 0.6 > 0.35 > far
    g = synthetic.demo_grid(spark)
    w = G.schedule_windows(g["schedule"], g["days"]).first()
    assert (w.oos_first, w.oos_last, w.is_last, w.complete) == (1000, 1499, 999, True) and w.is_first == 500 and g["combos"].count() == 240
    assert synthetic.demo_trades(spark)["trades"].count() == 300
