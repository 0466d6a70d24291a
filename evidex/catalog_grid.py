"""Grid-side queries over the driver's tables, each with SQL of its own for the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex import catalog_trades
from evidex.catalog_trades import TRADES, rounded
from evidex.operators import components as K
from evidex.operators import grid as G
from evidex.operators import region as R
from evidex.operators import wfc as W
from evidex.plans import grid_battery, trade_battery, views
from evidex.session import cut, fresh_path
from evidex.sources import grid_text, report, synthetic, tables

#: Draws of the nulls and of the bootstrap, the operators' defaults.
N_NULL, N_BOOT = 999, 500
#: Fewer shifts than the grid has, so that they are drawn.
N_SHIFTS = 40
#: A schedule of three windows, the last of which the data ends in: (window, oos_start, oos_end, in_len, in_type, anchored, grid_row).
SCHEDULE = [(1, "1994-01-01", "1995-06-30", 18, "Month", False, 5), (2, "1995-07-01", "1996-12-31", 18, "Month", False, 40), (3, "1998-07-01", "2000-12-31", 100, "Week", True, 99)]


class Inputs:
    """What the grid queries share; each piece is built once in a query, when it is first asked for."""

    def __init__(self, spark, sf, scheme: str = "two"):
        self.spark, self.sf, self.scheme = spark, sf, scheme

    @cached_property
    def cells(self) -> DataFrame:
        return cut(tables.grid_cells(self.spark, self.sf))

    @cached_property
    def combos(self) -> DataFrame:
        return cut(tables.combos(self.cells))

    @cached_property
    def days(self) -> DataFrame:
        return cut(tables.days(self.cells))

    @cached_property
    def daily(self) -> DataFrame:
        return cut(tables.grid_daily(self.cells, self.combos, self.days))

    @cached_property
    def exits(self) -> DataFrame:
        return tables.grid_exits(self.cells, self.combos)

    @cached_property
    def windows(self) -> DataFrame:
        return cut(G.custom_windows(self.days, self.scheme))

    @cached_property
    def metrics(self) -> DataFrame:
        return G.surface_metrics(self.daily, self.windows)

    @cached_property
    def pairs(self) -> DataFrame:
        return rounded_pairs(G.metric_pairs(self.metrics, "NP"))

    @cached_property
    def region(self) -> DataFrame:
        r = R.region(self.pairs, self.combos)
        return cut(r.withColumns({"x_pooled": F.round("x_pooled", 9), "y_pooled": F.round("y_pooled", 9)}))

    @cached_property
    def blocks(self) -> DataFrame:
        return cut(R.block_sums(self.daily, self.windows))

    @cached_property
    def signs(self) -> DataFrame:
        return R.signs(self.windows, R.n_blocks(self.blocks), N_NULL)

    @cached_property
    def flip(self) -> DataFrame:
        return R.lift_draws(self.region, self.blocks, self.signs)

    @cached_property
    def boot(self) -> DataFrame:
        return R.lift_draws(self.region, R.centred(self.blocks), R.picks(R.n_blocks(self.blocks), N_NULL))

    @cached_property
    def surfaces(self) -> DataFrame:
        return R.surface_draws(self.blocks, self.signs).withColumn("y", F.round("y", 4))

    @cached_property
    def holes(self) -> DataFrame:
        counts = G.exit_counts(self.exits, self.combos, self.windows)
        few = int(self.exits.agg(F.sum("n")).first()[0] * 0.0035)  # leaves holes at any scale
        return rounded_pairs(G.metric_pairs(self.metrics, "NPAvgDD", counts, few))

    @cached_property
    def torus(self) -> DataFrame:
        return W.spearman_draws(self.pairs, W.torus_draws(self.pairs, self.combos, G.shape(self.combos)))

    @cached_property
    def flip_rho(self) -> DataFrame:
        return W.spearman_draws(self.pairs, self.surfaces)

    @cached_property
    def path_rho(self) -> DataFrame:
        """Rank correlations of NPAvgDD surfaces with those of whole paths under sign flips."""
        return W.spearman_draws(rounded_pairs(G.metric_pairs(self.metrics, "NPAvgDD")), R.path_draws(self.daily, self.windows, self.signs).withColumn("y", F.round("y", 6)))

    @cached_property
    def picks(self) -> DataFrame:
        return G.best_pick(self.pairs)

    @cached_property
    def in_sample(self) -> DataFrame:
        d = G.sides(self.daily, self.windows).where("side = 'is'").join(self.windows.select("project", "window", "is_first"), ["project", "window"])
        return d.select("project", "window", "combo_id", (F.col("day_idx") - F.col("is_first")).cast("int").alias("day"), "pnl")

    @cached_property
    def ridge(self) -> DataFrame:
        return cut(K.ridges(self.region, self.combos, "x_pooled"))

    @cached_property
    def centres(self) -> DataFrame:
        return K.centres(self.region, self.ridge, self.combos, "x_pooled")

    @cached_property
    def observed(self) -> DataFrame:
        return R.lifts(self.region).join(self.windows.select("project", "window", "complete"), G.WINDOW)

    @cached_property
    def patterns(self) -> DataFrame:
        return R.distinct_patterns(self.daily, self.windows)

    @cached_property
    def verdict(self) -> DataFrame:
        o = cut(self.observed)
        flip, boot = R.pooled_p(self.flip, o, "null_lift", "lift"), R.pooled_p(self.boot, o, "null_lift", "lift")
        n = self.patterns.groupBy("project").agg(F.percentile("n_distinct", 0.5).alias("n_distinct"))
        m = o.where("complete").groupBy("project").agg(F.avg("region_oos_mean").alias("r"), F.avg("grid_oos_mean").alias("g"), F.first("k").alias("k"))
        d = m.join(flip.select("project", F.col("p").alias("p_lift")), "project").join(boot.select("project", F.col("p").alias("p_boot")), "project").join(n, "project")
        read = R.reading(F.col("p_lift"), F.col("r"), F.col("g"), R.scoreable(F.col("n_distinct"), F.col("k")))
        return rounded(d.select("project", "p_lift", "p_boot", read.alias("reading"), R.gate(read).alias("gate"), R.nulls_disagree(F.col("p_lift"), F.col("p_boot")).alias("disagree")))


def _schedule(i: Inputs) -> DataFrame:
    rows = [("P1", *s) for s in SCHEDULE]
    s = i.spark.createDataFrame(rows, "project string, window int, oos_start string, oos_end string, in_len int, in_type string, anchored boolean, grid_row int")
    s = s.withColumns({"oos_start": F.col("oos_start").cast("date"), "oos_end": F.col("oos_end").cast("date")})
    return G.schedule_windows(s, i.days)


def rounded_pairs(p: DataFrame) -> DataFrame:
    """Surfaces to a millionth, so that order of addition breaks no ties; cut, since several steps read them."""
    return cut(p.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}))


def _percentiles(i: Inputs) -> DataFrame:
    r = i.region
    p = G.best_pick(r).select(*G.WINDOW, F.lit("best_is").alias("rule"), F.col("pick").alias("combo_id")).union(r.where("place = 1").select(*G.WINDOW, F.lit("best_pooled"), "combo_id"))
    return rounded(R.pick_percentiles(r, p))


def _outline(i: Inputs) -> DataFrame:
    cells = i.region.where("in_region").join(i.combos.select("project", "combo_id", "pos"), ["project", "combo_id"]).select(*G.WINDOW, F.col("pos")[1].alias("r"), F.col("pos")[0].alias("c"))
    return rounded(views.outline(cells, G.WINDOW))


def _grid_battery(i: Inputs) -> grid_battery.GridBattery:
    return grid_battery.run(i.combos, i.daily, cut(i.exits), i.days, scheme="two", n_null=N_NULL, n_boot=N_BOOT)


def _report_round_trip(spark, sf) -> DataFrame:
    """Each strategy's trades written as a report and parsed again."""
    t = tables.trades(spark, sf)
    text = report.report_text(t.withColumns({"file": F.col("strategy_id").cast("string"), "interval": F.lit("60 min.")}))
    back, _, bad = report.parse_trades(text)
    report.refuse(bad, report.ReportFormatError)
    return rounded(back.select("file", "trade_id", "direction", "entry_time", "exit_time", "contracts", "gross_pnl", "net_pnl"), 2)


def _report_block_scan(spark, sf) -> DataFrame:
    """Each strategy's trades written as a text file, which is read in blocks and parsed."""
    t = tables.trades(spark, sf)
    folder = fresh_path(spark, "reports")
    report.write_lines(report.report_lines(t.withColumns({"file": F.col("strategy_id").cast("string"), "interval": F.lit("60 min.")})), folder)
    back, _, bad = report.parse_trades(report.read_lines(spark, folder))
    report.refuse(bad, report.ReportFormatError)
    return rounded(back.select(report.written_name(F.col("file")).alias("file"), "trade_id", "direction", "entry_time", "exit_time", "contracts", "gross_pnl", "net_pnl"), 2)


def _grid_block_scan(i: Inputs) -> DataFrame:
    """The whole grid written as an optimisation file, which is read in blocks and parsed: what each combination has."""
    folder = fresh_path(i.spark, "grids")
    grid = {"combos": i.combos, "grid_daily": i.daily, "grid_exits": i.exits}
    grid_text.write_records(synthetic.grid_records(grid, ["A", "B"]), folder)
    got, bad = grid_text.parse_grid(grid_text.read_records(i.spark, folder))
    report.refuse(bad, report.GridFormatError)
    days = got["grid_daily"].groupBy("combo_id").agg(F.count("*").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("pnl").alias("total"), F.sum("closed_pnl").alias("closed_total"))
    exits = got["grid_exits"].groupBy("combo_id").agg(F.sum("n").alias("n_exits"))
    c = got["combos"].select("combo_id", F.col("params")[0].alias("a"), F.col("params")[1].alias("b"), F.col("pos")[0].cast("bigint").alias("pa"), F.col("pos")[1].cast("bigint").alias("pb"))
    return rounded(c.join(days, "combo_id").join(exits, "combo_id", "left"))


def _permutations(i: Inputs) -> DataFrame:
    """The grid without its first cell is not full: its null is drawn by permutation."""
    combos, pairs = i.combos.where("combo_id > 0"), i.pairs.where("combo_id > 0")
    return rounded(W.spearman_draws(pairs, W.torus_draws(pairs, combos, G.shape(combos))))


def _base_setting(i: Inputs) -> DataFrame:
    """The recommended setting; arrays as text."""
    b = K.base_setting(i.daily, i.days, i.windows, i.combos, cut(i.verdict.select("project", "reading")), "two")
    whole = lambda c: F.array_join(F.col(c).cast("array<int>").cast("array<string>"), " ")
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["axis"].cast("string"), r["lo"].cast("int").cast("string"), r["hi"].cast("int").cast("string"))), " ")
    return b.withColumns({"members": whole("members"), "pick_params": whole("pick_params"), "ranges": ranges, "n_basis_days": F.col("n_basis_days").cast("bigint")})


def _cells_of(json: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields of JSON texts: the first column, and for each name the value at a path, as the type given with it."""
    at = lambda spec: F.get_json_object("json", spec.split()[0]).cast(spec.split()[1])
    return json.select(json.columns[0], *(at(spec).alias(name) for name, spec in fields.items()))


def _json_fields(spark, sf) -> DataFrame:
    """What the trade battery's JSON says, for each strategy."""
    fields = {
        "n_long": "$.n_long bigint", "n_short": "$.n_short bigint", "n_bars": "$.n_bars bigint", "first_entry": "$.first_entry timestamp_ntz", "minutes": "$.minutes bigint", "n_checks": "$.checks[8].name string", "p_value": "$.random_entry[0].p_value double", "k_ge": "$.random_entry[0].k_ge bigint", "z": "$.random_entry[0].z double",
        "score": "$.window_score[0].score double", "usd_2": "$.windows[1].usd_sum double", "calm_n": "$.regimes[0].n bigint", "year": "$.yearly[0].year int", "year_usd": "$.yearly[0].usd double", "net_20x": "$.cost_curve[6].net_mean_usd double", "breakeven": "$.cost_summary[0].breakeven_mult double", "max_dd": "$.drawdown[0].max_dd double", "median_dd": "$.drawdown[0].median_dd double", "cdar": "$.drawdown[0].cdar double", "calmar": "$.drawdown[0].calmar double",
    }
    out = _cells_of(trade_battery.run(tables.trades(spark, sf), tables.bars(spark, sf)).json(), fields)
    return rounded(out.withColumn("n_checks", (F.col("n_checks").isNotNull()).cast("int") * 9), 4)


def _timing_fields(spark, sf) -> DataFrame:
    """The curves in the timing JSON."""
    j = trade_battery.run_timing(tables.trades(spark, sf), tables.bars(spark, sf)).json()
    c = F.from_json(F.get_json_object("json", "$.curves"), "array<struct<leg: string, shift: string, k: int, n_alive: bigint, n_skipped: bigint, total_usd: double, mean_pct: double, win_rate: double>>")
    return rounded(j.select("strategy_id", F.explode(c).alias("c")).select("strategy_id", "c.*"))


def _grid_fields(i: Inputs) -> DataFrame:
    """What the grid battery's JSON says of each window, beside what it says of the project."""
    j = _grid_battery(i).json()
    one = {"n_eff_median": "$.n_eff double", "n_distinct_median": "$.n_distinct double", "p_pooled": "$.p_lift double", "p_pooled_boot": "$.p_lift_boot double", "windows_complete": "$.windows_complete bigint", "reading": "$.reading string", "n_iter": "$.meta[0].n_iter bigint", "has_masks": "$.windows[0].mask string"}
    rows = None
    for w in range(2):
        each = {"window": f"$.region[{w}].window int", "k": f"$.region[{w}].k int", "lift": f"$.region[{w}].lift double", "p_lift": f"$.region[{w}].p_lift double", "n_distinct": f"$.region[{w}].n_distinct bigint", "precision": f"$.region[{w}].precision double", "jaccard": f"$.region[{w}].jaccard double"}
        each |= {"p_best": f"$.selection[{w}].p_best double", "p_pick": f"$.selection[{w}].p_pick double", "n_eff": f"$.effective_trials[{w}].n_eff double", "n_dropped": f"$.trades[{w}].n_dropped bigint", "oos_trades": f"$.trades[{w}].oos_trades_median int"}
        d = _cells_of(j, one | each)
        rows = d if rows is None else rows.union(d)
    return rounded(rows.withColumn("has_masks", F.col("has_masks").isNotNull()), 5)


#: Projects of the schedule check; each but the first contradicts its grid in one way.
CONTRADICTIONS = ("none", "names", "iterations", "hole", "pick", "windows", "fitness")


def _schedule_checks(i: Inputs) -> DataFrame:
    """Schedules of seven projects with the same grid, whose picks are drawn from its rows, against that grid."""
    each = lambda d: d.drop("project").withColumn("project", F.explode(F.array(*map(F.lit, CONTRADICTIONS))))
    is_ = lambda k: F.col("project") == k
    combos = each(i.combos).where(~is_("hole") | (F.col("combo_id") > 0))
    n = combos.groupBy("project").agg(F.count("*").alias("n"))
    names = n.select("project", F.array(F.lit("A"), F.lit("B")).alias("names"))
    groups = n.select("project", F.array(F.lit("A"), F.when(is_("names"), "C").otherwise("B")).alias("param_names"), (F.col("n") + is_("iterations").cast("int")).alias("n_iterations"), F.when(is_("fitness"), "Sharpe").otherwise("NP").alias("fitness_abbr"))
    picks = each(i.combos).where(F.col("combo_id") % 30 == 7).where(~is_("windows"))
    off = F.transform("params", lambda x: x + F.when(is_("pick") & (F.col("combo_id") == 37), 0.5).otherwise(0.0))
    schedule = picks.select("project", F.col("combo_id").alias("window"), (F.col("combo_id") + 1).alias("grid_row"), off.alias("params"))
    return grid_battery.validate(combos, names, groups, schedule)


def queries() -> dict:
    bigint = lambda w, *more: w.select("window", *(F.col(x).cast("bigint").alias(x) for x in ("is_first", "is_last", "oos_first", "oos_last")), *more)
    grid = {
        "grid_axes": lambda i: G.shape(i.combos),
        "grid_positions": lambda i: G.axes(i.combos.drop("pos")).select("combo_id", F.col("pos")[0].alias("a"), F.col("pos")[1].alias("b")),
        "wf_windows": _schedule,
        "custom_windows": lambda i: bigint(i.windows, "is_first_date", "oos_last_date", "complete"),
        "surface_metrics": lambda i: rounded(i.metrics, 6),
        "exit_counts": lambda i: G.exit_counts(i.exits, i.combos, i.windows),
        "min_trade_holes": lambda i: rounded(i.holes.select("project", "window", "combo_id", "x", "y"), 3),
        "neighbourhood_pool": lambda i: rounded(i.region.select("window", "combo_id", "x_pooled", "y_pooled"), 9),
        "region_topk": lambda i: i.region.where("in_region").select("window", "combo_id", "place", "k"),
        "region_lift": lambda i: rounded(R.lifts(i.region)),
        "overlap_precision": lambda i: rounded(R.precision(i.region, i.patterns)),
        "distinct_patterns": lambda i: i.patterns,
        "signflip_null": lambda i: rounded(i.flip),
        "block_bootstrap_null": lambda i: rounded(i.boot),
        "precision_null": lambda i: rounded(R.precision_draws(i.region, i.surfaces, i.combos)),
        "pvalues_window": lambda i: rounded(R.window_p(i.flip, R.lifts(i.region), "null_lift", "lift")),
        "pvalues_pooled": lambda i: rounded(R.pooled_p(i.flip, i.observed, "null_lift", "lift")),
        "verdict_matrix": lambda i: i.verdict,
        "pick_percentiles": _percentiles,
        "spearman_wfc": lambda i: rounded(W.correlations(i.pairs), 9),
        "wfc_npavgdd_holes": lambda i: rounded(W.correlations(i.holes), 9),
        "torus_null": lambda i: rounded(i.torus),
        "torus_random_null": lambda i: rounded(W.spearman_draws(i.pairs, W.torus_draws(i.pairs, i.combos, G.shape(i.combos), N_SHIFTS))),
        "permutation_null": _permutations,
        "wfc_signflip_null": lambda i: rounded(i.flip_rho),
        "wfc_path_null": lambda i: rounded(i.path_rho),
        "wfc_test": lambda i: rounded(W.correlation_test(W.correlations(i.pairs), i.torus), 9),
        "wfc_pooled": lambda i: rounded(W.pooled_test(W.correlations(i.pairs), cut(i.flip_rho), i.windows)),
        "wfc_bands": lambda i: rounded(W.bands(i.pairs), 9),
        "top_n_follow": lambda i: rounded(W.top_n(i.pairs)),
        "plateau_score": lambda i: rounded(W.plateau(i.pairs, i.picks, i.combos)),
        "pooled_plateau": lambda i: rounded(W.pooled_plateau(W.plateau(i.pairs, i.picks, i.combos), i.windows)),
        "plateau_bars_view": lambda i: rounded(views.plateau_bars(i.pairs, i.picks, i.combos), 3),
        "slice_view": lambda i: views.slice_through(i.combos, i.combos.select("project", F.lit(7).alias("combo_id")).distinct()),
        "trade_medians": lambda i: G.trade_medians(G.exit_counts(i.exits, i.combos, i.windows)),
        "run_facts": lambda i: grid_battery.run_facts(i.combos, i.days, i.windows).withColumn("shape", F.concat_ws("x", "shape")),
        "effective_trials": lambda i: rounded(W.effective_trials(i.in_sample.withColumnRenamed("day", "day_idx"))),
        "stationary_bootstrap": lambda i: W.bootstrap_days(i.in_sample.groupBy("project", "window").agg(F.count_distinct("day").cast("int").alias("n")), N_BOOT),
        "reality_check": lambda i: rounded(W.reality_check(cut(i.in_sample), i.picks, N_BOOT)),
        "ridge_component": lambda i: i.ridge,
        "ridge_overlap": lambda i: rounded(R.ridge_overlap(i.region, i.ridge, K.ridges(i.region, i.combos, "y_pooled"), i.combos)),
        "medoid_centre": lambda i: i.centres,
        "ensemble": lambda i: K.ensembles(i.region, i.ridge, i.centres, i.combos, "x_pooled").withColumn("members", F.array_join(F.col("members").cast("array<string>"), " ")),
        "base_setting": _base_setting,
        "ols_line_view": lambda i: rounded(views.ols_line(i.pairs, G.WINDOW, "x", "y")),
        "rolling_view": lambda i: rounded(views.ranked_profile(i.pairs, G.WINDOW)),
        "outline_view": _outline,
        "grid_json": lambda i: _grid_battery(i).json(),
        "grid_block_scan": _grid_block_scan,
        "schedule_checks": _schedule_checks,
        "grid_json_fields": _grid_fields,
    }

    def query(f):
        return lambda spark, sf: f(Inputs(spark, sf))

    out = {name: query(f) for name, f in grid.items()}
    out["custom_windows_single"] = lambda spark, sf: bigint(Inputs(spark, sf, "single").windows, "complete")
    out["json_export"] = lambda spark, sf: trade_battery.run(tables.trades(spark, sf), tables.bars(spark, sf)).json()
    out["timing_json"] = lambda spark, sf: trade_battery.run_timing(tables.trades(spark, sf), tables.bars(spark, sf)).json()
    out["json_export_fields"] = _json_fields
    out["timing_json_fields"] = _timing_fields
    out["report_round_trip"] = _report_round_trip
    out["report_block_scan"] = _report_block_scan
    return out


CELLS = """ln AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS a, CAST(round(l_tax * 100) AS INTEGER) AS b, CAST(l_shipdate AS DATE) AS date,
  (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 2 * (l_linenumber % 2) - 1 END) * l_extendedprice * (1 - l_discount) / 100 AS pnl FROM lineitem),
cb AS (SELECT CAST(row_number() OVER (ORDER BY b, a) - 1 AS INTEGER) AS combo_id, a, b, CAST(dense_rank() OVER (ORDER BY a) - 1 AS INTEGER) AS pa, CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS pb FROM (SELECT DISTINCT a, b FROM ln)),
dy AS (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx, date FROM (SELECT DISTINCT date FROM ln)),
gd AS (SELECT combo_id, day_idx, dy.date, coalesce(s.pnl, 0) AS pnl FROM cb CROSS JOIN dy LEFT JOIN (SELECT a, b, date, round(sum(pnl), 6) AS pnl FROM ln GROUP BY 1, 2, 3) s ON s.a = cb.a AND s.b = cb.b AND s.date = dy.date),
nd AS (SELECT count(*) AS n FROM dy)"""
TWO = (
    CELLS
    + """, wn AS (SELECT w::INTEGER AS "window", (n * (w - 1)) // 3 AS is_first, (n * w) // 3 - 1 AS is_last, (n * w) // 3 AS oos_first, (n * (w + 1)) // 3 - 1 AS oos_last FROM nd CROSS JOIN (SELECT unnest([1, 2]) AS w)),
sd AS (SELECT "window", 'is' AS side, is_first AS lo, is_last AS hi FROM wn UNION ALL SELECT "window", 'oos', oos_first, oos_last FROM wn),
ds AS (SELECT sd."window", side, lo, gd.* FROM gd JOIN sd ON day_idx BETWEEN lo AND hi)"""
)
SURF = (
    TWO
    + """, q1 AS (SELECT *, sum(pnl) OVER (PARTITION BY "window", side, combo_id ORDER BY day_idx ROWS UNBOUNDED PRECEDING) AS eq FROM ds),
q2 AS (SELECT *, eq - greatest(0, max(eq) OVER (PARTITION BY "window", side, combo_id ORDER BY day_idx ROWS UNBOUNDED PRECEDING)) AS dd FROM q1),
sm AS (SELECT "window", side, combo_id, sum(pnl) AS net_profit, min(dd) AS max_dd, avg(dd) AS avg_dd, count(*) AS n_days FROM q2 GROUP BY 1, 2, 3)"""
)
PAIRS = TWO + """, pr AS (SELECT "window", combo_id, round(sum(CASE WHEN side = 'is' THEN pnl END), 6) AS x, round(sum(CASE WHEN side = 'oos' THEN pnl END), 6) AS y FROM ds GROUP BY 1, 2)"""
NEAR = ", nb AS (SELECT c.combo_id, n.combo_id AS near FROM cb c JOIN cb n ON abs(c.pa - n.pa) <= 1 AND abs(c.pb - n.pb) <= 1)"
REGION = (
    PAIRS
    + NEAR
    + """, pp AS (SELECT p."window", nb.combo_id, round(avg(p.x), 9) AS x_pooled, round(avg(p.y), 9) AS y_pooled FROM nb JOIN pr p ON p.combo_id = nb.near GROUP BY 1, 2),
rg AS (SELECT pr.*, x_pooled, y_pooled, row_number() OVER (PARTITION BY pr."window" ORDER BY x_pooled DESC, pr.combo_id) AS place, greatest(1, CAST(round_even(count(*) OVER (PARTITION BY pr."window") * 0.2, 0) AS INTEGER)) AS k FROM pr JOIN pp ON pp."window" = pr."window" AND pp.combo_id = pr.combo_id),
lf AS (SELECT "window", min(k) AS k, avg(CASE WHEN place <= k THEN y END) AS rm, avg(y) AS gm, stddev_pop(y) AS sd, avg((y > 0)::INT) AS ps FROM rg GROUP BY 1), li AS (SELECT *, coalesce((rm - gm) / nullif(sd, 0), 0) AS lift FROM lf)"""
)
BLOCKS = """, bk AS (SELECT "window", combo_id, (day_idx - lo) // 21 AS block, sum(pnl - m) AS dev, count(*) AS days, sum(m) AS common FROM (SELECT *, avg(pnl) OVER (PARTITION BY "window", day_idx) AS m FROM ds WHERE side = 'oos') GROUP BY 1, 2, 3),
nk AS (SELECT "window", max(block) + 1 AS nb FROM bk GROUP BY 1)"""
_u = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
FLIPS = f""", fw AS (SELECT "window", draw, block, CASE WHEN {_u.format("'0|flip|P1|' || \"window\" || '|' || draw || '|' || block")} < 0.5 THEN -1.0 ELSE 1.0 END AS weight FROM nk CROSS JOIN (SELECT unnest(range(0, {N_NULL})) AS draw) CROSS JOIN LATERAL (SELECT unnest(range(0, nb)) AS block))"""
BOOTS = f""", bw AS (SELECT "window", draw, block, count(*)::DOUBLE AS weight FROM (SELECT "window", draw, least(CAST(floor({_u.format("'0|boot|P1|' || \"window\" || '|' || draw || '|' || tt")} * nb) AS BIGINT), nb - 1) AS block FROM nk CROSS JOIN (SELECT unnest(range(0, {N_NULL})) AS draw) CROSS JOIN LATERAL (SELECT unnest(range(0, nb)) AS tt)) GROUP BY 1, 2, 3),
ck AS (SELECT "window", combo_id, block, dev - sum(dev) OVER (PARTITION BY "window", combo_id) / sum(days) OVER (PARTITION BY "window", combo_id) * days AS dev FROM bk)"""


def _draws(weights: str, blocks: str, name: str) -> str:
    return f""", {name} AS (SELECT w."window", w.draw, sum(w.weight * d.d) / nullif(min(li.sd), 0) AS null_lift FROM {weights} w JOIN (SELECT b."window", block, avg(dev) AS d FROM {blocks} b JOIN rg ON rg."window" = b."window" AND rg.combo_id = b.combo_id AND place <= k GROUP BY 1, 2) d ON d."window" = w."window" AND d.block = w.block JOIN li ON li."window" = w."window" GROUP BY 1, 2)"""


FLIP = REGION + BLOCKS + FLIPS + _draws("fw", "bk", "fd")
BOOT = FLIP + BOOTS + _draws("bw", "ck", "bd")
SURFACES = """, su AS (SELECT b."window", f.draw, b.combo_id, round(min(t.c) + sum(f.weight * dev), 4) AS y FROM bk b JOIN fw f ON f."window" = b."window" AND f.block = b.block JOIN (SELECT "window", combo_id, sum(common) AS c FROM bk GROUP BY 1, 2) t ON t."window" = b."window" AND t.combo_id = b.combo_id GROUP BY 1, 2, 3)"""

#: As SURFACES, for NPAvgDD: a draw's path of a cell is folded with (sum, peak, sum of drawdowns).
PATHS = """, pa AS (SELECT "window", combo_id, list({'b': (day_idx - lo) // 21 + 1, 'm': m, 'd': pnl - m} ORDER BY day_idx) AS days FROM (SELECT *, avg(pnl) OVER (PARTITION BY "window", day_idx) AS m FROM ds WHERE side = 'oos') GROUP BY 1, 2),
fl AS (SELECT "window", draw, list(weight ORDER BY block) AS w FROM fw GROUP BY 1, 2),
pt AS (SELECT f."window", draw, combo_id, len(days) AS n, list_reduce(list_transform(days, lambda x: {'s': x.m + w[x.b] * x.d, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE}),
  lambda a, x: {'s': a.s + x.s, 'p': greatest(a.p, a.s + x.s), 'q': a.q + least(a.s + x.s - a.p, 0.0::DOUBLE)}, {'s': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE}) AS e FROM fl f JOIN pa p ON p."window" = f."window"),
su AS (SELECT "window", draw, combo_id, CASE WHEN e.q < 0 THEN round(e.s / (-e.q / n), 6) END AS y FROM pt)"""
AVGDD = """, pr AS (SELECT "window", combo_id, round(max(CASE WHEN side = 'is' AND avg_dd < 0 THEN net_profit / -avg_dd END), 6) AS x, round(max(CASE WHEN side = 'oos' AND avg_dd < 0 THEN net_profit / -avg_dd END), 6) AS y FROM sm GROUP BY 1, 2)"""


def _ranks(table: str, keys: str, *cols: str) -> str:
    each = ", ".join(f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0 AS r{c}" for c in cols)
    return f"SELECT *, {each} FROM {table}"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) < 3 OR min({x}) = max({x}) OR min({y}) = max({y}) THEN 0 ELSE coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0) END"


CORR = f""", co AS (SELECT "window", count(*) AS n_points, {_corr("rx", "ry")} AS spearman, {_corr("x", "y")} AS pearson, sum((x > 0)::INT)::BIGINT AS n_pos_is, coalesce(avg(CASE WHEN x > 0 THEN (y > 0)::INT END), 0) AS pos_oos_frac FROM ({_ranks("vp", '"window"', "x", "y")}) GROUP BY 1)"""
VALID = ", vp AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)"
TORUS = f""", sh AS (SELECT s, s % (SELECT max(pa) + 1 FROM cb) AS sa, s // (SELECT max(pa) + 1 FROM cb) AS sb FROM (SELECT unnest(range(1, (SELECT count(*) FROM cb))) AS s)),
ty AS (SELECT p."window", s AS draw, c.combo_id, p.y FROM sh CROSS JOIN cb c JOIN cb f ON f.pa = (c.pa + sa) % (SELECT max(pa) + 1 FROM cb) AND f.pb = (c.pb + sb) % (SELECT max(pb) + 1 FROM cb) JOIN pr p ON p.combo_id = f.combo_id),
tj AS (SELECT ty."window", draw, ty.combo_id, pr.x, ty.y FROM ty JOIN pr ON pr."window" = ty."window" AND pr.combo_id = ty.combo_id), tn AS (SELECT "window", draw, {_corr("rx", "ry")} AS null_rho FROM ({_ranks("tj", '"window", draw', "x", "y")}) GROUP BY 1, 2)"""
SHIFTS = TORUS.replace("s % (SELECT max(pa) + 1 FROM cb) AS sa, s // (SELECT max(pa) + 1 FROM cb) AS sb FROM (SELECT unnest(range(1, (SELECT count(*) FROM cb))) AS s)", "code % (SELECT max(pa) + 1 FROM cb) AS sa, code // (SELECT max(pa) + 1 FROM cb) AS sb FROM (SELECT s, 1 + CAST(floor(" + _u.format("'0|torus|P1|' || s") + f" * (SELECT count(*) - 1 FROM cb)) AS BIGINT) AS code FROM (SELECT unnest(range(1, {N_SHIFTS + 1})) AS s))")
PERMUTED = f""", ph AS (SELECT s AS draw, combo_id, row_number() OVER (PARTITION BY s ORDER BY {_u.format("'0|permute|P1|' || s || '|' || combo_id")}) AS place, row_number() OVER (PARTITION BY s ORDER BY combo_id) AS from_place FROM cb CROSS JOIN (SELECT unnest(range(1, 1000)) AS s) WHERE combo_id > 0),
tj AS (SELECT x."window", a.draw, a.combo_id, x.x, y.y FROM ph a JOIN ph b ON b.draw = a.draw AND b.from_place = a.place JOIN pr x ON x.combo_id = a.combo_id JOIN pr y ON y."window" = x."window" AND y.combo_id = b.combo_id), tn AS (SELECT "window", draw, {_corr("rx", "ry")} AS null_rho FROM ({_ranks("tj", '"window", draw', "x", "y")}) GROUP BY 1, 2)"""
RHO = f""", sj AS (SELECT su."window", draw, su.combo_id, pr.x, su.y FROM su JOIN pr ON pr."window" = su."window" AND pr.combo_id = su.combo_id), sn AS (SELECT "window", draw, {_corr("rx", "ry")} AS null_rho FROM ({_ranks("sj", '"window", draw', "x", "y")}) GROUP BY 1, 2)"""
HOLES = (
    SURF
    + """, nx AS (SELECT sd."window", side, cb.combo_id, count(ln.a) AS n FROM sd CROSS JOIN cb LEFT JOIN ln ON ln.a = cb.a AND ln.b = cb.b AND ln.date BETWEEN (SELECT date FROM dy WHERE day_idx = lo) AND (SELECT date FROM dy WHERE day_idx = hi) GROUP BY 1, 2, 3),
fw_ AS (SELECT CAST(floor(count(*) * 0.0035) AS BIGINT) AS least_n FROM ln), kp AS (SELECT "window", combo_id, min(n) >= (SELECT least_n FROM fw_) AS keep FROM nx GROUP BY 1, 2),
pr AS (SELECT s."window", s.combo_id, round(max(CASE WHEN keep AND side = 'is' AND avg_dd < 0 THEN net_profit / -avg_dd END), 6) AS x, round(max(CASE WHEN keep AND side = 'oos' AND avg_dd < 0 THEN net_profit / -avg_dd END), 6) AS y FROM sm s JOIN kp ON kp."window" = s."window" AND kp.combo_id = s.combo_id GROUP BY 1, 2)"""
)
PICK = """, pk AS (SELECT "window", first(combo_id ORDER BY x DESC, combo_id) AS pick FROM pr GROUP BY 1)"""
PLAT = ", ".join(
    f"""CASE WHEN count({v}) >= 2 THEN 0.5 * (CASE WHEN avg({v}) > 0 THEN greatest(0, 1 - least(1, stddev_pop({v}) / (abs(avg({v})) + 1e-9))) ELSE 0 END) + 0.5 * coalesce(avg(CASE WHEN near <> pick AND {v} IS NOT NULL THEN ({v} > 0)::INT END), 0) END AS s_{v}"""
    for v in ("x", "y")
)
DAYS = f""", bs AS (SELECT "window", n, draw, t, {_u.format("'0|restart|P1|' || \"window\" || '|' || draw || '|' || t")} AS u1, {_u.format("'0|start|P1|' || \"window\" || '|' || draw || '|' || t")} AS u2 FROM (SELECT "window", hi - lo + 1 AS n FROM sd WHERE side = 'is') CROSS JOIN (SELECT unnest(range(0, {{n}})) AS draw) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS t)),
bl AS (SELECT *, max(CASE WHEN u1 < 0.05 OR t = 0 THEN t END) OVER (PARTITION BY "window", draw ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0 FROM bs),
bt AS (SELECT a."window", a.draw, CAST((least(CAST(floor(s.u2 * s.n) AS BIGINT), s.n - 1) + a.t - a.t0) % a.n AS INTEGER) AS day, a.n::INTEGER AS n FROM bl a JOIN bs s ON s."window" = a."window" AND s.draw = a.draw AND s.t = a.t0)"""
def _ridge(value: str, k: str = "") -> str:
    """The largest connected area of a surface's top fifth, as table rdg + k."""
    return f""", ed{k} AS (SELECT "window", quantile_cont({value}, 0.8) AS e FROM rg GROUP BY 1), tp{k} AS (SELECT rg."window", rg.combo_id, x_pooled, pa, pb FROM rg JOIN ed{k} ed ON ed."window" = rg."window" JOIN cb ON cb.combo_id = rg.combo_id WHERE {value} >= e),
rc{k}(w, a, z) AS (SELECT "window", combo_id, combo_id FROM tp{k} UNION SELECT rc.w, rc.a, n.combo_id FROM rc{k} rc JOIN tp{k} m ON m."window" = rc.w AND m.combo_id = rc.z JOIN tp{k} n ON n."window" = rc.w AND abs(n.pa - m.pa) <= 1 AND abs(n.pb - m.pb) <= 1),
lb{k} AS (SELECT w, a, min(z) AS root FROM rc{k} GROUP BY 1, 2), sz{k} AS (SELECT w, root, count(*) AS n, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, root) AS r FROM lb{k} GROUP BY 1, 2), rdg{k} AS (SELECT lb.w AS "window", lb.a AS combo_id FROM lb{k} lb JOIN sz{k} sz ON sz.w = lb.w AND sz.root = lb.root AND r = 1)"""


COMP = REGION + _ridge("x_pooled")

#: The centre of each ridge, as table ct.
MEDOID = """, m AS (SELECT rdg."window", avg(pa) AS ma, avg(pb) AS mb, count(*) AS n FROM rdg JOIN cb USING (combo_id) GROUP BY 1),
d AS (SELECT rdg."window", rdg.combo_id, round_even(sqrt(pow(pa - ma, 2) + pow(pb - mb, 2)), 9) AS dist, x_pooled FROM rdg JOIN cb USING (combo_id) JOIN m ON m."window" = rdg."window" JOIN rg ON rg."window" = rdg."window" AND rg.combo_id = rdg.combo_id), k1 AS (SELECT "window", first(combo_id ORDER BY dist, x_pooled DESC, combo_id) AS medoid FROM d GROUP BY 1),
ct AS (SELECT m."window", n AS n_cells, CASE WHEN n < 3 THEN p.combo_id ELSE medoid END AS centre, n < 3 AS is_peak, p.combo_id AS peak FROM m JOIN k1 ON k1."window" = m."window" JOIN rg p ON p."window" = m."window" AND p.place = 1)"""
#: Members spread over each ridge, chosen one a step, as table es.
SPREAD = """, cl AS (SELECT r."window", r.combo_id, any_value(c.pa) AS pa, any_value(c.pb) AS pb, any_value(g.x_pooled) AS v, bool_and(x.combo_id IS NOT NULL) AS inner_ FROM rdg r JOIN cb c ON c.combo_id = r.combo_id JOIN rg g ON g."window" = r."window" AND g.combo_id = r.combo_id JOIN nb ON nb.combo_id = r.combo_id LEFT JOIN rdg x ON x."window" = r."window" AND x.combo_id = nb.near GROUP BY 1, 2),
fc AS (SELECT "window", greatest(1, least(4, count(*) // 3)) AS most, CASE WHEN bool_or(inner_) THEN 2 ELSE 1 END AS gap, bool_or(inner_) AS interior FROM cl GROUP BY 1),
gr(w, ms) AS (SELECT ct."window", [{'i': combo_id, 'a': pa, 'b': pb}] FROM ct JOIN cb ON cb.combo_id = ct.centre UNION ALL
  SELECT w, list_append(ms, best) FROM (SELECT gr.w, any_value(gr.ms) AS ms, first({'i': cl.combo_id, 'a': cl.pa, 'b': cl.pb} ORDER BY inner_ DESC, v DESC, cl.combo_id) AS best FROM gr JOIN fc ON fc."window" = gr.w JOIN cl ON cl."window" = gr.w WHERE len(ms) < most AND len(list_filter(ms, lambda m: greatest(abs(m.a - cl.pa), abs(m.b - cl.pb)) < gap)) = 0 GROUP BY gr.w)),
es AS (SELECT w AS "window", arg_max(ms, len(ms)) AS ms FROM gr GROUP BY 1)"""
#: The surface of the last window's days, both sides, with its neighbourhood means, as table rg.
BASIS_REGION = (
    TWO
    + NEAR
    + """, bd AS (SELECT dy.* FROM dy JOIN wn ON day_idx BETWEEN is_first AND is_last OR day_idx BETWEEN oos_first AND oos_last WHERE wn."window" = (SELECT max("window") FROM wn)),
bx AS (SELECT combo_id, sum(pnl) AS x FROM gd JOIN bd USING (day_idx) GROUP BY 1), rg AS (SELECT 1 AS "window", b.combo_id, b.x, p.x_pooled, row_number() OVER (ORDER BY x_pooled DESC, b.combo_id) AS place FROM bx b JOIN (SELECT nb.combo_id, avg(x) AS x_pooled FROM nb JOIN bx ON bx.combo_id = nb.near GROUP BY 1) p ON p.combo_id = b.combo_id)"""
)


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round(({c.split(' AS ')[0]})::DOUBLE, {digits}) AS {c.split(' AS ')[-1]}" for c in cols)


def oracle_sql() -> dict[str, str]:
    """SQL by query; that of the JSON texts' fields is put together from the SQL of what they hold."""
    own, t = _oracle_sql(), catalog_trades.oracle_sql()
    of = lambda name, sql: f"({sql[name]}) AS {name}_"
    own["json_export_fields"] = f"""SELECT strategy_id, m.* EXCLUDE (strategy_id), 9 AS n_checks, round(p_value, 4) AS p_value, k_ge, round(z, 4) AS z, round(score, 4) AS score, round(w.usd_sum, 4) AS usd_2, c.n AS calm_n, y.year, round(y.usd, 4) AS year_usd, round(x.net_mean_usd, 4) AS net_20x, round(s.breakeven_mult, 4) AS breakeven, max_dd, median_dd, cdar, calmar
FROM (WITH {TRADES} SELECT strategy_id, sum((direction > 0)::INT)::BIGINT AS n_long, sum((direction < 0)::INT)::BIGINT AS n_short, (SELECT count(*) FROM bars) AS n_bars, min(entry_time) AS first_entry, 60::BIGINT AS minutes FROM t GROUP BY 1) m
JOIN ({t['random_entry_null']}) USING (strategy_id) JOIN ({t['temporal_score']}) USING (strategy_id) JOIN ({t['temporal_windows']}) w USING (strategy_id) JOIN ({t['crisis_split']}) c USING (strategy_id) JOIN ({t['yearly_pnl']}) y USING (strategy_id) JOIN ({t['cost_curve']}) x USING (strategy_id) JOIN ({t['cost_summary']}) s USING (strategy_id) JOIN ({t['cdar_capital']}) USING (strategy_id)
WHERE w."window" = 2 AND NOT c.crisis AND x.mult = 20 AND y.year = (SELECT min(year) FROM ({t['yearly_pnl']}) q WHERE q.strategy_id = m.strategy_id)"""
    curves = [("entry", "later", "delay_entry_fixed_exit"), ("entry", "earlier", "delay_entry_early"), ("exit", "later", "delay_exit"), ("exit", "earlier", "delay_exit_early")]
    own["timing_json_fields"] = " UNION ALL ".join(f"SELECT strategy_id, '{leg}' AS leg, '{shift}' AS shift, k, n_alive, n_skipped, {_r('total_usd', 'mean_pct', 'win_rate')} FROM ({t[name]})" for leg, shift, name in curves)
    own["grid_json_fields"] = f"""SELECT 'P1' AS project, round((SELECT quantile_cont(n_eff, 0.5) FROM {of('effective_trials', own)}), 5) AS n_eff_median, (SELECT quantile_cont(n_distinct, 0.5) FROM {of('distinct_patterns', own)}) AS n_distinct_median, round(v.p_lift, 5) AS p_pooled, round(v.p_boot, 5) AS p_pooled_boot, 2::BIGINT AS windows_complete, v.reading, (SELECT count(*) FROM {of('grid_positions', own)}) AS n_iter, false AS has_masks,
l."window", k::INTEGER AS k, round(l.lift, 5) AS lift, round(p.p, 5) AS p_lift, d.n_distinct, round(o.precision, 5) AS precision, round(r.jaccard, 5) AS jaccard, round(s.p_best, 5) AS p_best, round(s.p_pick, 5) AS p_pick, round(e.n_eff, 5) AS n_eff, m.n_dropped, m.oos_trades_median AS oos_trades
FROM ({own['region_lift']}) l JOIN ({own['pvalues_window']}) p USING ("window") JOIN ({own['distinct_patterns']}) d USING ("window") JOIN ({own['overlap_precision']}) o USING ("window") JOIN ({own['ridge_overlap']}) r USING ("window") JOIN ({own['reality_check']}) s USING ("window") JOIN ({own['effective_trials']}) e USING ("window") JOIN ({own['trade_medians']}) m USING ("window") CROSS JOIN ({own['verdict_matrix']}) v"""
    return own


def _oracle_sql() -> dict[str, str]:
    lift_cols = _r("rm AS region_oos_mean", "gm AS grid_oos_mean", "sd AS oos_sd", "ps AS oos_positive_share", "lift")
    pcol = lambda null, stat: f"(1.0 + sum(({null} >= {stat})::INT)) / (1.0 + count(*))"
    pooled = lambda d: f"""(SELECT (1.0 + sum((v >= l)::INT)) / (1.0 + count(*)) FROM (SELECT draw, avg(null_lift) AS v FROM {d} GROUP BY 1) CROSS JOIN (SELECT avg(lift) AS l FROM li))"""
    sched = "(VALUES " + ", ".join(f"({w}, DATE '{a}', DATE '{b}', {n}, '{t}', {str(z).lower()}, {r})" for w, a, b, n, t, z, r in SCHEDULE) + ') s("window", oos_start, oos_end, in_len, in_type, anchored, grid_row)'
    corr_cols = f'n_points, {_r("spearman", "pearson", digits=9)}, n_pos_is, {_r("pos_oos_frac", digits=9)}, n_points < 8 OR n_pos_is < 4 AS insufficient'
    back = f"WITH {TRADES} SELECT strategy_id::VARCHAR AS file, trade_id, direction, entry_time, exit_time, contracts::INTEGER AS contracts, gross_pnl, round(gross_pnl - 2 * (2.2 + 0.5::DOUBLE), 2) AS net_pnl FROM t"
    checks = "(VALUES " + ", ".join(f"('{n}', '{s}', '{k}')" for n, s, k in (("param_names_match", "error", "names"), ("iteration_count", "error", "iterations"), ("full_grid", "warn", "hole"), ("picks_on_grid", "error", "pick"), ("windows_present", "error", "windows"), ("fitness_supported", "warn", "fitness"))) + ") c(name, severity, broken_by)"
    verdict = f"""WITH {BOOT}, dp AS (SELECT "window", count(DISTINCT s) AS nd FROM (SELECT "window", combo_id, list(round_even(pnl, 2) ORDER BY day_idx) AS s FROM ds WHERE side = 'oos' GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT {pooled("fd")} AS p1, {pooled("bd")} AS p2, (SELECT avg(rm) FROM li) AS r, (SELECT avg(gm) FROM li) AS g, (SELECT quantile_cont(nd, 0.5) FROM dp) >= 2 * (SELECT min(k) FROM li) AS sc),
w AS (SELECT *, CASE WHEN NOT sc THEN 'plateau' WHEN p1 < 0.05 AND r > 0 THEN 'edge' WHEN p1 < 0.05 THEN 'loser' WHEN g > 0 THEN 'plateau' ELSE 'noise' END AS reading FROM v)
SELECT 'P1' AS project, {_r("p1 AS p_lift", "p2 AS p_boot")}, reading, CASE reading WHEN 'edge' THEN 'pass' WHEN 'plateau' THEN 'plateau' ELSE 'fail' END AS gate, (p1 < 0.05) <> (p2 < 0.05) AS disagree FROM w"""
    return {
        "report_block_scan": back,
        "grid_block_scan": f"""WITH {CELLS}, dt AS (SELECT combo_id, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, sum(pnl) AS total FROM gd GROUP BY 1), xt AS (SELECT combo_id, count(*) AS n_exits FROM ln JOIN cb USING (a, b) GROUP BY 1)
SELECT cb.combo_id, a::DOUBLE AS a, b::DOUBLE AS b, pa::BIGINT AS pa, pb::BIGINT AS pb, n_days, first_date, last_date, round(total, 6) AS total, round(total, 6) AS closed_total, n_exits FROM cb JOIN dt USING (combo_id) LEFT JOIN xt USING (combo_id)""",
        "schedule_checks": f"WITH {CELLS} SELECT p AS project, name, p <> broken_by AND (name <> 'full_grid' OR (SELECT count(DISTINCT a) * count(DISTINCT b) = count(*) FROM cb)) AS passed, severity FROM (SELECT unnest({list(CONTRADICTIONS)}) AS p) CROSS JOIN {checks}",
        "report_round_trip": back,
        "grid_axes": f"WITH {CELLS}, x AS (SELECT 0 AS axis, a AS v FROM cb UNION ALL SELECT 1, b FROM cb) SELECT 'P1' AS project, axis::INTEGER AS axis, count(DISTINCT v) AS size, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, count(*) AS n_iter, (SELECT count(DISTINCT a) * count(DISTINCT b) = count(*) FROM cb) AS is_full FROM x GROUP BY axis",
        "grid_positions": f"WITH {CELLS} SELECT combo_id, pa AS a, pb AS b FROM cb",
        "wf_windows": f"""WITH {CELLS}, w AS (SELECT s.*, CASE WHEN anchored THEN (SELECT min(date) FROM dy) WHEN in_type = 'Week' THEN oos_start - 7 * in_len WHEN in_type = 'Month' THEN CAST(oos_start - to_months(in_len) AS DATE) END AS is_start, oos_start - 1 AS is_end, least(oos_end, (SELECT max(date) FROM dy)) AS oos_stop FROM {sched}),
j AS (SELECT w."window", min(CASE WHEN date BETWEEN is_start AND is_end THEN day_idx END) AS is_first, max(CASE WHEN date BETWEEN is_start AND is_end THEN day_idx END) AS is_last, min(CASE WHEN date BETWEEN oos_start AND oos_stop THEN day_idx END) AS oos_first, max(CASE WHEN date BETWEEN oos_start AND oos_stop THEN day_idx END) AS oos_last,
  bool_or((oos_stop - oos_start) + 1 >= 0.5 * ((oos_end - oos_start) + 1)) AS span, (min(grid_row) - 1)::INTEGER AS pick FROM w CROSS JOIN dy GROUP BY 1)
SELECT 'P1' AS project, j."window", is_first, is_last, oos_first, oos_last, oos_first IS NOT NULL AND span AS complete, pick, a.date AS is_first_date, b.date AS is_last_date, c.date AS oos_first_date, d.date AS oos_last_date FROM j LEFT JOIN dy a ON a.day_idx = is_first LEFT JOIN dy b ON b.day_idx = is_last LEFT JOIN dy c ON c.day_idx = oos_first LEFT JOIN dy d ON d.day_idx = oos_last""",
        "custom_windows": f'WITH {TWO} SELECT "window", is_first, is_last, oos_first, oos_last, a.date AS is_first_date, b.date AS oos_last_date, true AS complete FROM wn JOIN dy a ON a.day_idx = is_first JOIN dy b ON b.day_idx = oos_last',
        "custom_windows_single": f'WITH {CELLS} SELECT 1::INTEGER AS "window", 0::BIGINT AS is_first, n // 2 - 1 AS is_last, n // 2 AS oos_first, n - 1 AS oos_last, true AS complete FROM nd',
        "surface_metrics": f"WITH {SURF} SELECT 'P1' AS project, \"window\", side, combo_id, {_r('net_profit', 'max_dd', 'avg_dd')}, n_days, round(CASE WHEN avg_dd < 0 THEN net_profit / -avg_dd END, 6) AS np_over_avgdd FROM sm",
        "exit_counts": f"WITH {HOLES} SELECT 'P1' AS project, \"window\", side, combo_id, n AS n_trades FROM nx",
        "min_trade_holes": f"WITH {HOLES} SELECT 'P1' AS project, \"window\", combo_id, {_r('x', 'y', digits=3)} FROM pr",
        "neighbourhood_pool": f'WITH {REGION} SELECT "window", combo_id, {_r("x_pooled", "y_pooled", digits=9)} FROM rg',
        "region_topk": f'WITH {REGION} SELECT "window", combo_id, place::INTEGER AS place, k FROM rg WHERE place <= k',
        "region_lift": f"WITH {REGION} SELECT 'P1' AS project, \"window\", k, {lift_cols} FROM li",
        "overlap_precision": f"""WITH {REGION}, dp AS (SELECT "window", count(DISTINCT s) AS nd FROM (SELECT "window", combo_id, list(round_even(pnl, 2) ORDER BY day_idx) AS s FROM ds WHERE side = 'oos' GROUP BY 1, 2) GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY y_pooled DESC, combo_id) AS p2 FROM rg)
SELECT 'P1' AS project, o."window", round(CASE WHEN min(nd) >= 2 * min(k) THEN sum((place <= k AND p2 <= k)::INT)::DOUBLE / min(k) END, 6) AS precision FROM o JOIN dp ON dp."window" = o."window" GROUP BY 2""",
        "distinct_patterns": f"WITH {TWO} SELECT 'P1' AS project, \"window\", count(DISTINCT s) AS n_distinct FROM (SELECT \"window\", combo_id, list(round_even(pnl, 2) ORDER BY day_idx) AS s FROM ds WHERE side = 'oos' GROUP BY 1, 2) GROUP BY 2",
        "signflip_null": f"WITH {FLIP} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_lift')} FROM fd",
        "block_bootstrap_null": f"WITH {BOOT} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_lift')} FROM bd",
        "precision_null": f"""WITH {FLIP}{SURFACES}, sp AS (SELECT su."window", draw, nb.combo_id, avg(su.y) AS p FROM nb JOIN su ON su.combo_id = nb.near GROUP BY 1, 2, 3), st AS (SELECT *, row_number() OVER (PARTITION BY "window", draw ORDER BY p DESC, combo_id) AS r FROM sp)
SELECT 'P1' AS project, st."window", draw::INTEGER AS draw, round(sum((r <= k AND place <= k)::INT)::DOUBLE / min(k), 6) AS null_precision FROM st JOIN rg ON rg."window" = st."window" AND rg.combo_id = st.combo_id GROUP BY 2, 3""",
        "pvalues_window": f"WITH {FLIP} SELECT 'P1' AS project, li.\"window\", {_r('lift')}, round({pcol('null_lift', 'lift')}, 6) AS p FROM fd JOIN li ON li.\"window\" = fd.\"window\" GROUP BY li.\"window\", lift",
        "pvalues_pooled": f"WITH {FLIP} SELECT 'P1' AS project, round(avg(lift), 6) AS lift, round({pooled('fd')}, 6) AS p FROM li",
        "verdict_matrix": verdict,
        "pick_percentiles": f"WITH {REGION}{PICK}, pc AS (SELECT \"window\", 'best_is' AS rule, pick AS c FROM pk UNION ALL SELECT \"window\", 'best_pooled', combo_id FROM rg WHERE place = 1) SELECT 'P1' AS project, pc.\"window\", rule, round(avg((o.y < m.y)::INT) * 100, 6) AS pct FROM pc JOIN pr m ON m.\"window\" = pc.\"window\" AND m.combo_id = c JOIN pr o ON o.\"window\" = pc.\"window\" GROUP BY 2, 3",
        "spearman_wfc": f"WITH {PAIRS}{VALID}{CORR} SELECT 'P1' AS project, \"window\", {corr_cols} FROM co",
        "wfc_npavgdd_holes": f"WITH {HOLES}{VALID}{CORR} SELECT 'P1' AS project, \"window\", {corr_cols} FROM co",
        "torus_null": f"WITH {PAIRS}{TORUS} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_rho')} FROM tn",
        "torus_random_null": f"WITH {PAIRS}{SHIFTS} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_rho')} FROM tn",
        "permutation_null": f"WITH {PAIRS}{PERMUTED} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_rho')} FROM tn",
        "wfc_signflip_null": f"WITH {FLIP}{SURFACES}{RHO} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_rho')} FROM sn",
        "wfc_test": f"""WITH {PAIRS}{VALID}{CORR}{TORUS}, pq AS (SELECT co."window", (1.0 + sum((null_rho >= spearman)::INT)) / (1.0 + count(*)) AS p FROM tn JOIN co ON co."window" = tn."window" GROUP BY 1), z AS (SELECT co.*, CASE WHEN n_points < 8 OR n_pos_is < 4 THEN 1.0 ELSE p END AS pv FROM co JOIN pq ON pq."window" = co."window")
SELECT 'P1' AS project, "window", {corr_cols}, round(pv, 9) AS p_value, CASE WHEN pv < 0.05 AND pos_oos_frac >= 0.5 THEN 'structural edge, low over-fitting' WHEN pv < 0.05 THEN 'consistently loss-making strategy' WHEN pos_oos_frac >= 0.5 THEN 'spurious result, high over-fitting' ELSE 'noise, no edge' END AS quadrant FROM z""",
        "wfc_path_null": f"WITH {SURF}{AVGDD}{BLOCKS}{FLIPS}{PATHS}{RHO} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, {_r('null_rho')} FROM sn",
        "wfc_pooled": f"""WITH {FLIP}{VALID}{CORR}{SURFACES}{RHO}, us AS (SELECT * FROM co WHERE n_points >= 8 AND n_pos_is >= 4), m AS (SELECT avg(spearman) AS r, avg(pos_oos_frac) AS f, count(*) AS c FROM us),
z AS (SELECT r, f, c, (SELECT (1.0 + sum((v >= r)::INT)) / (1.0 + count(*)) FROM (SELECT draw, avg(null_rho) AS v FROM sn JOIN us ON us."window" = sn."window" GROUP BY 1)) AS p FROM m)
SELECT 'P1' AS project, {_r("r AS pooled_spearman", "f AS pooled_pos_oos_frac", "p AS pooled_p")}, CASE WHEN c = 0 THEN 'wfc_insufficient' WHEN p >= 0.05 AND f < 0.5 THEN 'wfc_low_corr,wfc_no_oos_edge' WHEN p >= 0.05 THEN 'wfc_low_corr' WHEN f < 0.5 THEN 'wfc_no_oos_edge' ELSE '' END AS reasons, c > 0 AND p < 0.05 AND f >= 0.5 AS passed FROM z""",
        "wfc_bands": f'WITH {PAIRS}{VALID}, b AS (SELECT *, ntile(10) OVER (PARTITION BY "window" ORDER BY x DESC, combo_id) AS band FROM vp) SELECT \'P1\' AS project, "window", band::INTEGER AS band, count(*) AS n, {_r("avg(x) AS is_mean", "avg(y) AS oos_mean", "stddev_samp(y) / sqrt(count(*)) AS oos_se", "avg((y > 0)::INT) AS oos_pos_share", digits=9)} FROM b GROUP BY 2, 3',
        "top_n_follow": f"""WITH {PAIRS}{VALID}, t AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY x DESC, combo_id) AS place, rank() OVER (PARTITION BY "window" ORDER BY y DESC) + (count(*) OVER (PARTITION BY "window", y) - 1) / 2.0 AS orank, count(*) OVER (PARTITION BY "window") AS nv FROM vp)
SELECT 'P1' AS project, "window", count(*) AS n, min(nv) AS n_valid, round(quantile_cont(orank::DOUBLE, 0.5), 6) AS median_oos_rank, sum((y > 0)::INT)::BIGINT AS n_positive_oos FROM t WHERE place <= least(10, greatest(1, nv // 3)) GROUP BY 2""",
        "plateau_score": f"""WITH {PAIRS}{NEAR}{PICK}, nn AS (SELECT pk."window", pick, near, x, y FROM pk JOIN nb ON nb.combo_id = pick JOIN pr ON pr."window" = pk."window" AND pr.combo_id = near),
s AS (SELECT "window", sum((near <> pick)::INT)::BIGINT AS n_neighbours, {PLAT}, CASE WHEN avg(y) > 0 THEN greatest(0, 1 - least(1, stddev_pop(y) / (abs(avg(y)) + 1e-9))) ELSE 0 END AS flat, avg(CASE WHEN near <> pick THEN (y > 0)::INT END) AS share FROM nn GROUP BY 1)
SELECT 'P1' AS project, "window", n_neighbours, {_r("s_x AS score_is", "s_y AS score_oos", "flat AS flat_oos", "share AS positive_share_oos")} FROM s""",
        "pooled_plateau": f"""WITH {PAIRS}{NEAR}{PICK}, nn AS (SELECT pk."window", pick, near, x, y FROM pk JOIN nb ON nb.combo_id = pick JOIN pr ON pr."window" = pk."window" AND pr.combo_id = near), s AS (SELECT "window", {PLAT} FROM nn GROUP BY 1)
SELECT 'P1' AS project, round(avg(s_y), 6) AS pooled_score, count(*) AS n_complete FROM s""",
        "plateau_bars_view": f"""WITH {PAIRS}{NEAR}{PICK} SELECT 'P1' AS project, pk."window", row_number() OVER (PARTITION BY pk."window" ORDER BY (near = pick)::INT DESC, y DESC NULLS LAST, near)::INTEGER AS place, near AS combo_id, near = pick AS is_pick, round(y, 3) AS y FROM pk JOIN nb ON nb.combo_id = pick JOIN pr ON pr."window" = pk."window" AND pr.combo_id = near""",
        "slice_view": f"WITH {CELLS} SELECT 'P1' AS project, combo_id, CASE WHEN w THEN pb ELSE pa END AS row, CASE WHEN w THEN pa ELSE pb END AS col FROM cb CROSS JOIN (SELECT count(DISTINCT pa) >= count(DISTINCT pb) AS w FROM cb)",
        "trade_medians": f"""WITH {HOLES}, e AS (SELECT "window", combo_id, min(n) AS least, max(CASE WHEN side = 'is' THEN n END) AS a, max(CASE WHEN side = 'oos' THEN n END) AS b FROM nx GROUP BY 1, 2)
SELECT 'P1' AS project, "window", sum((least < 10)::INT)::BIGINT AS n_dropped, CAST(floor(quantile_cont(a, 0.5)) AS BIGINT) AS is_trades_median, CAST(floor(quantile_cont(b, 0.5)) AS BIGINT) AS oos_trades_median FROM e GROUP BY 2""",
        "run_facts": f"""WITH {CELLS} SELECT 'P1' AS project, (SELECT count(DISTINCT a) || 'x' || count(DISTINCT b) FROM cb) AS shape, (SELECT count(*) FROM cb) AS n_iter, (SELECT count(*) FROM dy) AS n_days, (SELECT min(date) FROM dy) AS dates_start, (SELECT max(date) FROM dy) AS dates_end, 2::BIGINT AS n_windows, 2::BIGINT AS n_complete, (SELECT greatest(1, CAST(round_even(count(*) * 0.2, 0) AS INTEGER)) FROM cb) AS region_k""",
        "ridge_overlap": f"""WITH RECURSIVE {COMP}{_ridge("y_pooled", "2")}, j AS (SELECT coalesce(a."window", b."window") AS "window", sum((a.combo_id IS NOT NULL AND b.combo_id IS NOT NULL)::INT)::DOUBLE / count(*) AS jaccard FROM rdg a FULL JOIN rdg2 b ON a."window" = b."window" AND a.combo_id = b.combo_id GROUP BY 1),
c1 AS (SELECT "window", avg(pa) AS ma, avg(pb) AS mb FROM rdg JOIN cb USING (combo_id) GROUP BY 1), c2 AS (SELECT "window", avg(pa) AS ma, avg(pb) AS mb FROM rdg2 JOIN cb USING (combo_id) GROUP BY 1)
SELECT 'P1' AS project, j."window", round(jaccard, 6) AS jaccard, round(sqrt(pow(c1.ma - c2.ma, 2) + pow(c1.mb - c2.mb, 2)), 6) AS shift FROM j LEFT JOIN c1 ON c1."window" = j."window" LEFT JOIN c2 ON c2."window" = j."window" """,
        "effective_trials": f"""WITH {TWO}, z AS (SELECT "window", combo_id, day_idx, (pnl - avg(pnl) OVER w) / nullif(stddev_pop(pnl) OVER w, 0) AS z, count(*) OVER w AS n FROM ds WHERE side = 'is' WINDOW w AS (PARTITION BY "window", combo_id)), c AS (SELECT a."window", a.combo_id, sum(a.z * b.z) / min(a.n) AS c FROM z a JOIN z b ON b."window" = a."window" AND b.day_idx = a.day_idx WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a."window", a.combo_id, b.combo_id)
SELECT 'P1' AS project, "window", round(pow(count(DISTINCT combo_id), 2) / sum(c * c), 6) AS n_eff FROM c GROUP BY 2""",
        "stationary_bootstrap": f"WITH {TWO}{DAYS.format(n=N_BOOT)} SELECT 'P1' AS project, \"window\", draw::INTEGER AS draw, day, count(*) AS times FROM bt GROUP BY 2, 3, 4",
        "reality_check": f"""WITH {PAIRS}{PICK}{DAYS.format(n=N_BOOT)}, tm AS (SELECT "window", draw, day, min(n) AS n, count(*) AS times FROM bt GROUP BY 1, 2, 3), me AS (SELECT "window", combo_id, avg(pnl) AS f FROM ds WHERE side = 'is' GROUP BY 1, 2),
dm AS (SELECT d."window", tm.draw, d.combo_id, sum((d.pnl - me.f) * times) / min(tm.n) AS m FROM ds d JOIN me ON me."window" = d."window" AND me.combo_id = d.combo_id JOIN tm ON tm."window" = d."window" AND tm.day = d.day_idx - d.lo WHERE side = 'is' GROUP BY 1, 2, 3), mx AS (SELECT "window", draw, max(m) AS nm FROM dm GROUP BY 1, 2),
be AS (SELECT "window", max(f) AS bf, first(combo_id ORDER BY f DESC, combo_id) AS bi FROM me GROUP BY 1), pm AS (SELECT pk."window", f AS pf FROM pk JOIN me ON me."window" = pk."window" AND me.combo_id = pick)
SELECT 'P1' AS project, mx."window", (SELECT (hi - lo + 1)::INTEGER FROM sd WHERE side = 'is' AND sd."window" = mx."window") AS n_days, min(bi) AS best_index, round(min(bf), 6) AS best_mean, round(min(pf), 6) AS pick_mean, round({pcol("nm", "bf")}, 6) AS p_best, round({pcol("nm", "pf")}, 6) AS p_pick FROM mx JOIN be ON be."window" = mx."window" JOIN pm ON pm."window" = mx."window" GROUP BY 2""",
        "ridge_component": f"WITH RECURSIVE {COMP} SELECT 'P1' AS project, \"window\", combo_id FROM rdg",
        "medoid_centre": f"WITH RECURSIVE {COMP}{MEDOID} SELECT 'P1' AS project, * FROM ct",
        "ensemble": f"""WITH RECURSIVE {COMP}{MEDOID}{SPREAD} SELECT 'P1' AS project, es."window", array_to_string(list_transform(ms, lambda m: m.i), ' ') AS members, gap::INTEGER AS spacing, interior FROM es JOIN fc ON fc."window" = es."window\"""",
        "base_setting": f"""WITH RECURSIVE {BASIS_REGION}{_ridge("x_pooled")}{MEDOID}{SPREAD}, f5 AS (SELECT combo_id, pa, pb FROM rg JOIN cb USING (combo_id) ORDER BY x DESC, combo_id LIMIT 5),
f5m AS (SELECT avg(pa) AS ma, avg(pb) AS mb FROM f5), fr(i) AS (SELECT min(combo_id) FROM f5 UNION SELECT n.combo_id FROM fr JOIN f5 m ON m.combo_id = fr.i JOIN f5 n ON abs(m.pa - n.pa) <= 1 AND abs(m.pb - n.pb) <= 1),
rd AS (SELECT reading FROM ({verdict})), rn AS (SELECT min(a) AS a1, max(a) AS a2, min(b) AS b1, max(b) AS b2 FROM rdg JOIN cb USING (combo_id)), pk AS (SELECT CASE WHEN reading = 'edge' THEN peak ELSE centre END AS pick FROM ct CROSS JOIN rd)
SELECT 'P1' AS project, n_cells, centre, is_peak, peak, (SELECT min(date) FROM bd) AS basis_start, (SELECT max(date) FROM bd) AS basis_end, (SELECT count(*) FROM bd) AS n_basis_days,
  array_to_string(list_transform(ms, lambda m: m.i), ' ') AS members, gap::INTEGER AS spacing, interior, '0:' || a1 || ':' || a2 || ' 1:' || b1 || ':' || b2 AS ranges, (SELECT first(combo_id ORDER BY sqrt(pow(pa - ma, 2) + pow(pb - mb, 2)), combo_id) FROM cb CROSS JOIN f5m) AS five_best_centre,
  (SELECT count(*) FROM fr) = (SELECT count(*) FROM f5) AS five_best_connected, reading, pick, CASE WHEN reading = 'edge' THEN 'pooled peak' ELSE 'centre' END AS pick_rule, CASE reading WHEN 'edge' THEN 'supported' WHEN 'plateau' THEN 'low stakes' ELSE 'none' END AS confidence,
  (SELECT a || ' ' || b FROM cb WHERE combo_id = pick) AS pick_params FROM ct CROSS JOIN es CROSS JOIN fc CROSS JOIN rn CROSS JOIN rd CROSS JOIN pk""",
        "ols_line_view": f"WITH {PAIRS} SELECT 'P1' AS project, \"window\", {_r('regr_slope(y, x) AS slope', 'regr_intercept(y, x) AS intercept', 'min(x) AS x_min', 'max(x) AS x_max')} FROM pr GROUP BY 2",
        "rolling_view": f"""WITH {PAIRS}{VALID}, p AS (SELECT "window", combo_id, row_number() OVER (PARTITION BY "window" ORDER BY x DESC, combo_id) AS place, (rx - 1) / greatest(1, count(*) OVER (PARTITION BY "window") - 1) * 100.0 AS x_pct, (ry - 1) / greatest(1, count(*) OVER (PARTITION BY "window") - 1) * 100.0 AS y_pct FROM ({_ranks("vp", '"window"', "x", "y")}))
SELECT 'P1' AS project, "window", combo_id, place::INTEGER AS place, {_r("x_pct", "y_pct")}, round(avg(y_pct) OVER (PARTITION BY "window" ORDER BY place ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS rolling FROM p""",
        "outline_view": f"""WITH {REGION}, ce AS (SELECT "window", pb AS r, pa AS c FROM rg JOIN cb USING (combo_id) WHERE place <= k), e AS (SELECT "window", r, c - 1 AS c2, r AS r2, c - 0.5 AS x0, r - 0.5 AS y0, c - 0.5 AS x1, r + 0.5 AS y1 FROM ce UNION ALL SELECT "window", r, c + 1, r, c + 0.5, r - 0.5, c + 0.5, r + 0.5 FROM ce
UNION ALL SELECT "window", r, c, r - 1, c - 0.5, r - 0.5, c + 0.5, r - 0.5 FROM ce UNION ALL SELECT "window", r, c, r + 1, c - 0.5, r + 0.5, c + 0.5, r + 0.5 FROM ce)
SELECT 'P1' AS project, e."window", x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM e ANTI JOIN ce ON ce."window" = e."window" AND ce.r = e.r2 AND ce.c = e.c2""",
    }
