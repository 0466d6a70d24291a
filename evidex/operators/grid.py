"""The parameter grid: axes, windows of days, surfaces, neighbourhoods.

Tables are keyed by project: combos (project, combo_id, params, pos), grid_daily (project, combo_id, day_idx, date, pnl),
grid_exits (project, combo_id, date, n), days (project, day_idx, date) and windows (project, window, complete, pick, and
the first and last day_idx and date of both sides). A surface is (project, window, combo_id, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("NP", "NPAvgDD")
SCHEMES = ("schedule", "two", "single")
WINDOW = ["project", "window"]


def axes(params: DataFrame) -> DataFrame:
    """combos with pos: for each axis, the place of the value among the project's distinct values. params: (project, combo_id, params)."""
    each = params.select("project", "combo_id", F.posexplode("params").alias("axis", "value"))
    ranked = each.withColumn("p", F.dense_rank().over(Window.partitionBy("project", "axis").orderBy("value")) - 1)
    pos = ranked.groupBy("project", "combo_id").agg(F.array_sort(F.collect_list(F.struct("axis", "p"))).alias("s"))
    return params.join(pos.select("project", "combo_id", F.col("s.p").alias("pos")), ["project", "combo_id"])


def shape(combos: DataFrame) -> DataFrame:
    """(project, axis, size, low, high, n_iter, is_full): the axes, and whether the grid is their full product."""
    n = combos.groupBy("project").agg(F.count("*").alias("n_iter"), F.count_distinct("pos").alias("distinct_cells"))
    each = combos.select("project", F.posexplode("params").alias("axis", "value")).groupBy("project", "axis").agg(F.count_distinct("value").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
    cells = F.exp(F.sum(F.log("size")).over(Window.partitionBy("project")))
    out = each.join(n, "project").withColumn("cells", F.round(cells).cast("bigint"))
    return out.select("project", "axis", "size", "low", "high", "n_iter", ((F.col("cells") == F.col("n_iter")) & (F.col("n_iter") == F.col("distinct_cells"))).alias("is_full"))


def custom_windows(days: DataFrame, scheme: str) -> DataFrame:
    """Windows that ignore any schedule: `single` halves the days, `two` takes thirds, each in sample for the next. Complete, without a pick."""
    if scheme not in ("single", "two"):
        raise ValueError(f"scheme must be 'single' or 'two', got {scheme!r}")
    n = days.groupBy("project").agg(F.count("*").cast("int").alias("n"))
    if not n.where("n < 6").isEmpty():
        raise ValueError("need at least 6 trading days")
    parts = 2 if scheme == "single" else 3
    cut = lambda i: F.floor(F.col("n") * i / parts)
    w = n.withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))))
    i = F.col("window")
    w = w.select("project", "window", cut(i - 1).alias("is_first"), (cut(i) - 1).alias("is_last"), cut(i).alias("oos_first"), (cut(i + 1) - 1).alias("oos_last"), F.lit(True).alias("complete"), F.lit(None).cast("int").alias("pick"))
    return _with_dates(w, days)


def _with_dates(w: DataFrame, days: DataFrame) -> DataFrame:
    for side in ("is", "oos"):
        for end in ("first", "last"):
            d = days.select("project", F.col("day_idx").alias(f"{side}_{end}"), F.col("date").alias(f"{side}_{end}_date"))
            w = w.join(d, ["project", f"{side}_{end}"], "left")
    return w


def schedule_windows(schedule: DataFrame, days: DataFrame, min_complete: float = 0.5) -> DataFrame:
    """Windows of a schedule (project, window, oos_start, oos_end, in_len, in_type, anchored, grid_row) on the project's days.

    In sample runs from in_len days, weeks, months or years before the out-of-sample start (from the first day if
    anchored) to the day before it. A window is complete with an out-of-sample day, and at least min_complete of its span.
    """
    ends = days.groupBy("project").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    s = schedule.join(ends, "project")
    n, start = F.col("in_len"), F.col("oos_start")
    back = F.when(F.col("in_type") == "Day", F.date_sub(start, n)).when(F.col("in_type") == "Week", F.date_sub(start, 7 * n)).when(F.col("in_type") == "Month", F.add_months(start, -n)).when(F.col("in_type") == "Year", F.add_months(start, -12 * n))
    s = s.withColumns({"is_start": F.when(F.col("anchored"), F.col("d0")).otherwise(back), "is_end": F.date_sub(start, 1), "oos_stop": F.least("oos_end", "d1")})
    inside = days.select("project", "day_idx", F.col("date").alias("d"))
    j = s.join(inside, "project", "left")  # a few windows by days
    first = lambda a, b: F.min(F.when(F.col("d").between(F.col(a), F.col(b)), F.col("day_idx")))
    last = lambda a, b: F.max(F.when(F.col("d").between(F.col(a), F.col(b)), F.col("day_idx")))
    span = (F.datediff("oos_stop", "oos_start") + 1) >= min_complete * (F.datediff("oos_end", "oos_start") + 1)
    w = j.groupBy("project", "window", "is_start", "is_end", "oos_start", "oos_end", "oos_stop", "grid_row").agg(
        first("is_start", "is_end").alias("is_first"), last("is_start", "is_end").alias("is_last"), first("oos_start", "oos_stop").alias("oos_first"), last("oos_start", "oos_stop").alias("oos_last")
    )
    w = w.select("project", "window", "is_first", "is_last", "oos_first", "oos_last", (F.col("oos_first").isNotNull() & span).alias("complete"), (F.col("grid_row") - 1).alias("pick"))
    return _with_dates(w, days)


def window_label(w: Column, oos_start: Column, oos_end: Column, complete: Column) -> Column:
    return F.concat(F.format_string("window %d: OOS %s to %s", w, oos_start.cast("string"), oos_end.cast("string")), F.when(complete, "").otherwise(" (incomplete)"))


def sides(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, window, side, combo_id, day_idx, date, pnl): days dealt to the windows' sides. windows has a few rows a project."""
    w = windows.select("project", "window", F.explode(F.array(F.struct(F.lit("is").alias("side"), F.col("is_first").alias("lo"), F.col("is_last").alias("hi")), F.struct(F.lit("oos").alias("side"), F.col("oos_first").alias("lo"), F.col("oos_last").alias("hi")))).alias("s")).select("project", "window", "s.*")
    return daily.join(w, "project").where("day_idx between lo and hi").drop("lo", "hi")


def surface_metrics(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, window, side, combo_id, net_profit, max_dd, avg_dd, np_over_avgdd, n_days); the ratio is NULL if never in drawdown.

    Equity starts flat at 0 on the side's first day. One pass over the days, partitioned by window, side and combination.
    """
    d = sides(daily, windows)
    w = Window.partitionBy("project", "window", "side", "combo_id").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("eq", F.sum("pnl").over(w))
    d = d.withColumn("dd", F.col("eq") - F.greatest(F.lit(0.0), F.max("eq").over(w)))
    a = d.groupBy("project", "window", "side", "combo_id").agg(F.sum("pnl").alias("net_profit"), F.min("dd").alias("max_dd"), F.avg("dd").alias("avg_dd"), F.count("*").alias("n_days"))
    return a.withColumn("np_over_avgdd", F.when(F.col("avg_dd") < 0, F.try_divide("net_profit", -F.col("avg_dd"))))


def exit_counts(exits: DataFrame, combos: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, window, side, combo_id, n_trades): trades closed between the first and the last date of each side."""
    w = windows.select("project", "window", F.explode(F.array(F.struct(F.lit("is").alias("side"), F.col("is_first_date").alias("lo"), F.col("is_last_date").alias("hi")), F.struct(F.lit("oos").alias("side"), F.col("oos_first_date").alias("lo"), F.col("oos_last_date").alias("hi")))).alias("s")).select("project", "window", "s.*")
    n = exits.join(w, "project").where("date between lo and hi").groupBy("project", "window", "side", "combo_id").agg(F.sum("n").alias("n"))
    every = combos.select("project", "combo_id").join(w.select("project", "window", "side"), "project")
    return every.join(n, ["project", "window", "side", "combo_id"], "left").select("project", "window", "side", "combo_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_trades"))


def trade_medians(counts: DataFrame, min_trades: int = 10) -> DataFrame:
    """(project, window, n_dropped, is_trades_median, oos_trades_median): combinations with fewer than min_trades trades on a side,
    and the sides' median trades over combinations, rounded down. counts: as exit_counts gives them."""
    each = counts.groupBy(*WINDOW, "combo_id").agg(F.min("n_trades").alias("least"), *(F.max(F.when(F.col("side") == s, F.col("n_trades"))).alias(s) for s in ("is", "oos")))
    median = lambda s: F.floor(F.percentile(s, 0.5)).alias(f"{s}_trades_median")
    return each.groupBy(*WINDOW).agg(F.count_if(F.col("least") < min_trades).alias("n_dropped"), median("is"), median("oos"))


def metric_pairs(metrics: DataFrame, metric: str = "NP", counts: DataFrame | None = None, min_trades: int = 10) -> DataFrame:
    """(project, window, combo_id, x, y): in- and out-of-sample metric; NULL where a side has fewer than min_trades trades."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    v = F.col("net_profit" if metric == "NP" else "np_over_avgdd")
    p = metrics.groupBy(*WINDOW, "combo_id").agg(F.max(F.when(F.col("side") == "is", v)).alias("x"), F.max(F.when(F.col("side") == "oos", v)).alias("y"))
    if counts is None:
        return p
    few = counts.groupBy(*WINDOW, "combo_id").agg(F.min("n_trades").alias("n_"))
    keep = F.col("n_") >= min_trades
    return p.join(few, [*WINDOW, "combo_id"]).select(*WINDOW, "combo_id", F.when(keep, F.col("x")).alias("x"), F.when(keep, F.col("y")).alias("y"))


def best_pick(pairs: DataFrame) -> DataFrame:
    """(project, window, pick): the best in-sample combination, the first of equals, 0 without any."""
    return pairs.groupBy(*WINDOW).agg(F.coalesce(F.max_by("combo_id", F.when(F.col("x").isNotNull(), F.struct("x", -F.col("combo_id")))), F.lit(0)).alias("pick"))


def neighbours(combos: DataFrame, itself: bool = True) -> DataFrame:
    """(project, combo_id, near): combinations within one step on every axis, no wrap; itself included if asked.

    An equi-join on the cells around each combination (3 to the number of axes), so no pair is compared that isn't near.
    """
    k = F.size("pos")
    step = lambda p, d: (p + F.floor(F.col("i") / F.pow(F.lit(3), d)).cast("int") % 3 - 1).cast("int")
    around = combos.withColumn("i", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(3), k) - 1).cast("int")))).select("project", "combo_id", F.transform("pos", step).alias("cell"))
    cells = combos.select("project", F.col("combo_id").alias("near"), F.transform("pos", lambda p: p.cast("int")).alias("cell"))
    out = around.join(cells, ["project", "cell"]).select("project", "combo_id", "near")
    return out if itself else out.where("combo_id <> near")


def pool(surface: DataFrame, near: DataFrame, value: str, keys: list[str] = WINDOW) -> DataFrame:
    """surface with `pooled`: the mean of each combination's value and its neighbours'."""
    v = surface.select(*keys, F.col("combo_id").alias("near"), F.col(value).alias("v_"))
    p = near.join(v, list(dict.fromkeys(["project", "near"]))).groupBy(*keys, "combo_id").agg(F.avg("v_").alias("pooled"))
    return surface.join(p, [*keys, "combo_id"])


def region_size(n: Column) -> Column:
    """A fifth of the combinations, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(n * 0.2).cast("int"))


def top_k(surface: DataFrame, value: str, keys: list[str] = WINDOW) -> DataFrame:
    """surface with place (1 = best; NULL last, ties by combination) and k, the region's size."""
    w = Window.partitionBy(*keys)
    return surface.withColumns({"place": F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), "combo_id")), "k": region_size(F.count("*").over(w))})
