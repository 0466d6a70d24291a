"""Trades against bars: the join and its checks, returns, and the drift that a random entry would have earned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.scalars import interval_minutes
from evidex.functions.semantics import isclose

PRICE_TOLERANCE, MONEY_TOLERANCE = 1e-6, 0.011


class ValidationFailed(ValueError):
    """Trades and bars don't belong together; checks holds every check."""

    def __init__(self, checks: list):
        super().__init__("; ".join(f"{c.name}: {c.detail}" for c in checks if not c.passed and c.severity == "error"))
        self.checks = checks


def dates_only(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(strategy_id, by_date): whether a strategy's times are all midnights and its bars one a day, so that dates are joined."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz") == F.col(c)
    unique = bars.groupBy("symbol", F.to_date("ts").alias("d")).count().groupBy("symbol").agg((F.max("count") == 1).alias("daily"))
    t = trades.groupBy("strategy_id", "symbol").agg(F.every(day("entry_time") & day("exit_time")).alias("midnight"))
    return t.join(unique, "symbol", "left").select("strategy_id", "symbol", (F.col("midnight") & F.coalesce("daily", F.lit(False))).alias("by_date"))


def join_bars(trades: DataFrame, bars: DataFrame, by_date: bool = False) -> DataFrame:
    """trades with entry_idx, exit_idx and hold_bars, and the bar prices of both ends; NULL where a time has no bar.

    Two equi-joins on (symbol, time); Spark broadcasts the bars where they are small and shuffles by key where not.
    """
    key = (lambda c: F.to_date(c)) if by_date else (lambda c: F.col(c))
    out = trades
    for side, time in (("entry", "entry_time"), ("exit", "exit_time")):
        b = bars.select(F.col("symbol").alias("s_"), key("ts").alias("k_"), F.col("bar_idx").alias(f"{side}_idx"), *(F.col(c).alias(f"{side}_{c}") for c in ("open", "high", "low")))
        out = out.join(b, (F.col("symbol") == F.col("s_")) & (key(time) == F.col("k_")), "left").drop("s_", "k_")
    return out.withColumn("hold_bars", F.col("exit_idx") - F.col("entry_idx"))


def pct_return() -> Column:
    return F.col("direction") * (F.try_divide("exit_price", "entry_price") - 1.0)


def usd_per_contract(point_value: Column | float) -> Column:
    v = point_value if isinstance(point_value, Column) else F.lit(point_value)
    return F.col("direction") * (F.col("exit_price") - F.col("entry_price")) * v


def bar_interval(bars: DataFrame) -> DataFrame:
    """(symbol, minutes): the most frequent spacing of neighbouring bars, the smallest of equally frequent ones."""
    w = Window.partitionBy("symbol").orderBy("ts")
    step = bars.select("symbol", (F.timestamp_diff("MINUTE", F.lag("ts").over(w), F.col("ts"))).alias("minutes")).where("minutes is not null")
    n = step.groupBy("symbol", "minutes").count()
    return n.groupBy("symbol").agg(F.min_by("minutes", F.struct(-F.col("count"), F.col("minutes"))).alias("minutes"))


def point_values(joined: DataFrame) -> DataFrame:
    """(strategy_id, point_value, residual): least squares through the origin of gross P&L on points, over trades that moved."""
    pts = F.col("direction") * (F.col("exit_price") - F.col("entry_price")) * F.col("contracts")
    moved = joined.withColumn("pts", pts).where("pts <> 0")
    fit = moved.groupBy("strategy_id").agg(F.bround(F.try_divide(F.sum(F.col("gross_pnl") * F.col("pts")), F.sum(F.col("pts") * F.col("pts"))), 4).alias("point_value"))
    left = moved.join(fit, "strategy_id").groupBy("strategy_id").agg(F.max(F.abs(F.col("gross_pnl") - F.bround(F.col("point_value") * F.col("pts"), 2))).alias("residual"))
    return fit.join(left, "strategy_id")


CHECKS = "has_trades timestamps_found exit_after_entry prices_in_bar_range point_value_constant net_reconciles hold_matches_summary interval_matches_bars min_trades".split()


def join_checks(joined: DataFrame, bars: DataFrame, summary: DataFrame | None = None, settings: DataFrame | None = None, min_trades: int = 30) -> DataFrame:
    """(strategy_id, name, passed, severity, value): every check of every strategy; value is its figure.

    summary: (strategy_id, avg_bars); settings: (strategy_id, interval). One pass over the joined trades gives all figures.
    """
    inside = lambda s: F.col(f"{s}_price").between(F.col(f"{s}_low") - PRICE_TOLERANCE, F.col(f"{s}_high") + PRICE_TOLERANCE)
    cost = 2 * (F.col("comm_side") + F.col("slip_side"))
    gap = lambda c: F.max(F.abs(F.col("gross_pnl") - c - F.col("net_pnl")))
    a = joined.groupBy("strategy_id", "symbol").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("entry_idx").isNull() | F.col("exit_idx").isNull()).alias("missing"),
        F.count_if(F.col("hold_bars") < 0).alias("backward"),
        F.count_if(~(inside("entry") & inside("exit"))).alias("outside"),
        F.avg(isclose(F.col("entry_price"), F.col("entry_open")).cast("double")).alias("at_open"),
        gap(cost).alias("per_trade"),
        gap(cost * F.col("contracts")).alias("per_contract"),
        (F.avg("hold_bars") + 1.0).alias("bars_held"),
    )
    a = a.join(point_values(joined), "strategy_id", "left").join(bar_interval(bars), "symbol", "left")
    a = a.join(summary, "strategy_id", "left") if summary is not None else a.withColumn("avg_bars", F.lit(None).cast("double"))
    a = a.join(settings, "strategy_id", "left") if settings is not None else a.withColumn("interval", F.lit(None).cast("string"))
    want = interval_minutes(F.col("interval"))
    rows = [
        ("has_trades", F.col("n") > 0, "error", F.col("n")),
        ("timestamps_found", F.col("missing") == 0, "error", F.col("missing")),
        ("exit_after_entry", F.col("backward") == 0, "error", F.col("backward")),
        ("prices_in_bar_range", F.col("outside") == 0, "error", F.col("at_open")),
        ("point_value_constant", F.coalesce(F.col("residual") <= MONEY_TOLERANCE, F.lit(False)), "error", F.col("point_value")),
        ("net_reconciles", F.coalesce(F.least("per_trade", "per_contract") < MONEY_TOLERANCE, F.lit(False)), "warn", F.least("per_trade", "per_contract")),
        ("hold_matches_summary", F.coalesce(F.abs(F.col("bars_held") - F.col("avg_bars")) <= 0.05, F.lit(True)), "warn", F.col("bars_held")),
        ("interval_matches_bars", F.coalesce(want == F.col("minutes"), F.lit(True)), "error", F.col("minutes")),
        ("min_trades", F.col("n") >= min_trades, "warn", F.col("n")),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), F.lit(s).alias("severity"), F.round(v.cast("double"), 6).alias("value")) for n, p, s, v in rows))
    return a.select("strategy_id", F.explode(each).alias("c")).select("strategy_id", "c.*")


def cost_basis(joined: DataFrame) -> DataFrame:
    """(strategy_id, cost_basis): whether the report's costs are per_trade or per_contract, or unknown."""
    cost = 2 * (F.col("comm_side") + F.col("slip_side"))
    gap = lambda c: F.max(F.abs(F.col("gross_pnl") - c - F.col("net_pnl")))
    basis = F.when(gap(cost) < MONEY_TOLERANCE, "per_trade").when(gap(cost * F.col("contracts")) < MONEY_TOLERANCE, "per_contract").otherwise("unknown")
    return joined.groupBy("strategy_id").agg(basis.alias("cost_basis"))


def forward_returns(bars: DataFrame, holds: DataFrame) -> DataFrame:
    """(symbol, hold, bar_idx, fwd): open[j + hold] / open[j] - 1 of every bar j that has bar j + hold; holds: (symbol, hold)."""
    later = bars.select(F.col("symbol").alias("s_"), F.col("bar_idx").alias("x_idx"), F.col("open").alias("x_open"))
    j = bars.select("symbol", "bar_idx", "open").join(holds, "symbol")
    return j.join(later, (F.col("symbol") == F.col("s_")) & (F.col("bar_idx") + F.col("hold") == F.col("x_idx"))).select("symbol", "hold", "bar_idx", (F.try_divide("x_open", "open") - 1.0).alias("fwd"))


def drift_by_hold(bars: DataFrame, holds: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(symbol[, keys of mask], hold, mu, p_up, p_down) over entry bars, those in mask (symbol, bar_idx, keys) if given.

    Only distinct holds are joined to the bars; trades get their drift by a second, small join. The mask limits entries,
    not exits. A hold without a candidate bar has no row.
    """
    fwd = forward_returns(bars, holds)
    keys = []
    if mask is not None:
        keys = [c for c in mask.columns if c not in ("symbol", "bar_idx")]
        fwd = fwd.join(mask, ["symbol", "bar_idx"])
    return fwd.groupBy("symbol", *keys, "hold").agg(F.avg("fwd").alias("mu"), F.avg((F.col("fwd") > 0).cast("double")).alias("p_up"), F.avg((F.col("fwd") < 0).cast("double")).alias("p_down"))


def with_baseline(joined: DataFrame, bars: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """joined with `hold` (at least 1), base_mean and base_win: the mean return, and the chance to win, of a random entry with the trade's hold and direction."""
    t = joined.withColumn("hold", F.greatest(F.col("hold_bars"), F.lit(1)))
    d = drift_by_hold(bars, t.select("symbol", "hold").where("hold is not null").distinct(), mask)
    keys = [c for c in d.columns if c not in ("mu", "p_up", "p_down")]
    out = t.join(d, keys, "left")
    return out.withColumns({"base_mean": F.col("direction") * F.col("mu"), "base_win": F.when(F.col("direction") > 0, F.col("p_up")).otherwise(F.col("p_down"))}).drop("mu", "p_up", "p_down")


def lift(based: DataFrame) -> DataFrame:
    """(strategy_id, n_trades, observed and baseline mean and win rate, lift)."""
    r = pct_return()
    a = based.groupBy("strategy_id").agg(F.count("*").alias("n_trades"), F.avg(r).alias("observed_mean"), F.avg("base_mean").alias("baseline_mean"), F.avg((r > 0).cast("double")).alias("observed_win_rate"), F.avg("base_win").alias("baseline_win_rate"))
    return a.withColumn("lift", F.col("observed_mean") - F.col("baseline_mean"))
