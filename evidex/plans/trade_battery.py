"""The trade battery: join and checks, then five independent tests and their verdicts, for many strategies at once.

Everything is lazy but the checks, which are a few rows a strategy and decide on the driver whether the rest may run. The
joined trades with their baseline are computed once and kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.scalars import symbol_root
from evidex.operators import costs, drawdown, nulls, temporal, timing
from evidex.operators import trades as T
from evidex.plans.export import nested, to_json
from evidex.session import cut

ALPHA = 0.05


@dataclass
class Battery:
    checks: DataFrame
    meta: DataFrame
    random_entry: DataFrame
    windows: DataFrame
    window_score: DataFrame
    regimes: DataFrame
    yearly: DataFrame
    cost_curve: DataFrame
    cost_summary: DataFrame
    drawdown: DataFrame
    verdicts: DataFrame

    def json(self) -> DataFrame:
        """(strategy_id, json): each strategy's whole result."""
        many = {k: getattr(self, k) for k in ("verdicts", "checks", "random_entry", "windows", "window_score", "regimes", "yearly", "cost_curve", "cost_summary")}
        dd = self.drawdown.select("strategy_id", *(c for c in self.drawdown.columns if c != "strategy_id"))
        return to_json(nested(self.meta, many | {"drawdown": dd}, ["strategy_id"]), ["strategy_id"])


def checked(trades: DataFrame, bars: DataFrame, summary: DataFrame | None, settings: DataFrame | None, min_trades: int, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(joined trades of the strategies without a failed error check, all checks); strict raises if there is a failed one."""
    flags = T.dates_only(trades, bars)
    dated = flags.where("by_date").select("strategy_id")
    parts = [T.join_bars(trades.join(dated, "strategy_id", "left_anti"), bars)]
    if not dated.isEmpty():
        parts.append(T.join_bars(trades.join(dated, "strategy_id", "left_semi"), bars, by_date=True))
    joined = cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    checks = cut(T.join_checks(joined, bars, summary, settings, min_trades))
    failed = checks.where("not passed and severity = 'error'")
    if strict and (rows := failed.limit(100).collect()):
        raise T.ValidationFailed([type("Check", (), {"name": r["name"], "passed": r.passed, "severity": r.severity, "detail": f"strategy {r.strategy_id}, {r['value']}"}) for r in rows])
    return joined.join(failed.select("strategy_id").distinct(), "strategy_id", "left_anti"), checks


def run(trades: DataFrame, bars: DataFrame, summary: DataFrame | None = None, settings: DataFrame | None = None, n_perm: int = 1000, seed: int = 0, min_trades: int = 30, capital: float | None = None, margin: float | None = None, strict: bool = True) -> Battery:
    """All tests of every strategy. trades may carry strategies of several symbols; bars the symbols' bars."""
    joined, checks = checked(trades, bars, summary, settings, min_trades, strict)
    pv = T.point_values(joined).select("strategy_id", "point_value")
    based = cut(T.with_baseline(joined.join(pv, "strategy_id"), bars))
    v = F.col("point_value")
    r = nulls.random_entry_test(based, bars, n_perm, seed)
    keep = [c for c in joined.columns]
    valued = joined.join(pv, "strategy_id").select(*keep, "point_value")
    windows = cut(temporal.window_results(valued, bars, v))
    cost = costs.cost_per_strategy(joined)
    summary_cost = costs.cost_summary(based, cost, v)
    pnl = valued.select("strategy_id", "trade_id", "entry_time", "exit_time", T.usd_per_contract(v).alias("pnl"))
    dd = drawdown.drawdown_summary(pnl, capital=capital)
    if margin is not None:
        dd = dd.withColumns(drawdown.margin_ratios(F.col("capital"), F.lit(float(margin))))
    enough = F.col("n_trades") >= min_trades
    verdict = lambda ok: F.when(~enough, "insufficient").when(ok, "pass").otherwise("fail")
    verdicts = r.select("strategy_id", "n_trades", "p_value").join(summary_cost.select("strategy_id", "passed_1x"), "strategy_id")
    verdicts = verdicts.select("strategy_id", F.lit("reference").alias("baseline"), verdict(F.col("p_value") < ALPHA).alias("random_entry"), F.lit("score").alias("temporal"), verdict(F.col("passed_1x")).alias("cost"), F.lit("reference").alias("drawdown"))
    verdicts = verdicts.withColumns({"gates_passed": (F.col("random_entry") == "pass").cast("int") + (F.col("cost") == "pass").cast("int"), "gates_total": F.lit(2)})
    return Battery(checks, _meta(based, bars, pv), r, windows, temporal.window_score(windows), temporal.regime_results(valued, bars, v), temporal.yearly(valued, v), costs.cost_curve(based, cost, v), summary_cost, dd, verdicts)


def _meta(joined: DataFrame, bars: DataFrame, pv: DataFrame) -> DataFrame:
    b = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min("ts").alias("bars_start"), F.max("ts").alias("bars_end")).join(T.bar_interval(bars), "symbol")
    m = joined.groupBy("strategy_id", "symbol").agg(F.count_if(F.col("direction") > 0).alias("n_long"), F.count_if(F.col("direction") < 0).alias("n_short"), F.min("entry_time").alias("first_entry"), F.max("exit_time").alias("last_exit"))
    return m.withColumn("root", symbol_root(F.col("symbol"))).join(b, "symbol").join(T.cost_basis(joined), "strategy_id").join(pv, "strategy_id")


@dataclass
class Timing:
    checks: DataFrame
    meta: DataFrame
    curves: DataFrame
    first_nonpositive: DataFrame
    paired: DataFrame
    at_open: DataFrame

    def json(self) -> DataFrame:
        many = {k: getattr(self, k) for k in ("checks", "curves", "first_nonpositive", "at_open")}
        return to_json(nested(self.meta, many, ["strategy_id"]), ["strategy_id"])


def run_timing(trades: DataFrame, bars: DataFrame, summary: DataFrame | None = None, settings: DataFrame | None = None, max_k: int = 10, mode: str = "fixed_exit", min_trades: int = 30, strict: bool = True) -> Timing:
    """Four curves a strategy: entry and exit, later and, in hindsight, earlier."""
    if mode not in timing.MODES or not timing._is_int(max_k) or max_k < 1:
        raise ValueError(f"mode must be one of {timing.MODES} and max_k an int >= 1")
    joined, checks = checked(trades, bars, summary, settings, min_trades, strict)
    pv = T.point_values(joined).select("strategy_id", "point_value")
    valued = cut(joined.join(pv, "strategy_id"))
    tag = lambda d, leg, early: d.withColumns({"leg": F.lit(leg), "shift": F.lit("earlier" if early else "later")})
    curves, firsts, paired = [], [], []
    for leg in timing.LEGS:
        for early in (False, True):
            points = cut(timing.shifted(valued, bars, leg, mode, max_k, early, F.col("point_value")))
            curve = timing.delay_curve(points)
            curves.append(tag(curve, leg, early))
            firsts.append(tag(timing.first_nonpositive(curve), leg, early))
            paired.append(tag(timing.paired_change(points), leg, early))
    union = lambda ds: ds[0].union(ds[1]).union(ds[2]).union(ds[3])
    at_open = valued.groupBy("strategy_id").agg(F.avg(T.isclose(F.col("entry_price"), F.col("entry_open")).cast("double")).alias("at_open_share"))
    return Timing(checks, _meta(valued, bars, pv), union(curves), union(firsts), union(paired), at_open)
