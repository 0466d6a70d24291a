"""Equity, drawdown episodes, capital and ranking ratios. Equity runs in the order of exits, ties in the order of trades.

Nothing is ordered within a whole key: one strategy may hold most of all trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.scan import carry, ranged, ranked, within

ORDER = ("exit_time", "trade_id")


def equity(pnl: DataFrame, keys: tuple[str, ...] = ("strategy_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """pnl (keys, order, pnl) with seq from 0, the running sum eq, and dd: eq below the highest it was, flat start included.

    A key's rows are scanned in ranges: sums and highest points of earlier ranges are carried into each (`part`)."""
    run = within(keys, order)
    e = ranged(pnl, keys, order)
    e = carry(e, keys, before={"rows__": (F.count("*"), F.sum), "sum__": (F.sum("pnl"), F.sum)})
    e = e.withColumns({"seq": F.coalesce("rows__", F.lit(0)) + F.count("*").over(run) - 1, "eq": F.coalesce("sum__", F.lit(0.0)) + F.coalesce(F.sum("pnl").over(run), F.lit(0.0))})
    e = carry(e, keys, before={"top__": (F.max("eq"), F.max)})
    e = e.withColumn("dd", F.col("eq") - F.greatest(F.lit(0.0), F.max("eq").over(run), "top__"))
    return e.drop("rows__", "sum__", "top__")


def episodes(eq: DataFrame, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """(keys, peak_i, trough_i, recovery_i, depth): runs below the peak; peak_i is -1 at the flat start, recovery_i NULL if none.

    Gaps and islands: rows below the peak carry the last row at it, which is peak_i itself. eq: from `equity`.
    """
    at_peak = F.when(F.col("dd") >= 0, F.col("seq"))
    e = carry(eq, keys, before={"peak__": (F.max(at_peak), F.max)}, whole={"end__": (F.max("seq"), F.max)})
    e = e.withColumn("peak_i", F.coalesce(F.max(at_peak).over(within(keys, ("seq",))), "peak__", F.lit(-1)))
    runs = e.where("dd < 0").groupBy(*keys, "peak_i").agg(F.max("seq").alias("last"), F.min_by("seq", F.struct("dd", "seq")).alias("trough_i"), F.min("dd").alias("depth"), F.max("end__").alias("end"))
    return runs.select(*keys, "peak_i", "trough_i", F.when(F.col("last") < F.col("end"), F.col("last") + 1).alias("recovery_i"), "depth")


def episode_times(eps: DataFrame, eq: DataFrame, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """Episodes with their times and durations in whole days; the flat start counts from the first entry."""
    at = eq.select(*keys, "seq", "exit_time")
    start = eq.groupBy(*keys).agg(F.min("entry_time").alias("first_entry"))
    out = eps.join(start, list(keys))
    for p in ("peak", "trough", "recovery"):
        out = out.join(at.withColumnsRenamed({"seq": f"{p}_i", "exit_time": f"{p}_time"}), [*keys, f"{p}_i"], "left")
    out = out.withColumn("peak_time", F.coalesce("peak_time", "first_entry"))
    days = lambda b: F.timestamp_diff("DAY", F.col("peak_time"), F.col(b))
    return out.withColumns({"peak_trough_days": days("trough_time"), "peak_recovery_days": days("recovery_time")}).drop("first_entry")


def by_depth(eps: DataFrame, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """Episodes with rank from 0, the deepest first, and n, the key's episodes."""
    return ranked(eps, keys, ("depth", "peak_i"))


def cdar(eps: DataFrame, beta: float = 0.8, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """(keys, cdar): the mean depth of the worst max(1, ceil((1 - beta) n)) episodes. eps: with rank and n, or without."""
    r = eps if "rank" in eps.columns else by_depth(eps, keys)
    return r.where(F.col("rank") < F.greatest(F.lit(1), F.ceil((1.0 - beta) * F.col("n")))).groupBy(*keys).agg(F.avg(-F.col("depth")).alias("cdar"))


def sharpe_sortino(pnl: DataFrame, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """(keys, n_trades, years, sum_usd, sharpe, sortino), by trade, for a year's trades; 0 where nothing varies, or nothing is lost."""
    years = F.greatest(F.timestamp_diff("DAY", F.min("entry_time"), F.max("exit_time")), F.lit(1)) / 365.25
    a = pnl.groupBy(*keys).agg(F.count("*").alias("n_trades"), years.alias("years"), F.sum("pnl").alias("sum_usd"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), 2))).alias("d"))
    scale = F.sqrt(F.col("n_trades") / F.col("years"))
    ratio = lambda x: F.coalesce(F.try_divide("m", x) * scale, F.lit(0.0))
    return a.select(*keys, "n_trades", "years", "sum_usd", ratio("s").alias("sharpe"), ratio("d").alias("sortino"))


def drawdown_summary(pnl: DataFrame, capital_mult: float = 5.0, beta: float = 0.8, capital: float | None = None, keys: tuple[str, ...] = ("strategy_id",)) -> DataFrame:
    """A row a key with depths, durations, capital and all ratios; ratios over nothing are NULL."""
    if capital is not None and not capital > 0:
        raise ValueError("capital must be > 0")
    eq = equity(pnl, keys)
    eps = by_depth(episode_times(episodes(eq, keys), eq, keys), keys)
    depth = -F.col("depth")
    middle = F.col("rank").between(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))
    e = eps.groupBy(*keys).agg(
        F.count("*").alias("n_episodes"), F.count_if(F.col("recovery_i").isNull()).alias("n_unrecovered"), F.max(depth).alias("max_dd"), F.avg(depth).alias("mean_dd"), F.avg(F.when(middle, depth)).alias("median_dd"),
        F.avg("peak_trough_days").alias("pt_mean"), F.max("peak_trough_days").alias("pt_max"), F.avg("peak_recovery_days").alias("pr_mean"), F.max("peak_recovery_days").alias("pr_max"),
        F.min_by(F.struct("peak_time", "trough_time", "recovery_time"), F.struct("depth", "peak_i")).alias("worst"),
    )
    a = sharpe_sortino(pnl, keys).join(e, list(keys), "left").join(cdar(eps, beta, keys), list(keys), "left")
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("max_dd", "mean_dd", "median_dd", "cdar", "pt_mean", "pt_max", "pr_mean", "pr_max")}
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_episodes", "n_unrecovered")}
    a = a.withColumns(zero | counts).withColumns({"annual_usd": F.col("sum_usd") / F.col("years"), "capital_cdar": capital_mult * F.col("cdar")})
    a = a.withColumns({"capital": F.lit(float(capital)) if capital else F.col("capital_cdar"), "capital_basis": F.lit("fixed" if capital else f"{capital_mult:g} x CDaR-{100 * beta:g}")})
    over = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return a.withColumns({"annual_pct": over("annual_usd", "capital"), "max_dd_pct": over("max_dd", "capital"), "calmar": over("annual_usd", "max_dd"), "profit_over_avg_dd": over("annual_usd", "mean_dd"), "profit_over_cdar": over("annual_usd", "cdar")})


def margin_ratios(capital: Column, margin: Column) -> dict[str, Column]:
    return {"margin_to_equity": F.try_divide(margin, capital), "contracts_covered": F.try_divide(capital, margin)}
