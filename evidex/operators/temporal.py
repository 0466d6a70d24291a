"""Windows of time and regimes of volatility, each against its own drift, and calendar years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.trades import pct_return, usd_per_contract, with_baseline


def bar_windows(bars: DataFrame, n: int = 4) -> DataFrame:
    """(symbol, bar_idx, window): the bars in n runs of equal length, the first ones longer by a bar where it doesn't divide."""
    return bars.select("symbol", "bar_idx", F.ntile(n).over(Window.partitionBy("symbol").orderBy("bar_idx")).alias("window"))


def volatility(bars: DataFrame, length: int = 20) -> DataFrame:
    """(symbol, bar_idx, vol): rolling sample deviation of close-to-close returns; NULL until there are two returns."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    r = bars.select("symbol", "bar_idx", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("r"))
    return r.select("symbol", "bar_idx", F.stddev_samp("r").over(w.rowsBetween(1 - length, 0)).alias("vol"))


def crisis_bars(bars: DataFrame, q: float = 0.9) -> DataFrame:
    """(symbol, bar_idx, crisis, q_vol): whether volatility reaches its q quantile over the series."""
    v = volatility(bars)
    cut = v.groupBy("symbol").agg(F.percentile("vol", q).alias("q_vol"))
    return v.join(cut, "symbol").select("symbol", "bar_idx", F.coalesce(F.col("vol") >= F.col("q_vol"), F.lit(False)).alias("crisis"), "q_vol")


def _subset(joined: DataFrame, bars: DataFrame, mask: DataFrame, key: str, point_value, min_n: int) -> DataFrame:
    entered = mask.select(F.col("symbol"), F.col("bar_idx").alias("entry_idx"), key)
    t = with_baseline(joined.join(entered, ["symbol", "entry_idx"]), bars, mask)
    r, enough = pct_return(), F.count("*") >= min_n
    a = t.groupBy("strategy_id", key).agg(
        F.count("*").alias("n"), F.when(enough, F.avg(r)).alias("mean"), F.when(enough, F.avg("base_mean")).alias("baseline"), F.when(enough, F.avg((r > 0).cast("double"))).alias("win_rate"), F.sum(usd_per_contract(point_value)).alias("usd_sum"), enough.alias("counted")
    )
    return a.withColumn("lift", F.col("mean") - F.col("baseline"))


def window_results(joined: DataFrame, bars: DataFrame, point_value=2.0, n_windows: int = 4, min_n: int = 10) -> DataFrame:
    """(strategy_id, window, start, end, n, mean, baseline, win_rate, lift, usd_sum, counted), windows without trades included."""
    w = bar_windows(bars, n_windows)
    spans = w.join(bars.select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"]).groupBy("symbol", "window").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    every = joined.select("strategy_id", "symbol").distinct().join(spans, "symbol").drop("symbol")
    r = every.join(_subset(joined, bars, w, "window", point_value, min_n), ["strategy_id", "window"], "left")
    return r.withColumns({"n": F.coalesce("n", F.lit(0)).cast("bigint"), "usd_sum": F.coalesce("usd_sum", F.lit(0.0)), "counted": F.coalesce("counted", F.lit(False))})


def window_score(windows: DataFrame) -> DataFrame:
    """(strategy_id, windows_positive, windows_total, score): positive lifts among counted windows."""
    a = windows.groupBy("strategy_id").agg(F.count_if(F.col("counted") & (F.col("lift") > 0)).alias("windows_positive"), F.count_if("counted").alias("windows_total"))
    return a.withColumn("score", F.coalesce(F.try_divide("windows_positive", "windows_total"), F.lit(0.0)))


def regime_results(joined: DataFrame, bars: DataFrame, point_value=2.0, min_n: int = 10) -> DataFrame:
    """(strategy_id, crisis, n, mean, baseline, lift), each regime against its own bars."""
    return _subset(joined, bars, crisis_bars(bars).drop("q_vol"), "crisis", point_value, min_n).select("strategy_id", "crisis", "n", "mean", "baseline", "lift")


def yearly(joined: DataFrame, point_value=2.0) -> DataFrame:
    """(strategy_id, year, usd, n) by year of exit."""
    return joined.groupBy("strategy_id", F.year("exit_time").alias("year")).agg(F.sum(usd_per_contract(point_value)).alias("usd"), F.count("*").alias("n"))
