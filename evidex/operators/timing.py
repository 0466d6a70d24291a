"""What is left of the return when entries or exits are acted on k bars late, or, in hindsight, early."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEGS, MODES = ("entry", "exit"), ("fixed_exit", "fixed_hold")


def _is_int(k) -> bool:
    return isinstance(k, int) and not isinstance(k, bool)


def shifted(joined: DataFrame, bars: DataFrame, leg: str, mode: str = "fixed_exit", max_k: int = 10, early: bool = False, point_value=2.0) -> DataFrame:
    """(strategy_id, trade_id, k, alive, pct, usd) for k = 0..max_k; pct and usd are NULL where the trade no longer fits.

    k = 0 is the trade as reported. A moved leg fills at the open of the bar it moves to. One join on the bar number per
    moved leg, over all k at once.
    """
    if leg not in LEGS or mode not in MODES:
        raise ValueError(f"leg must be one of {LEGS} and mode one of {MODES}")
    if not _is_int(max_k) or max_k < 1:
        raise ValueError(f"max_k must be an int >= 1, got {max_k!r}")
    v = point_value if hasattr(point_value, "alias") else F.lit(point_value)
    step = F.col("k") * (-1 if early else 1)
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("last_idx"))
    t = joined.select("strategy_id", "symbol", "trade_id", "direction", "entry_idx", "exit_idx", "entry_price", "exit_price", v.alias("pv")).join(last, "symbol")
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_k))))
    e, x, k = F.col("entry_idx"), F.col("exit_idx"), F.col("k")
    if leg == "exit":
        moves, alive = ("exit",), (x - k > e) if early else (x + k <= F.col("last_idx"))
    elif mode == "fixed_exit":
        moves, alive = ("entry",), (e - k >= 0) if early else (e + k < x)
    else:
        moves, alive = ("entry", "exit"), (e - k >= 0) if early else (x + k <= F.col("last_idx"))
    t = t.withColumn("alive", (k == 0) | alive)
    for side in moves:
        t = t.withColumn("at_", F.when(F.col("alive") & (k > 0), F.col(f"{side}_idx") + step))
        b = bars.select(F.col("symbol").alias("s_"), F.col("bar_idx").alias("b_"), F.col("open").alias("o_"))
        t = t.join(b, (F.col("symbol") == F.col("s_")) & (F.col("at_") == F.col("b_")), "left")
        t = t.withColumn(f"{side}_price", F.when(k == 0, F.col(f"{side}_price")).otherwise(F.col("o_"))).drop("s_", "b_", "o_", "at_")
    d, ep, xp = F.col("direction"), F.col("entry_price"), F.col("exit_price")
    return t.select("strategy_id", "trade_id", "k", "alive", F.when(F.col("alive"), d * (F.try_divide(xp, ep) - 1.0)).alias("pct"), F.when(F.col("alive"), d * (xp - ep) * F.col("pv")).alias("usd"))


def delay_curve(points: DataFrame) -> DataFrame:
    """(strategy_id, k, n_alive, n_skipped, total_usd, mean_usd, mean_pct, win_rate, profit_factor, retention).

    Means are NULL where no trade is left; the profit factor is infinite with wins and no losses; retention is NULL
    where the total as reported isn't positive.
    """
    u = F.col("usd")
    wins, losses = F.sum(F.when(u > 0, u).otherwise(0.0)), F.sum(F.when(u < 0, -u).otherwise(0.0))
    a = points.groupBy("strategy_id", "k").agg(
        F.count_if("alive").alias("n_alive"), F.count_if(~F.col("alive")).alias("n_skipped"), F.coalesce(F.sum(u), F.lit(0.0)).alias("total_usd"), F.avg(u).alias("mean_usd"), F.avg("pct").alias("mean_pct"), F.avg((u > 0).cast("double")).alias("win_rate"),
        F.when(losses > 0, F.try_divide(wins, losses)).when(wins > 0, F.lit(float("inf"))).alias("profit_factor"),
    )
    base = a.where("k = 0").select("strategy_id", F.col("total_usd").alias("base_usd"))
    return a.join(base, "strategy_id").withColumn("retention", F.when(F.col("base_usd") > 0, F.try_divide("total_usd", "base_usd"))).drop("base_usd")


def first_nonpositive(curve: DataFrame) -> DataFrame:
    """(strategy_id, first_k): the least k from 1 with trades left and nothing earned; NULL if none."""
    return curve.groupBy("strategy_id").agg(F.min(F.when((F.col("k") > 0) & (F.col("n_alive") > 0) & (F.col("total_usd") <= 0), F.col("k"))).alias("first_k"))


def paired_change(points: DataFrame) -> DataFrame:
    """(strategy_id, k, mean_change, n): the mean change against the report of the trades that still fit at k; NULL and 0 if none."""
    base = points.where("k = 0").select("strategy_id", "trade_id", F.col("usd").alias("usd0"))
    return points.join(base, ["strategy_id", "trade_id"]).groupBy("strategy_id", "k").agg(F.avg(F.col("usd") - F.col("usd0")).alias("mean_change"), F.count("usd").alias("n"))
