"""Bars, trades and an optimisation grid from the driver's tables.

bars: hourly buckets of `events`. trades: its purchases, by integer rules. The grid: `lineitem` by discount and tax over
ship dates. Everything is keyed by strategy, symbol or project, so that many run as one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT_VALUE, COMMISSION, SLIPPAGE = 2.0, 2.2, 0.5


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, bar_idx, ts, open, high, low, close, volume)."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    b = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    b = b.withColumn("symbol", F.lit("@ES"))
    return b.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("hour")) - 1).cast("bigint").alias("bar_idx"), F.col("hour").alias("ts"), "open", "high", "low", "close", "volume")


hourly_bars = bars


def trades(spark: SparkSession, sf: str, astray: bool = False, bars: DataFrame | None = None) -> DataFrame:
    """Round trips with times and fills; astray moves some entries off the bars' clock. bars: where they are built already."""
    b = hourly_bars(spark, sf) if bars is None else bars
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    t = e.join(b.select("symbol", F.col("bar_idx").alias("e_idx"), F.col("ts").alias("entry_time"), F.col("open").alias("entry_price")), F.col("hour") == F.col("entry_time"))
    t = t.withColumn("x_idx", F.col("e_idx") + 1 + F.col("event_id") % 24)
    t = t.join(b.select(F.col("symbol").alias("s_"), F.col("bar_idx").alias("b_"), F.col("ts").alias("exit_time"), F.col("open").alias("exit_price")), (F.col("symbol") == F.col("s_")) & (F.col("x_idx") == F.col("b_")))
    direction = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    gross = F.round(POINT_VALUE * direction * (F.col("exit_price") - F.col("entry_price")) * (1 + F.col("event_id") % 3), 2)
    entry = F.when((F.col("event_id") % 97 == 0) & F.lit(astray), F.col("entry_time") + F.expr("INTERVAL 7 MINUTES")).otherwise(F.col("entry_time"))
    return t.select(
        (F.col("user_id") % 8).alias("strategy_id"), F.col("event_id").alias("trade_id"), "symbol", direction.alias("direction"), entry.alias("entry_time"), "exit_time", "entry_price", "exit_price",
        (1 + F.col("event_id") % 3).cast("int").alias("contracts"), gross.alias("gross_pnl"), F.round(gross - 2 * (COMMISSION + SLIPPAGE), 2).alias("net_pnl"), F.lit(COMMISSION).alias("comm_side"), F.lit(SLIPPAGE).alias("slip_side"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linenumber", "l_extendedprice")
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(2 * (F.col("l_linenumber") % 2) - 1)
    return li.select(F.lit("P1").alias("project"), F.round(F.col("l_discount") * 100).cast("int").alias("a"), F.round(F.col("l_tax") * 100).cast("int").alias("b"), F.col("l_shipdate").cast("date").alias("date"), (sign * F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).alias("pnl"))


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(project, a, b, date, pnl, n): a row for each combination and day with trades; the one pass over lineitem."""
    return _lines(spark, sf).groupBy("project", "a", "b", "date").agg(F.round(F.sum("pnl"), 6).alias("pnl"), F.count("*").alias("n"))


def combos(cells: DataFrame) -> DataFrame:
    """(project, combo_id, params, pos): every parameter combination; the first parameter varies fastest."""
    d = cells.select("project", "a", "b").distinct()
    at = lambda *c: Window.partitionBy("project").orderBy(*c)
    pos = F.array((F.dense_rank().over(at("a")) - 1).cast("int"), (F.dense_rank().over(at("b")) - 1).cast("int"))
    return d.select("project", (F.row_number().over(at("b", "a")) - 1).cast("int").alias("combo_id"), F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("params"), pos.alias("pos"))


def days(cells: DataFrame) -> DataFrame:
    """(project, day_idx, date)."""
    d = cells.select("project", "date").distinct()
    return d.select("project", (F.row_number().over(Window.partitionBy("project").orderBy("date")) - 1).cast("int").alias("day_idx"), "date")


def _ids(combos: DataFrame) -> DataFrame:
    return combos.select("project", "combo_id", F.col("params")[0].cast("int").alias("a"), F.col("params")[1].cast("int").alias("b"))


def grid_daily(cells: DataFrame, combos: DataFrame, days: DataFrame) -> DataFrame:
    """(project, combo_id, day_idx, date, pnl), a row for every combination and day."""
    every = _ids(combos).join(days, "project")
    return every.join(cells.drop("n"), ["project", "a", "b", "date"], "left").select("project", "combo_id", "day_idx", "date", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def grid_exits(cells: DataFrame, combos: DataFrame) -> DataFrame:
    """(project, combo_id, date, n): closed trades."""
    return cells.join(_ids(combos), ["project", "a", "b"]).select("project", "combo_id", "date", "n")
