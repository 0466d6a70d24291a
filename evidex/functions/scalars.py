"""Scalar functions of report cells, labels and names, and the table of reference costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars per side and contract, (commission, slippage), by symbol root.
COSTS = {
    "AD": (2.5, 12.5), "BO": (2.5, 10.0), "BP": (2.5, 10.0), "BRN": (2.5, 15.0), "BTC": (2.5, 250.0),
    "C": (2.5, 12.5), "CC": (2.5, 15.0), "CD": (2.5, 12.5), "CL": (2.5, 15.0), "CT": (2.5, 20.0),
    "DA": (2.5, 80.0), "DX": (2.5, 10.0), "EC": (2.5, 15.0), "EMD": (2.5, 25.0), "ES": (2.5, 12.5),
    "FC": (2.5, 45.0), "FDAX": (2.5, 25.0), "FDXM": (2.5, 10.0), "FESX": (2.5, 10.0), "FGBL": (2.5, 10.0),
    "FGBM": (2.5, 10.0), "FGBS": (2.5, 5.0), "FGBX": (2.5, 30.0), "FSTB": (2.5, 5.0), "FSTU": (2.5, 15.0),
    "FV": (2.5, 10.0), "GC": (2.5, 30.0), "HG": (2.5, 17.5), "HO": (2.5, 32.5), "JY": (2.5, 15.0),
    "KC": (2.5, 35.0), "KW": (2.5, 17.5), "LB": (2.5, 250.0), "LC": (2.5, 20.0), "LH": (2.5, 30.0),
    "MP1": (2.5, 12.5), "NE1": (2.5, 10.0), "NG": (2.5, 17.5), "NK": (2.5, 30.0), "NQ": (2.5, 15.0),
    "O": (2.5, 50.0), "OJ": (2.5, 75.0), "PA": (2.5, 250.0), "PL": (2.5, 25.0), "RB": (2.5, 37.5),
    "RR": (2.5, 50.0), "RTY": (2.5, 20.0), "S": (2.5, 15.0), "SB": (2.5, 12.5), "SF": (2.5, 17.5),
    "SI": (2.5, 32.5), "SM": (2.5, 15.0), "TF": (2.5, 20.0), "TU": (2.5, 10.0), "TY": (2.5, 17.5),
    "US": (2.5, 32.5), "VX": (2.5, 50.0), "W": (2.5, 15.0), "YM": (2.5, 10.0),
    "MES": (0.62, 1.875), "MNQ": (0.62, 2.25), "M2K": (0.62, 3.0), "MYM": (0.62, 1.5), "MBT": (0.62, 7.5),
    "MET": (0.62, 0.375), "E7": (0.62, 11.25), "M6E": (0.62, 2.25), "J7": (0.62, 11.25), "M6B": (0.62, 1.5),
    "M6A": (0.62, 1.875), "MGC": (0.62, 4.5), "SIL": (0.62, 9.75), "MHG": (0.62, 2.625), "QM": (0.62, 11.25),
    "MCL": (0.62, 2.25), "QN": (0.62, 6.5625), "YW": (0.62, 4.5), "YC": (0.62, 3.75), "YK": (0.62, 4.5),
}
#: Fragments and whole words of parameter names.
SCALE_FREE = ("pct", "percent", "bar", "len", "period", "lookback", "atr", "mult", "ratio", "factor", "day", "hold", "rsi", "ema", "sma", "adx", "time", "thresh")
SCALE_FREE_WORDS = ("fac",)
PRICE = ("amt", "amount", "dollar", "usd", "$", "pts", "point", "stop", "target", "targ", "tgt", "profit", "dol")
PRICE_WORDS = ("sl", "tp")


def money(s: Column) -> Column:
    """$59.10 is 59.1, ($123.40) is -123.4, -0.34% is -0.34; empty, n/a and other text are NULL."""
    t = F.trim(F.coalesce(s, F.lit("")))
    v = F.expr("1D") * F.regexp_replace(t, r"[()$,%\s]", "").try_cast("double")
    return F.when(F.isnan(v), None).otherwise(F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v))


def stamp(s: Column) -> Column:
    """M/D/YYYY H:MM, or M/D/YYYY at midnight; NULL for anything else."""
    t = F.trim(s)
    return F.coalesce(F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm")), F.try_to_timestamp(t, F.lit("M/d/yyyy"))).cast("timestamp_ntz")


def is_date_only(s: Column) -> Column:
    return F.try_to_timestamp(F.trim(s), F.lit("M/d/yyyy")).isNotNull()


def interval_minutes(s: Column) -> Column:
    """Minutes of a bar interval's label; NULL for tick and volume bars, and where there is none."""
    t = F.lower(F.trim(s))
    n = lambda unit: F.regexp_extract(t, rf"^(\d+)\s*{unit}", 1).try_cast("bigint")
    return F.coalesce(n("min"), n("hour") * 60, F.when(t.startswith("daily"), 1440), F.when(t.startswith("weekly"), 10080)).cast("bigint")


def symbol_root(symbol: Column) -> Column:
    """@ESH25 and ES are ES: without a leading @ and a month code with a two-digit year, in upper case."""
    t = F.upper(F.trim(symbol))
    root = F.regexp_extract(t, r"^@?([A-Z0-9]+?)(?:[FGHJKMNQUVXZ]\d{2})?$", 1)
    return F.when(root != "", root).otherwise(F.ltrim(t, F.lit("@")))


def axis_class(name: Column) -> Column:
    """scale-free (bars, percentages, multiples), price-scaled (dollars, points) or unclassified; scale-free words win."""
    low = F.lower(name)
    words = F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+)"), F.lit(1)), F.lower)
    has = lambda parts: F.greatest(*(low.contains(p) for p in parts))
    word = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    return F.when(has(SCALE_FREE) | word(SCALE_FREE_WORDS), "scale-free").when(has(PRICE) | word(PRICE_WORDS), "price-scaled").otherwise("unclassified")


def cost_table(spark: SparkSession) -> DataFrame:
    """(root, commission, slippage, round_trip): a fixed few rows, safe to broadcast."""
    return spark.createDataFrame([(k, c, s) for k, (c, s) in COSTS.items()], "root string, commission double, slippage double").withColumn("round_trip", F.round(2 * (F.col("commission") + F.col("slippage")), 4))


def with_round_trip(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """df with the reference round-trip cost of its symbol, NULL where the root is unknown."""
    costs = F.broadcast(cost_table(df.sparkSession).select(F.col("root").alias("root_"), F.col("round_trip").alias("reference_cost")))
    return df.join(costs, symbol_root(F.col(symbol)) == F.col("root_"), "left").drop("root_")
