"""How much cost an edge can bear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.scalars import with_round_trip
from evidex.operators.trades import usd_per_contract

MULTIPLIERS = (0, 1, 2, 3, 5, 10, 20)


def cost_per_strategy(joined: DataFrame) -> DataFrame:
    """(strategy_id, cost, source, report_cost): the reference cost of the symbol, else the report's own mean cost."""
    own = joined.groupBy("strategy_id", "symbol").agg(F.avg(2 * (F.col("comm_side") + F.col("slip_side"))).alias("report_cost"))
    return with_round_trip(own).select("strategy_id", F.coalesce("reference_cost", "report_cost").alias("cost"), F.when(F.col("reference_cost").isNull(), "report").otherwise("reference").alias("source"), "report_cost")


def cost_curve(based: DataFrame, costs: DataFrame, point_value=2.0, multipliers=MULTIPLIERS) -> DataFrame:
    """(strategy_id, mult, net_mean_usd, net_lift_usd, passes) for every multiple of the cost."""
    v = F.lit(point_value) if not hasattr(point_value, "alias") else point_value
    a = based.groupBy("strategy_id").agg(F.avg(usd_per_contract(v)).alias("gross"), F.avg(F.col("base_mean") * F.col("entry_price") * v).alias("base"))
    a = a.join(costs, "strategy_id").withColumn("mult", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))))
    net = F.col("gross") - F.col("mult") * F.col("cost")
    return a.select("strategy_id", "mult", net.alias("net_mean_usd"), (net - F.col("base")).alias("net_lift_usd"), (net - F.col("base") > 0).alias("passes"))


def cost_summary(based: DataFrame, costs: DataFrame, point_value=2.0) -> DataFrame:
    """(strategy_id, gross_mean_usd, baseline_mean_usd, breakeven_mult, net_pf_1x, passed_1x); infinite without cost, or without losses."""
    v = F.lit(point_value) if not hasattr(point_value, "alias") else point_value
    net = usd_per_contract(v) - F.col("cost")
    a = based.join(costs, "strategy_id").groupBy("strategy_id").agg(
        F.avg(usd_per_contract(v)).alias("gross_mean_usd"), F.avg(F.col("base_mean") * F.col("entry_price") * v).alias("baseline_mean_usd"), F.first("cost").alias("cost"), F.sum(F.greatest(net, F.lit(0.0))).alias("won"), F.sum(F.greatest(-net, F.lit(0.0))).alias("lost")
    )
    edge = F.col("gross_mean_usd") - F.col("baseline_mean_usd")
    return a.select("strategy_id", "gross_mean_usd", "baseline_mean_usd", F.coalesce(F.when(F.col("cost") > 0, edge / F.col("cost")), F.lit(float("inf"))).alias("breakeven_mult"), F.coalesce(F.when(F.col("lost") > 0, F.col("won") / F.col("lost")), F.lit(float("inf"))).alias("net_pf_1x"), (edge - F.col("cost") > 0).alias("passed_1x"))
