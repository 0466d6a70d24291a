"""Does the in-sample top region beat the grid average out of sample? Lift, overlap, and the nulls of both.

Net profit is linear in days, so a draw of either null needs only the region's mean of each block's deviations: the days
are summed to blocks once, the blocks to one number a window, and draws run over these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.semantics import p_from_counts, uniform
from evidex.operators.grid import WINDOW, neighbours, pool, sides, top_k
from evidex.session import ship, spread

BLOCK = 21
#: Cells of a project that all draws meet under one key.
CELLS = 64
#: Draws whose paths are in memory at once.
DRAWS = 256


def region(pairs: DataFrame, combos: DataFrame) -> DataFrame:
    """pairs with pooled in- and out-of-sample surfaces, place, k and in_region: the k best of the pooled in-sample surface."""
    near = neighbours(combos)
    p = pool(pairs, near, "x").withColumnRenamed("pooled", "x_pooled")
    p = pool(p, near, "y").withColumnRenamed("pooled", "y_pooled")
    return top_k(p, "x_pooled").withColumn("in_region", F.col("place") <= F.col("k"))


def lifts(r: DataFrame) -> DataFrame:
    """(project, window, k, region_oos_mean, grid_oos_mean, oos_sd, lift, oos_positive_share); lift 0 where nothing varies."""
    a = r.groupBy(*WINDOW).agg(F.first("k").alias("k"), F.avg(F.when(F.col("in_region"), F.col("y"))).alias("region_oos_mean"), F.avg("y").alias("grid_oos_mean"), F.stddev_pop("y").alias("oos_sd"), F.avg((F.col("y") > 0).cast("double")).alias("oos_positive_share"))
    return a.withColumn("lift", F.coalesce(F.try_divide(F.col("region_oos_mean") - F.col("grid_oos_mean"), F.col("oos_sd")), F.lit(0.0)))


def distinct_patterns(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, window, n_distinct): different out-of-sample series, to the cent."""
    d = sides(daily, windows).where("side = 'oos'")
    s = d.groupBy(*WINDOW, "combo_id").agg(F.array_sort(F.collect_list(F.struct("day_idx", (F.bround("pnl", 2) + F.lit(0.0)).alias("v")))).alias("s"))
    return s.groupBy(*WINDOW).agg(F.count_distinct(F.col("s.v")).alias("n_distinct"))


def precision(r: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(project, window, precision): the share of the region in the top k of the pooled out-of-sample surface; NULL with fewer than 2k patterns."""
    t = top_k(r.drop("place", "k"), "y_pooled").withColumn("hit", (F.col("in_region") & (F.col("place") <= F.col("k"))).cast("int"))
    a = t.groupBy(*WINDOW).agg(F.sum("hit").alias("hits"), F.first("k").alias("k"))
    if patterns is None:
        return a.select(*WINDOW, (F.col("hits") / F.col("k")).alias("precision"))
    return a.join(patterns, WINDOW).select(*WINDOW, F.when(F.col("n_distinct") >= 2 * F.col("k"), F.col("hits") / F.col("k")).alias("precision"))


def block_sums(daily: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(project, window, combo_id, block, dev, days, common): out-of-sample deviations from the day's grid mean, by blocks of days."""
    if block < 1:
        raise ValueError("block must be at least 1 trading day")
    d = sides(daily, windows).where("side = 'oos'")
    first = windows.select(*WINDOW, F.col("oos_first").alias("f_"))
    d = d.join(first, WINDOW).withColumn("block", F.floor((F.col("day_idx") - F.col("f_")) / block).cast("int"))
    mean = d.groupBy(*WINDOW, "day_idx").agg(F.avg("pnl").alias("m"))
    return d.join(mean, [*WINDOW, "day_idx"]).groupBy(*WINDOW, "combo_id", "block").agg(F.sum(F.col("pnl") - F.col("m")).alias("dev"), F.count("*").alias("days"), F.sum("m").alias("common"))


def centred(blocks: DataFrame) -> DataFrame:
    """blocks with `dev` centred: each combination's mean daily deviation is taken off every day."""
    w = Window.partitionBy(*WINDOW, "combo_id")
    return blocks.withColumn("dev", F.col("dev") - F.try_divide(F.sum("dev").over(w), F.sum("days").over(w)) * F.col("days"))


def named() -> list[Column]:
    """What names a window's draws: projects draw apart."""
    return [F.col("project"), F.col("window")]


def signs(windows: DataFrame, n_blocks: DataFrame, n_null: int, seed: int = 0, draw=uniform) -> DataFrame:
    """(project, window, draw, block, weight): a sign for each block of each draw."""
    d = spread(n_blocks.select(*WINDOW, "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(n_null - 1))).alias("draw")), *WINDOW, "draw")
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return d.select(*WINDOW, "draw", "block", F.when(draw(seed, "flip", *named(), F.col("draw"), F.col("block")) < 0.5, -1.0).otherwise(1.0).alias("weight"))


def picks(n_blocks: DataFrame, n_null: int, seed: int = 0, draw=uniform) -> DataFrame:
    """(project, window, draw, block, weight): how often a draw with replacement picks each block."""
    d = spread(n_blocks.select(*WINDOW, "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(n_null - 1))).alias("draw")), *WINDOW, "draw")
    u = lambda at: draw(seed, "boot", *named(), F.col("draw"), at)
    picked = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda at: F.least(F.floor(u(at) * F.col("n_blocks")).cast("int"), F.col("n_blocks") - 1))
    d = d.select(*WINDOW, "draw", "n_blocks", picked.alias("picked"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return d.select(*WINDOW, "draw", "block", F.size(F.filter("picked", lambda x: x == F.col("block"))).cast("double").alias("weight"))


def n_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*WINDOW).agg((F.max("block") + 1).alias("n_blocks"))


def lift_draws(r: DataFrame, blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """(project, window, draw, null_lift): the lift of every draw, in units of the observed deviation."""
    inside = r.where("in_region").select(*WINDOW, "combo_id")
    by_block = blocks.join(inside, [*WINDOW, "combo_id"]).groupBy(*WINDOW, "block").agg(F.avg("dev").alias("d"))
    sd = lifts(r).select(*WINDOW, "oos_sd")
    n = weights.join(by_block, [*WINDOW, "block"]).groupBy(*WINDOW, "draw").agg(F.sum(F.col("weight") * F.col("d")).alias("s"))
    return n.join(sd, WINDOW).select(*WINDOW, "draw", F.coalesce(F.try_divide("s", "oos_sd"), F.lit(0.0)).alias("null_lift"))


def cell_blocks(draws: DataFrame, cells: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Draws (project, window, draw, ..), once for each block of cells of their window, and cells (project, window, combo_id, ..)
    with their block, as `cells_`: a key under which all draws meet one block, so that tasks grow with a project's cells."""
    size = size or CELLS
    last = cells.groupBy(*WINDOW).agg(F.floor(F.max("combo_id") / size).cast("int").alias("last_"))
    d = spread(draws.join(last, WINDOW), *WINDOW, "draw").withColumn("cells_", F.explode(F.sequence(F.lit(0), F.col("last_")))).drop("last_")
    return d, cells.withColumn("cells_", F.floor(F.col("combo_id") / size).cast("int"))


def by_cell_blocks(draws: DataFrame, cells: DataFrame, size: int | None = None) -> DataFrame:
    """Every draw beside every cell of its window."""
    d, c = cell_blocks(draws, cells, size)
    return d.join(c, [*WINDOW, "cells_"]).drop("cells_")


def weight_arrays(weights: DataFrame) -> DataFrame:
    """(project, window, draw, w): a draw's weights by block."""
    return weights.groupBy(*WINDOW, "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "weight"))), lambda x: x["weight"]).alias("w"))


def surface_draws(blocks: DataFrame, weights: DataFrame, size: int | None = None) -> DataFrame:
    """(project, window, draw, combo_id, y): whole out-of-sample net profit surfaces under a null.

    A draw's weights and a combination's deviations are arrays by block, so a value is one product of arrays."""
    n = n_blocks(blocks)
    dev = blocks.groupBy(*WINDOW, "combo_id").agg(F.sum("common").alias("c"), F.map_from_entries(F.collect_list(F.struct("block", "dev"))).alias("dev")).join(n, WINDOW)
    dev = dev.select(*WINDOW, "combo_id", "c", F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.coalesce(F.try_element_at("dev", b), F.lit(0.0))).alias("dev"))
    s = F.aggregate(F.zip_with("w", "dev", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return by_cell_blocks(weight_arrays(weights), dev, size).select(*WINDOW, "draw", "combo_id", (F.col("c") + s).alias("y"))


def path_metric(m: np.ndarray, dev: np.ndarray, block: np.ndarray, weights: np.ndarray, metric: str) -> np.ndarray:
    """The metric of one combination's path for each draw; NaN where it has none. m, dev and block by day, weights by draw and block."""
    out = np.empty(len(weights))
    for at in range(0, len(weights), DRAWS):
        path = np.cumsum(m + weights[at : at + DRAWS, block] * dev, axis=1)
        out[at : at + DRAWS] = path[:, -1]
        if metric != "NP":
            top = np.maximum(np.maximum.accumulate(path, axis=1), 0.0)
            dd = (path - top).mean(axis=1)
            out[at : at + DRAWS] = np.divide(path[:, -1], -dd, out=np.full(len(dd), np.nan), where=dd < 0)
    return out


def path_draws(daily: DataFrame, windows: DataFrame, weights: DataFrame, metric: str = "NPAvgDD", block: int = BLOCK, size: int | None = None) -> DataFrame:
    """(project, window, draw, combo_id, y): surfaces of a path metric under sign flips, NULL where a path is never below its peak.

    A combination's days are one array of the grid's mean and the deviation from it; a draw gives each block of days its
    sign. All draws and one block of cells at a time, paths are rebuilt and folded as NumPy arrays: a value for each draw and
    cell leaves the task, no day does. (As a fold in SQL functions the same takes 200 times as long.)
    """
    ship(daily.sparkSession)
    d = sides(daily, windows).where("side = 'oos'").join(windows.select(*WINDOW, F.col("oos_first").alias("f_")), WINDOW)
    mean = d.groupBy(*WINDOW, "day_idx").agg(F.avg("pnl").alias("m"))
    d = d.join(mean, [*WINDOW, "day_idx"]).withColumn("block", F.floor((F.col("day_idx") - F.col("f_")) / block).cast("int"))
    day = F.struct("day_idx", "block", "m", (F.col("pnl") - F.col("m")).alias("dev"))
    cells = d.groupBy(*WINDOW, "combo_id").agg(F.array_sort(F.collect_list(day)).alias("days"))
    cells = cells.select(*WINDOW, "combo_id", "days.block", "days.m", "days.dev")
    draws, cells = cell_blocks(weight_arrays(weights), cells, size)

    def values(key: tuple[pa.Scalar, ...], some: pa.Table, cell: pa.Table) -> pa.Table:
        n, ids = some.column("draw").to_numpy(), cell.column("combo_id").to_numpy()
        w = np.array(some.column("w").to_pylist(), float) if len(n) else np.empty((0, 0))
        y = [path_metric(*(np.array(r[c]) for c in ("m", "dev", "block")), w, metric) for r in cell.select(["m", "dev", "block"]).to_pylist()] if len(n) else []
        y = np.concatenate(y) if y else np.empty(0)
        rows = len(y)
        return pa.table([pa.array([key[0].as_py()] * rows, pa.string()), pa.array([key[1].as_py()] * rows, pa.int32()), pa.array(np.tile(n, len(ids))[:rows], pa.int32()), pa.array(np.repeat(ids, len(n))[:rows], pa.int32()), pa.array(y, pa.float64(), mask=np.isnan(y))], ["project", "window", "draw", "combo_id", "y"])

    by = [*WINDOW, "cells_"]
    cells = cells.select(*(F.col(c).alias(f"{c}_") for c in by), "combo_id", "block", "m", "dev")
    return draws.groupBy(*by).cogroup(cells.groupBy(*(f"{c}_" for c in by))).applyInArrow(values, "project string, window int, draw int, combo_id int, y double")


def precision_draws(r: DataFrame, draws: DataFrame, combos: DataFrame) -> DataFrame:
    """(project, window, draw, null_precision): pooled, ranked and compared with the region, draw by draw."""
    keys = [*WINDOW, "draw"]
    t = top_k(pool(draws, neighbours(combos), "y", keys), "pooled", keys)
    t = t.join(r.select(*WINDOW, "combo_id", "in_region"), [*WINDOW, "combo_id"])
    return t.groupBy(*keys).agg((F.sum((F.col("in_region") & (F.col("place") <= F.col("k"))).cast("int")) / F.first("k")).alias("null_precision"))


def window_p(draws: DataFrame, observed: DataFrame, null: str, stat: str) -> DataFrame:
    """(project, window, stat, p) by (k + 1) / (n + 1)."""
    d = draws.join(observed.select(*WINDOW, stat), WINDOW)
    return d.groupBy(*WINDOW, stat).agg(p_from_counts(F.count_if(F.col(null) >= F.col(stat)), F.count("*")).alias("p"))


def pooled_p(draws: DataFrame, observed: DataFrame, null: str, stat: str) -> DataFrame:
    """(project, stat, p): means over complete windows, nulls averaged draw by draw. observed: with `complete`."""
    o = observed.where(F.col("complete") & F.col(stat).isNotNull())
    mean = o.groupBy("project").agg(F.avg(stat).alias(stat))
    d = draws.join(o.select(*WINDOW), WINDOW).groupBy("project", "draw").agg(F.avg(null).alias("v")).join(mean, "project")
    return d.groupBy("project", stat).agg(p_from_counts(F.count_if(F.col("v") >= F.col(stat)), F.count("*")).alias("p"))


def percent_below(v: Column, value: Column) -> Column:
    """The share of v below value, in percent. An aggregate; value is constant within the group."""
    return F.avg((v < value).cast("double")) * 100


def pick_percentiles(r: DataFrame, picks: DataFrame) -> DataFrame:
    """(project, window, rule, pct): where each pick landed out of sample. picks: (project, window, rule, combo_id)."""
    y = r.select(*WINDOW, F.col("combo_id").alias("c_"), F.col("y").alias("y_"))
    at = picks.join(r.select(*WINDOW, "combo_id", "y"), [*WINDOW, "combo_id"])
    return at.join(y, WINDOW).groupBy(*WINDOW, "rule").agg(percent_below(F.col("y_"), F.col("y")).alias("pct"))


def ridge_overlap(r: DataFrame, ridge_is: DataFrame, ridge_oos: DataFrame, combos: DataFrame) -> DataFrame:
    """(project, window, jaccard, shift): overlap of two ridges (project, window, combo_id), and the distance of their centroids in steps."""
    both = ridge_is.withColumn("i", F.lit(1)).join(ridge_oos.withColumn("o", F.lit(1)), [*WINDOW, "combo_id"], "full")
    j = both.groupBy(*WINDOW).agg(F.try_divide(F.count_if(F.col("i").isNotNull() & F.col("o").isNotNull()), F.count("*")).alias("jaccard"))
    axis = combos.select("project", "combo_id", F.posexplode("pos").alias("axis", "p"))
    c = lambda d, n: d.join(axis, ["project", "combo_id"]).groupBy(*WINDOW, "axis").agg(F.avg("p").alias(n))
    shift = c(ridge_is, "a").join(c(ridge_oos, "b"), [*WINDOW, "axis"]).groupBy(*WINDOW).agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("shift"))
    return j.join(shift, WINDOW, "left")


def reading(p_lift: Column, region_mean: Column, grid_mean: Column, scoreable: Column, alpha: float = 0.05) -> Column:
    """edge, loser, plateau or noise; a NULL p is not significant."""
    hit = F.coalesce(p_lift < alpha, F.lit(False))
    return F.when(~scoreable, "plateau").when(hit & (region_mean > 0), "edge").when(hit, "loser").when(grid_mean > 0, "plateau").otherwise("noise")


def scoreable(n_distinct: Column, k: Column) -> Column:
    return F.coalesce(n_distinct >= 2 * k, F.lit(True))


def gate(r: Column) -> Column:
    return F.when(r == "edge", "pass").when(r.isin("loser", "noise"), "fail").when(r == "plateau", "plateau").otherwise("insufficient")


def nulls_disagree(p_flip: Column, p_boot: Column, alpha: float = 0.05) -> Column:
    return F.coalesce(p_flip < alpha, F.lit(False)) != F.coalesce(p_boot < alpha, F.lit(False))
