"""Connected areas of a surface, their centre, spread members, and the recommended base setting.

A surface is cut into tiles, small groups in which a Pandas function finds areas; areas that touch across tiles are then
joined as rows, so that a surface of any size is many tasks. All else is DataFrame functions.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.grid import WINDOW, neighbours, pool, top_k
from evidex.session import cut, ship

CENTRE_MIN_CELLS, ENSEMBLE_MAX, CELLS_PER_MEMBER, FIVE_BEST, Q_TOP = 3, 4, 3, 5, 0.2
#: Cells of a tile, about; its side is the root of it, by the number of axes.
TILE_CELLS = 4096


def labels(cells: list[tuple[int, ...]]) -> np.ndarray:
    """For each cell, the least index among those it reaches by steps of one on every axis."""
    at: dict[tuple[int, ...], list[int]] = {}
    for i, c in enumerate(cells):
        at.setdefault(c, []).append(i)
    steps = list(product((-1, 0, 1), repeat=len(cells[0]))) if cells else []
    low = np.full(len(cells), -1)
    for i in range(len(cells)):
        reached = [i] if low[i] < 0 else []
        while reached:
            j = reached.pop()
            if low[j] < 0:
                low[j] = i
                reached += [n for s in steps for n in at.get(tuple(map(sum, zip(cells[j], s, strict=True))), ()) if low[n] < 0]
    return low


def steps_apart(a: Column, b: Column) -> Column:
    """The greatest distance of two positions on any axis."""
    return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0))


def areas(cells: DataFrame, keys: list[str] = WINDOW, tile_cells: int | None = None) -> DataFrame:
    """(keys, combo_id, root) of cells (keys, combo_id, pos): root is the least combo_id that a cell reaches by steps of one on
    every axis. Tiles are labelled one by one; labels that meet across tiles are joined, and roots passed on until none
    changes, about the logarithm of the longest chain of tiles."""
    ship(cells.sparkSession)
    size = float(tile_cells or TILE_CELLS)
    tile = F.transform("pos", lambda p: F.floor(p / _side(size)).cast("int"))
    tiled = cells.select(*keys, "combo_id", F.transform("pos", lambda p: p.cast("int")).alias("pos")).withColumn("tile", tile)

    def label(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("combo_id")
        ids = p["combo_id"].to_numpy()
        return p[[*keys, "combo_id"]].assign(pos=p["pos"], tile=p["tile"], root=ids[labels([tuple(map(int, c)) for c in p["pos"]])])

    kinds = dict(tiled.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "combo_id", "pos", "tile"]) + f", root {kinds['combo_id']}"
    local = cut(tiled.groupBy(*keys, "tile").applyInPandas(label, schema))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in _offsets(local)))
    # Only cells at the rim of their tile can touch another one.
    near = local.withColumn("step", F.explode(steps)).select(*keys, F.col("root").alias("a"), F.col("tile").alias("from_tile"), F.zip_with("pos", F.slice("step", F.lit(1), F.size("pos")), lambda x, y: x + y).alias("pos"))
    near = near.where(tile != F.col("from_tile"))
    touch = cut(near.join(local.select(*keys, "pos", F.col("root").alias("b")), [*keys, "pos"]).select(*keys, "a", "b").where("a <> b").distinct())
    if touch.isEmpty():
        return local.select(*keys, "combo_id", "root")
    at = touch.select(*keys, "a").distinct().withColumn("up", F.col("a"))
    while True:
        low = touch.join(at.select(*keys, F.col("a").alias("b"), F.col("up").alias("other")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("other").alias("other"))
        new = at.join(low, [*keys, "a"]).select(*keys, "a", F.least("up", "other").alias("to"), "up")
        new = new.join(at.select(*keys, F.col("a").alias("to"), F.col("up").alias("further")), [*keys, "to"], "left").select(*keys, "a", F.least("to", F.coalesce("further", "to")).alias("up"), F.col("up").alias("was"))
        new = cut(new)
        at = new.drop("was")
        if new.where("up <> was").isEmpty():
            break
    return local.join(at.withColumnRenamed("a", "root"), [*keys, "root"], "left").select(*keys, "combo_id", F.coalesce("up", "root").alias("root"))


def _offsets(cells: DataFrame) -> list[tuple[int, ...]]:
    """All steps of one on every axis, for the most axes that cells have."""
    axes = cells.agg(F.max(F.size("pos"))).first()[0] or 1
    return [s for s in product((-1, 0, 1), repeat=axes) if any(s)]


def _side(size: float) -> Column:
    """Of a tile of about `size` cells."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(size), 1.0 / F.greatest(F.size("pos"), F.lit(1)))).cast("int"))


def ridges(surface: DataFrame, combos: DataFrame, value: str, keys: list[str] = WINDOW, q: float = Q_TOP, tile_cells: int | None = None) -> DataFrame:
    """(keys, combo_id): the largest connected area of cells at or above the surface's (1 - q) quantile, of equals that with the least combo_id."""
    edge = surface.groupBy(*keys).agg(F.percentile(value, 1 - q).alias("edge"))
    top = surface.join(edge, keys).where(F.col(value) >= F.col("edge")).join(combos.select("project", "combo_id", "pos"), ["project", "combo_id"]).select(*keys, "combo_id", "pos")
    found = cut(areas(top, keys, tile_cells))
    best = found.groupBy(*keys, "root").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
    return found.join(best, [*keys, "root"]).select(*keys, "combo_id")


def centres(surface: DataFrame, ridge: DataFrame, combos: DataFrame, value: str, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, n_cells, centre, is_peak): the ridge's cell nearest its centroid, ties by value, then order; the surface's peak if the ridge has under three cells."""
    r = ridge.join(surface.select(*keys, "combo_id", F.col(value).alias("v")), [*keys, "combo_id"]).join(combos.select("project", "combo_id", "pos"), ["project", "combo_id"])
    axis = r.select(*keys, "combo_id", F.posexplode("pos").alias("axis", "p"))
    mean = axis.groupBy(*keys, "axis").agg(F.avg("p").alias("m"))
    dist = axis.join(mean, [*keys, "axis"]).groupBy(*keys, "combo_id").agg(F.bround(F.sqrt(F.sum(F.pow(F.col("p") - F.col("m"), 2))), 9).alias("dist"))
    c = r.join(dist, [*keys, "combo_id"]).groupBy(*keys).agg(F.count("*").alias("n_cells"), F.min_by("combo_id", F.struct("dist", -F.col("v"), "combo_id")).alias("medoid"))
    peak = surface.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by("combo_id", F.struct(value, -F.col("combo_id"))).alias("peak"))
    few = F.col("n_cells") < CENTRE_MIN_CELLS
    return peak.join(c.withColumn("n_cells", F.col("n_cells")), keys, "left").select(*keys, F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"), F.when(F.coalesce(few, F.lit(True)), F.col("peak")).otherwise(F.col("medoid")).alias("centre"), F.coalesce(few, F.lit(True)).alias("is_peak"), "peak")


def ensembles(surface: DataFrame, ridge: DataFrame, centre: DataFrame, combos: DataFrame, value: str, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, members, spacing, interior): cells spread over a ridge, the centre first, inner cells before edge cells, the best first.

    A greedy choice of at most ENSEMBLE_MAX: what is too near to a member stays so, so each further member is the first of
    the cells that are far enough from all members so far, one aggregate a round.
    """
    near = neighbours(combos, itself=False)
    on = ridge.select(*keys, F.col("combo_id").alias("near"), F.lit(True).alias("on_"))
    rim = ridge.join(near, ["project", "combo_id"]).join(on, [*keys, "near"], "left").where("on_ is null").select(*keys, "combo_id").distinct().withColumn("rim", F.lit(True))
    pos = combos.select("project", "combo_id", "pos")
    cells = ridge.join(surface.select(*keys, "combo_id", F.col(value).alias("v")), [*keys, "combo_id"]).join(pos, ["project", "combo_id"]).join(rim, [*keys, "combo_id"], "left")
    cells = cut(cells.select(*keys, "combo_id", "pos", F.coalesce("rim", F.lit(False)).alias("rim"), F.coalesce(-F.col("v"), F.lit(float("inf"))).alias("low")))
    facts = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("rim")).alias("inner_"))
    first = centre.select(*keys, F.col("centre").alias("combo_id")).join(pos, ["project", "combo_id"]).join(facts, keys, "left")
    most = F.greatest(F.lit(1), F.least(F.lit(ENSEMBLE_MAX), F.floor(F.coalesce("n", F.lit(0)) / CELLS_PER_MEMBER).cast("int")))
    inner = F.coalesce("inner_", F.lit(0)) > 0
    m = cut(first.select(*keys, F.array(F.struct("combo_id", "pos")).alias("members"), most.alias("most"), F.when(inner, 2).otherwise(1).alias("spacing"), inner.alias("interior")))
    for _ in range(ENSEMBLE_MAX - 1):
        far = cells.join(m, keys).where((F.size("members") < F.col("most")) & F.forall("members", lambda x: steps_apart(x["pos"], F.col("pos")) >= F.col("spacing")))
        best = far.groupBy(*keys).agg(F.min_by(F.struct("combo_id", "pos"), F.struct("rim", "low", "combo_id")).alias("best"))
        m = cut(m.join(best, keys, "left").withColumn("members", F.when(F.col("best").isNull(), F.col("members")).otherwise(F.concat("members", F.array("best")))).drop("best"))
    return m.select(*keys, F.transform("members", lambda x: x["combo_id"]).alias("members"), "spacing", "interior")


def basis_days(windows: DataFrame, days: DataFrame, scheme: str) -> DataFrame:
    """(project, day_idx) on which the base setting is fitted: the last window's two sides; with one split, or none, the later half."""
    n = days.groupBy("project").agg(F.count("*").alias("n"))
    half = days.join(n, "project").where(F.col("day_idx") >= F.floor(F.col("n") / 2)).select("project", "day_idx")
    if scheme == "single" or windows.isEmpty():
        return half
    last = windows.groupBy("project").agg(F.max_by(F.struct("is_first", "is_last", "oos_first", "oos_last"), "window").alias("w"))
    return days.join(last, "project").where("day_idx between w.is_first and w.is_last or day_idx between w.oos_first and w.oos_last").select("project", "day_idx")


def _reached(some: Column) -> Column:
    """The cells of the array `cells` within a step of some of them."""
    return F.filter("cells", lambda c: F.exists(some, lambda r: steps_apart(r, c) <= 1))


def base_setting(daily: DataFrame, days: DataFrame, windows: DataFrame, combos: DataFrame, readings: DataFrame, scheme: str) -> DataFrame:
    """A row a project: the basis, the region, its centre and ranges, the peak, the members, the five best, and the pick with its confidence.

    readings: (project, reading). After an edge the pick is the peak of the pooled surface, else the region's centre.
    """
    key = ["project"]
    basis = basis_days(windows, days, scheme).join(days, ["project", "day_idx"])
    span = basis.groupBy("project").agg(F.min("date").alias("basis_start"), F.max("date").alias("basis_end"), F.count("*").alias("n_basis_days"))
    x = daily.join(basis.select("project", "day_idx"), ["project", "day_idx"]).groupBy("project", "combo_id").agg(F.sum("pnl").alias("x"))
    s = cut(pool(x, neighbours(combos), "x", key))
    ridge = cut(ridges(s, combos, "pooled", key))
    c = cut(centres(s, ridge, combos, "pooled", key))
    e = ensembles(s, ridge, c, combos, "pooled", key)
    axis = combos.select("project", "combo_id", F.posexplode("params").alias("axis", "p"))
    ranges = ridge.join(axis, ["project", "combo_id"]).groupBy("project", "axis").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    ranges = ranges.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("ranges"))
    five = top_k(s, "x", key).where(F.col("place") <= FIVE_BEST).join(combos.select("project", "combo_id", "pos"), ["project", "combo_id"])
    mean = five.select("project", F.posexplode("pos").alias("axis", "p")).groupBy("project", "axis").agg(F.avg("p").alias("m"))
    dist = combos.select("project", "combo_id", F.posexplode("pos").alias("axis", "p")).join(mean, ["project", "axis"]).groupBy("project", "combo_id").agg(F.sqrt(F.sum(F.pow(F.col("p") - F.col("m"), 2))).alias("d"))
    near = dist.groupBy("project").agg(F.min_by("combo_id", F.struct("d", "combo_id")).alias("five_best_centre"))
    cells = F.collect_list("pos")
    reached = F.slice("cells", 1, 1)
    for _ in range(FIVE_BEST - 1):
        reached = _reached(reached)
    one_area = five.groupBy("project").agg(cells.alias("cells")).select("project", (F.size(reached) == F.size("cells")).alias("five_best_connected"))
    out = c.join(span, "project").join(e, "project").join(ranges, "project", "left").join(near, "project").join(one_area, "project").join(readings, "project", "left")
    edge = F.coalesce(F.col("reading") == "edge", F.lit(False))
    out = out.withColumns({"pick": F.when(edge, F.col("peak")).otherwise(F.col("centre")), "pick_rule": F.when(edge, "pooled peak").otherwise("centre"), "confidence": F.when(edge, "supported").when(F.col("reading") == "plateau", "low stakes").otherwise("none")})
    return out.join(combos.select("project", F.col("combo_id").alias("pick"), F.col("params").alias("pick_params")), ["project", "pick"])
