"""DataFrames that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.grid import neighbours


def histogram(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """(keys, bin, lower, n): counts in bins of equal width between the least and the greatest value; all in bin 0 where they are equal."""
    lim = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    v = df.where(F.col(x).isNotNull()).join(lim, keys)
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(bins * F.try_divide(F.col(x) - F.col("lo"), F.col("hi") - F.col("lo")))), F.lit(0)).cast("int")
    return v.groupBy(*keys, at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), "n")


def ols_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept, x_min, x_max) of the pairs without NULL; NULL with fewer than two, or where x is constant."""
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    slope = F.when(F.col("x_max") > F.col("x_min"), F.try_divide("c", "v"))
    return p.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), "x_min", "x_max")


def ranked_profile(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", by: str = "combo_id") -> DataFrame:
    """(keys, by, place, x_pct, y_pct, rolling): pairs in the order of x, best first, with both percentile ranks and y's centred rolling mean."""
    from evidex.functions.semantics import avg_rank

    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    pct = lambda c: (avg_rank(F.col(c), keys) - 1.0) / F.greatest(n - 1, F.lit(1)) * 100.0
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc(), by)
    p = p.select(*keys, by, F.row_number().over(w).alias("place"), n.alias("n"), pct(x).alias("x_pct"), pct(y).alias("y_pct"))
    width = F.greatest(F.lit(3), (F.col("n") / 10).cast("int"))
    around = p.select(*keys, F.col("place").alias("p2"), F.col("y_pct").alias("y2"))
    left = F.floor(width / 2)
    near = p.select(*keys, "place", F.explode(F.sequence(F.col("place") - left, F.col("place") - left + width - 1)).alias("p2"))
    roll = near.join(around, [*keys, "p2"]).groupBy(*keys, "place").agg(F.avg("y2").alias("rolling"))
    return p.join(roll, [*keys, "place"]).drop("n")


def outline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): unit edges between the cells (keys, r, c) and what is not among them, by an anti-join of the four neighbours."""
    side = lambda dr, dc, x0, y0, x1, y1: F.struct(*(v.alias(n) for v, n in zip((F.col("r") + dr, F.col("c") + dc, F.col("c") + x0, F.col("r") + y0, F.col("c") + x1, F.col("r") + y1), ("r2", "c2", "x0", "y0", "x1", "y1"), strict=True)))
    sides = F.array(side(0, -1, -0.5, -0.5, -0.5, 0.5), side(0, 1, 0.5, -0.5, 0.5, 0.5), side(-1, 0, -0.5, -0.5, 0.5, -0.5), side(1, 0, -0.5, 0.5, 0.5, 0.5))
    e = cells.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    return e.join(cells.select(*keys, F.col("r").alias("r2"), F.col("c").alias("c2")), [*keys, "r2", "c2"], "left_anti").drop("r2", "c2")


def slice_through(combos: DataFrame, through: DataFrame) -> DataFrame:
    """(project, combo_id, row, col): the two-axis slice of a grid that holds a combination: the widest axis across, the next
    widest up (the first of equals), all others fixed at that combination's. through: (project, combo_id)."""
    axis = combos.select("project", F.posexplode("pos").alias("axis", "p")).groupBy("project", "axis").agg(F.count_distinct("p").alias("size"))
    order = axis.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("size"), "axis"))), lambda x: x["axis"]).alias("order"))
    at = through.join(combos.select("project", "combo_id", F.col("pos").alias("at")), ["project", "combo_id"]).select("project", "at")
    d = combos.select("project", "combo_id", "pos").join(order, "project").join(at, "project")
    fixed = F.forall(F.slice("order", F.lit(3), F.size("order")), lambda a: F.get("pos", a) == F.get("at", a))
    up = F.when(F.size("order") > 1, F.get("pos", F.get("order", 1))).otherwise(0)
    return d.where(fixed).select("project", "combo_id", up.cast("int").alias("row"), F.get("pos", F.get("order", 0)).cast("int").alias("col"))


def plateau_bars(pairs: DataFrame, picks: DataFrame, combos: DataFrame) -> DataFrame:
    """(project, window, place, combo_id, is_pick, y): each pick, then its neighbours from the best to the worst, those without a value last."""
    near = neighbours(combos).withColumnsRenamed({"combo_id": "pick", "near": "combo_id"})
    d = picks.select("project", "window", "pick").join(near, ["project", "pick"]).join(pairs.select("project", "window", "combo_id", "y"), ["project", "window", "combo_id"])
    d = d.withColumn("is_pick", F.col("combo_id") == F.col("pick"))
    place = F.row_number().over(Window.partitionBy("project", "window").orderBy(F.col("is_pick").desc(), F.col("y").desc_nulls_last(), "combo_id"))
    return d.select("project", "window", place.alias("place"), "combo_id", "is_pick", "y")
