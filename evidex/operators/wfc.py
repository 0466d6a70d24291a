"""Rank correlation of in- and out-of-sample surfaces, its nulls, bands, followed winners, plateaus and the selection haircut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.semantics import avg_rank, corr0, p_from_counts, uniform
from evidex.operators.grid import WINDOW, neighbours
from evidex.operators.region import by_cell_blocks
from evidex.session import cut, ship, spread

NULLS = ("signflip", "torus")
MIN_POINTS, MIN_POSITIVE = 8, 4
#: Series that a task compares with all those of their key.
CHUNK = 256
#: Days up to which their products are one matrix in a task.
GRAM_DAYS = 4096


def valid(pairs: DataFrame) -> DataFrame:
    return pairs.where("x is not null and y is not null")


def correlations(pairs: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, n_points, spearman, pearson, n_pos_is, pos_oos_frac, insufficient)."""
    v = valid(pairs).withColumns({"rx": avg_rank(F.col("x"), keys), "ry": avg_rank(F.col("y"), keys)})
    positive = F.col("x") > 0
    a = v.groupBy(*keys).agg(F.count("*").alias("n_points"), corr0("rx", "ry").alias("spearman"), corr0("x", "y").alias("pearson"), F.count_if(positive).alias("n_pos_is"), F.coalesce(F.avg(F.when(positive, (F.col("y") > 0).cast("double"))), F.lit(0.0)).alias("pos_oos_frac"))
    return a.withColumn("insufficient", (F.col("n_points") < MIN_POINTS) | (F.col("n_pos_is") < MIN_POSITIVE))


def spearman_draws(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    """(project, window, draw, null_rho): the rank correlation of x with each drawn surface, over the points that have both."""
    keys = [*WINDOW, "draw"]
    d = draws.join(valid(pairs).select(*WINDOW, "combo_id", "x"), [*WINDOW, "combo_id"]).where("y is not null")
    d = d.withColumns({"rx": avg_rank(F.col("x"), keys), "ry": avg_rank(F.col("y"), keys)})
    return d.groupBy(*keys).agg(corr0("rx", "ry").alias("null_rho"))


def torus_draws(pairs: DataFrame, combos: DataFrame, shape: DataFrame, n_max: int = 999, seed: int = 0, draw=uniform) -> DataFrame:
    """(project, window, draw, combo_id, y): every non-zero shift of a full grid if there are at most n_max, else n_max random ones; off a full grid, permutations.

    A shift is an equi-join of (pos + s) mod size. shape: as grid.shape gives it, a row an axis.
    """
    s = shape.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "size"))), lambda x: x["size"]).alias("sizes"), F.first("is_full").alias("is_full"))
    s = s.withColumn("cells", F.aggregate("sizes", F.lit(1).cast("bigint"), lambda a, x: a * x))
    n = F.when(F.col("is_full") & (F.col("cells") - 1 <= n_max), F.col("cells") - 1).otherwise(F.lit(n_max)).cast("int")
    d = spread(s.withColumn("draw", F.explode(F.sequence(F.lit(1), n))), "project", "draw")
    code = F.when(F.col("cells") - 1 <= n_max, F.col("draw").cast("bigint")).otherwise(1 + F.floor(draw(seed, "torus", F.col("project"), F.col("draw")) * (F.col("cells") - 1)))
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(1).cast("bigint"), lambda a, x: a * x)
    d = d.withColumn("code", code).withColumn("shift", F.transform("sizes", lambda x, i: (F.floor(F.col("code") / before(i)) % x).cast("int")))
    full = d.where("is_full").join(combos.select("project", "combo_id", "pos"), "project")
    cell = F.zip_with(F.zip_with("pos", "shift", lambda a, b: a + b), "sizes", lambda a, n: (a % n).cast("int"))
    full = full.select("project", "draw", "combo_id", cell.alias("cell"))
    at = combos.select("project", F.col("combo_id").alias("from_id"), F.transform("pos", lambda p: p.cast("int")).alias("cell"))
    full = full.join(at, ["project", "cell"]).select("project", "draw", "combo_id", "from_id")
    part = d.where("not is_full").select("project", "draw").join(combos.select("project", "combo_id"), "project")
    by = lambda tag: F.row_number().over(Window.partitionBy("project", "draw").orderBy(draw(seed, tag, F.col("project"), F.col("draw"), F.col("combo_id"))))
    to = part.withColumn("place", by("permute"))
    src = part.withColumn("place", F.row_number().over(Window.partitionBy("project", "draw").orderBy("combo_id"))).select("project", "draw", "place", F.col("combo_id").alias("from_id"))
    moves = full.union(to.join(src, ["project", "draw", "place"]).select("project", "draw", "combo_id", "from_id"))
    y = pairs.select(*WINDOW, F.col("combo_id").alias("from_id"), "y")
    return moves.join(y, ["project", "from_id"]).select(*WINDOW, "draw", "combo_id", "y")


def correlation_test(corr: DataFrame, draws: DataFrame, alpha: float = 0.05, tau: float = 0.5) -> DataFrame:
    """corr with p_value (1 where insufficient) and the quadrant; draws: (project, window, draw, null_rho)."""
    p = draws.join(corr.select(*WINDOW, "spearman"), WINDOW).groupBy(*WINDOW).agg(p_from_counts(F.count_if(F.col("null_rho") >= F.col("spearman")), F.count("*")).alias("p_"))
    out = corr.join(p, WINDOW, "left").withColumn("p_value", F.when(F.col("insufficient"), 1.0).otherwise(F.coalesce("p_", F.lit(1.0)))).drop("p_")
    return out.withColumn("quadrant", quadrant(F.col("p_value") < alpha, F.col("pos_oos_frac") >= tau))


def quadrant(corr_ok: Column, oos_ok: Column) -> Column:
    return F.when(corr_ok & oos_ok, "structural edge, low over-fitting").when(corr_ok, "consistently loss-making strategy").when(oos_ok, "spurious result, high over-fitting").otherwise("noise, no edge")


def pooled_test(corr: DataFrame, draws: DataFrame, windows: DataFrame, alpha: float = 0.05, tau: float = 0.5) -> DataFrame:
    """(project, pooled_spearman, pooled_pos_oos_frac, pooled_p, passed, reasons) over complete, sufficient windows."""
    use = corr.where("not insufficient").join(windows.where("complete").select(*WINDOW), WINDOW)
    m = use.groupBy("project").agg(F.avg("spearman").alias("pooled_spearman"), F.avg("pos_oos_frac").alias("pooled_pos_oos_frac"))
    d = draws.join(use.select(*WINDOW), WINDOW).groupBy("project", "draw").agg(F.avg("null_rho").alias("v")).join(m.select("project", "pooled_spearman"), "project")
    p = d.groupBy("project").agg(p_from_counts(F.count_if(F.col("v") >= F.col("pooled_spearman")), F.count("*")).alias("pooled_p"))
    every = windows.select("project").distinct().join(m, "project", "left").join(p, "project", "left")
    low, no = F.coalesce(F.col("pooled_p") >= alpha, F.lit(False)), F.coalesce(F.col("pooled_pos_oos_frac") < tau, F.lit(False))
    none = F.col("pooled_spearman").isNull()
    reasons = F.when(none, "wfc_insufficient").otherwise(F.concat_ws(",", F.when(low, "wfc_low_corr"), F.when(no, "wfc_no_oos_edge")))
    return every.withColumns({"reasons": reasons, "passed": ~none & ~low & ~no})


def bands(pairs: DataFrame, n_bands: int = 10) -> DataFrame:
    """(project, window, band, n, is_mean, oos_mean, oos_se, oos_pos_share): the in-sample ranking in equal bands, 1 the best; none with fewer points than bands."""
    w = Window.partitionBy(*WINDOW)
    b = valid(pairs).withColumns({"band": F.ntile(n_bands).over(w.orderBy(F.col("x").desc(), "combo_id")), "n_": F.count("*").over(w)}).where(F.col("n_") >= n_bands)
    return b.groupBy(*WINDOW, "band").agg(F.count("*").alias("n"), F.avg("x").alias("is_mean"), F.avg("y").alias("oos_mean"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("oos_se"), F.avg((F.col("y") > 0).cast("double")).alias("oos_pos_share"))


def top_n(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """(project, window, n, n_valid, median_oos_rank, n_positive_oos): where the n best in sample landed; n is 10, or a third of the points."""
    w = Window.partitionBy(*WINDOW)
    v = valid(pairs).withColumns({"place": F.row_number().over(w.orderBy(F.col("x").desc(), "combo_id")), "oos_rank": avg_rank(F.col("y"), WINDOW, descending=True), "n_valid": F.count("*").over(w)})
    most = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("n_valid") / 3))) if n is None else F.least(F.lit(n), F.col("n_valid"))
    return v.where(F.col("place") <= most).groupBy(*WINDOW).agg(F.count("*").alias("n"), F.first("n_valid").alias("n_valid"), F.percentile("oos_rank", 0.5).alias("median_oos_rank"), F.count_if(F.col("y") > 0).alias("n_positive_oos"))


def plateau(pairs: DataFrame, picks: DataFrame, combos: DataFrame) -> DataFrame:
    """(project, window, n_neighbours, score_is, score_oos, flat_oos, positive_share_oos) around each pick; NULL with fewer than two values."""
    near = neighbours(combos).withColumnRenamed("combo_id", "pick")
    d = picks.select(*WINDOW, "pick").join(near, ["project", "pick"]).join(pairs.withColumnRenamed("combo_id", "near"), [*WINDOW, "near"])
    other = F.col("near") != F.col("pick")

    def score(v: str) -> tuple[Column, Column, Column]:
        m = F.avg(v)
        flat = F.when(m > 0, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.stddev_pop(v) / (F.abs(m) + 1e-9)))).otherwise(0.0)
        share = F.coalesce(F.avg(F.when(other & F.col(v).isNotNull(), (F.col(v) > 0).cast("double"))), F.lit(0.0))
        enough = F.count(v) >= 2
        return F.when(enough, 0.5 * flat + 0.5 * share), F.when(enough, flat), F.when(enough, share)

    oos = score("y")
    return d.groupBy(*WINDOW).agg(F.count_if(other).alias("n_neighbours"), score("x")[0].alias("score_is"), oos[0].alias("score_oos"), oos[1].alias("flat_oos"), oos[2].alias("positive_share_oos"))


def pooled_plateau(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, pooled_score, n_complete): the mean out-of-sample score over complete windows; NULL where none has a score. scores: as plateau gives them."""
    s = windows.where("complete").select(*WINDOW).join(scores.select(*WINDOW, "score_oos"), WINDOW, "left")
    return s.groupBy("project").agg(F.avg("score_oos").alias("pooled_score"), F.count("*").alias("n_complete"))


def effective_trials(daily: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, n_eff): how many independent variants a set of series is worth, m^2 / sum of squared correlations of its m varying series.

    This equals (sum of eigenvalues)^2 / (sum of their squares) of the correlation matrix, by its trace and its Frobenius
    norm. daily: (keys, combo_id, day_idx, pnl), the same days for each combination of a key. A series is one array. The norm
    is that of the products of days as well as of those of series, so the smaller matrix is taken: where there are fewer
    days, the work is linear in the series; else the correlations of a pair are squared and added where the pair is made,
    and a key's pairs are spread over chunks of CHUNK series.
    """
    w = Window.partitionBy(*keys, "combo_id")
    z = daily.withColumns({"m_": F.avg("pnl").over(w), "s_": F.stddev_pop("pnl").over(w)}).where("s_ > 0")
    z = z.select(*keys, "combo_id", "day_idx", ((F.col("pnl") - F.col("m_")) / F.col("s_")).alias("z"))
    z = z.groupBy(*keys, "combo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "z"))), lambda x: x["z"]).alias("z"))
    many = z.groupBy(*keys).agg(F.count("*").alias("m"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.max(F.size("z")).alias("n"))
    by_days = (F.col("n") < F.col("m")) & (F.col("n") <= GRAM_DAYS)
    z = cut(z.join(many.withColumn("by_days", by_days), keys))
    one = z.where("not by_days").withColumn("chunk", F.pmod(F.hash("combo_id"), "chunks"))
    other = z.where("not by_days").select(*keys, F.col("combo_id").alias("c2"), F.col("z").alias("z2"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    c = F.aggregate(F.zip_with("z", "z2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.size("z")
    pairs = one.join(other, [*keys, "chunk"]).where("combo_id < c2").groupBy(*keys).agg((2 * F.sum(c * c)).alias("squares"))
    m = F.col("m").cast("double")
    if not z.where("by_days").isEmpty():
        norm = day_products(z.where("by_days").select(*keys, "z"), keys)
        pairs = pairs.union(norm.join(many, keys).select(*keys, (F.col("norm") / F.pow("n", F.lit(2)) - m).alias("squares")))
    return many.join(pairs, keys, "left").select(*keys, (m * m / (m + F.coalesce("squares", F.lit(0.0)))).alias("n_eff"))


def day_products(z: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """(keys, norm): the squared Frobenius norm of the products of days, summed over series z. A task adds up the products of
    all series that it has of a key; the sums of tasks are then added by day."""
    ship(z.sparkSession)
    kinds = dict(z.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            table = pa.Table.from_batches([b])
            rows = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
            for key in dict.fromkeys(rows):
                some = np.array([table.column("z")[i].values.to_numpy() for i, r in enumerate(rows) if r == key])
                sums[key] = sums.get(key, 0.0) + some.T @ some
        for key, g in sums.items():
            columns = [pa.array([k] * len(g), table.schema.field(name).type) for k, name in zip(key, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], [*keys, "day", "products"])

    def squared(table: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in table.column("products")], axis=0)
        return table.slice(0, 1).select(keys).append_column("part", pa.array([float(total @ total)]))

    sums = z.mapInArrow(products, f"{named}, day int, products array<double>")
    return sums.groupBy(*keys, "day").applyInArrow(squared, f"{named}, part double").groupBy(*keys).agg(F.sum("part").alias("norm"))


def bootstrap_blocks(n_days: DataFrame, n_boot: int, mean_block: float = 20.0, seed: int = 0, draw=uniform) -> DataFrame:
    """(keys, n, draw, start, days): the runs of days of a stationary bootstrap; runs of geometric length that wrap around the end. n_days: (keys, n)."""
    keys = [c for c in n_days.columns if c != "n"]
    d = spread(n_days.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))), *keys, "draw").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    named = [*(F.col(k) for k in keys), F.col("draw"), F.col("t")]  # projects and windows draw apart
    d = d.where((F.col("t") == 0) | (draw(seed, "restart", *named) < 1.0 / max(1.0, mean_block)))
    start = F.least(F.floor(draw(seed, "start", *named) * F.col("n")), F.col("n") - 1).cast("int")
    until = F.coalesce(F.lead("t").over(Window.partitionBy(*keys, "draw").orderBy("t")), F.col("n"))
    return d.select(*keys, "n", "draw", start.alias("start"), (until - F.col("t")).alias("days"))


def bootstrap_days(n_days: DataFrame, n_boot: int, mean_block: float = 20.0, seed: int = 0, draw=uniform) -> DataFrame:
    """(keys, draw, day, times): how often each draw of a stationary bootstrap takes each day. n_days: (keys, n)."""
    keys = [c for c in n_days.columns if c != "n"]
    d = bootstrap_blocks(n_days, n_boot, mean_block, seed, draw).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    return d.groupBy(*keys, "draw", ((F.col("start") + F.col("i")) % F.col("n")).alias("day")).agg(F.count("*").alias("times"))


def reality_check(daily: DataFrame, picks: DataFrame, n_boot: int = 500, mean_block: float = 20.0, seed: int = 0, draw=uniform, min_days: int = 60) -> DataFrame:
    """(project, window, n_days, best_index, best_mean, pick_mean, p_best, p_pick): the best mean against the best that luck gives.

    daily: (project, window, combo_id, day, pnl), every day from 0 on in each window. A draw is a few runs of days, and a
    series is an array of running sums, so a bootstrap mean takes two look-ups a run. Windows with fewer than min_days days
    have no row.
    """
    n = daily.groupBy(*WINDOW).agg(F.count_distinct("day").cast("int").alias("n")).where(F.col("n") >= min_days)
    d = daily.join(n, WINDOW)
    of = Window.partitionBy(*WINDOW, "combo_id")
    c = d.withColumn("c", F.col("pnl") - F.avg("pnl").over(of)).withColumn("run", F.sum("c").over(of.orderBy("day")))
    series = c.groupBy(*WINDOW, "combo_id", "n").agg(F.concat(F.array(F.lit(0.0)), F.transform(F.array_sort(F.collect_list(F.struct("day", "run"))), lambda x: x["run"])).alias("run"))
    means = d.groupBy(*WINDOW, "combo_id").agg(F.avg("pnl").alias("f"))
    blocks = bootstrap_blocks(n, n_boot, mean_block, seed, draw).groupBy(*WINDOW, "draw").agg(F.collect_list(F.struct("start", "days")).alias("blocks"))
    until = lambda at: F.when(at <= F.col("n"), F.get("run", at)).otherwise(F.get("run", F.col("n")) + F.get("run", at - F.col("n")))
    m = F.aggregate("blocks", F.lit(0.0), lambda a, x: a + until(x["start"] + x["days"]) - F.get("run", x["start"])) / F.col("n")
    top = by_cell_blocks(blocks, series).groupBy(*WINDOW, "draw").agg(F.max(m).alias("null_max"))
    best = means.groupBy(*WINDOW).agg(F.max("f").alias("best_mean"), F.max_by("combo_id", F.struct("f", -F.col("combo_id"))).alias("best_index"))
    own = picks.select(*WINDOW, F.col("pick").alias("combo_id")).join(means, [*WINDOW, "combo_id"]).select(*WINDOW, F.col("f").alias("pick_mean"))
    a = top.join(best, WINDOW).join(own, WINDOW, "left").join(n, WINDOW)
    p = lambda c: p_from_counts(F.count_if(F.col("null_max") >= F.col(c)), F.count("*"))
    return a.groupBy(*WINDOW, F.col("n").alias("n_days"), "best_index", "best_mean", "pick_mean").agg(p("best_mean").alias("p_best"), F.when(F.col("pick_mean").isNotNull(), p("pick_mean")).alias("p_pick"))
