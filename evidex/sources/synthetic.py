"""Made-up bars, trades and grids with a known truth, drawn by number so that any partitioning gives the same."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.semantics import fast_uniform
from evidex.operators.grid import neighbours
from evidex.session import cut, spread
from evidex.sources.report import whole_text


#: The share of large gains among jumps.
JUMP_P = 0.03


def normal(*parts) -> Column:
    """A standard normal draw named by its parts."""
    u, v = fast_uniform("n1", *parts), fast_uniform("n2", *parts)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * math.pi * v)


def jump(*parts) -> Column:
    """A draw of mean 0 and variance 1 named by its parts: rarely a large gain, else a small loss."""
    return ((fast_uniform("j", *parts) < JUMP_P).cast("double") - JUMP_P) / math.sqrt(JUMP_P * (1 - JUMP_P))


def make_bars(spark: SparkSession, n: int, minutes: int = 30, seed: int = 0, p0: float = 20000.0, start: str = "2020-01-02 09:00:00", symbol: str = "@ES") -> DataFrame:
    """A random walk of open prices with the bars around it."""
    b = spark.range(n).withColumnRenamed("id", "bar_idx").withColumn("symbol", F.lit(symbol))
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("close", F.round(p0 * F.exp(F.sum(0.001 * normal(seed, "r", F.col("bar_idx"))).over(w)), 2))
    b = b.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_idx")), F.lit(p0)))
    wick = lambda k: F.round(F.abs(normal(seed, k, F.col("bar_idx"))) * p0 * 0.0003, 2)
    ts = F.timestamp_add("MINUTE", F.col("bar_idx") * minutes, F.lit(start).cast("timestamp_ntz"))
    return b.select("symbol", "bar_idx", ts.alias("ts"), "open", (F.greatest("open", "close") + wick("h")).alias("high"), (F.least("open", "close") - wick("l")).alias("low"), "close", (50 + F.floor(fast_uniform(seed, "v", F.col("bar_idx")) * 400)).cast("double").alias("volume"))


def make_trades(bars: DataFrame, n: int, seed: int = 0, edge: bool = False, max_hold: int = 40, point_value: float = 2.0, commission: float = 2.2, slippage: float = 0.5, strategy_id: int = 0) -> DataFrame:
    """n round trips at bar opens that don't overlap: each has a stretch of bars of its own. edge looks ahead and takes the right side."""
    n_bars = bars.count()
    stretch = n_bars // n
    hold = F.least(F.lit(max_hold), F.lit(stretch - 1))
    if stretch < 3:
        raise ValueError("too many trades for the bars")
    t = bars.sparkSession.range(n).withColumnRenamed("id", "i").withColumn("hold", 1 + F.floor(fast_uniform(seed, "hold", F.col("i")) * (hold - 1)))
    t = t.withColumn("e", F.col("i") * stretch + F.floor(fast_uniform(seed, "at", F.col("i")) * (stretch - F.col("hold"))))
    at = lambda k, s: bars.select(F.col("bar_idx").alias(k), "symbol" if s == "entry" else F.lit(1).alias("one_"), F.col("ts").alias(f"{s}_time"), F.col("open").alias(f"{s}_price"))
    t = t.join(at("e", "entry"), "e").withColumn("x", F.col("e") + F.col("hold")).join(at("x", "exit"), "x")
    coin = F.when(fast_uniform(seed, "side", F.col("i")) < 0.5, 1).otherwise(-1)
    side = F.when(F.col("exit_price") >= F.col("entry_price"), 1).otherwise(-1) if edge else coin
    gross = F.round(side * (F.col("exit_price") - F.col("entry_price")) * point_value, 2)
    return t.select(F.lit(strategy_id).cast("bigint").alias("strategy_id"), (F.col("i") + 1).alias("trade_id"), "symbol", side.alias("direction"), "entry_time", "exit_time", "entry_price", "exit_price", F.lit(1).alias("contracts"), gross.alias("gross_pnl"), F.round(gross - 2 * (commission + slippage), 2).alias("net_pnl"), F.lit(commission).alias("comm_side"), F.lit(slippage).alias("slip_side"))


def make_grid(spark: SparkSession, shape: tuple[int, ...], n_days: int, split: int, structure: str = "persistent", signal: float = 30.0, noise: float = 100.0, rho: float = 0.0, trade_p: float = 0.3, tail: str = "normal", seed: int = 0, project: str = "demo") -> dict[str, DataFrame]:
    """combos, days, grid_daily and grid_exits of a grid with a bump of `signal` a day around its middle.

    structure: noise has none, persistent and ridge keep it, decay turns it over at `split`. rho: the share of the noise that
    neighbours have in common. tail: normal, or jumps, rare and large.
    """
    if structure not in ("noise", "persistent", "ridge", "decay") or tail not in ("normal", "jumps"):
        raise ValueError("structure must be noise, persistent, ridge or decay, and tail normal or jumps")
    cells = math.prod(shape)
    pos, size = [], 1
    for n in shape:
        pos.append((F.floor(F.col("combo_id") / size) % n).cast("int"))
        size *= n
    combos = spark.range(cells).select(F.lit(project).alias("project"), F.col("id").cast("int").alias("combo_id"))
    combos = combos.withColumn("pos", F.array(*pos)).withColumn("params", F.transform("pos", lambda p: (p + 1).cast("double")))
    far = [F.pow((F.col("pos")[i] - (n - 1) / 2.0) / (n / 4.0), 2) for i, n in enumerate(shape)]
    far = far[:1] if structure == "ridge" else far
    bump = F.exp(-sum(far[1:], far[0])) * (0.0 if structure == "noise" else signal)
    days = spark.range(n_days).select(F.lit(project).alias("project"), F.col("id").cast("int").alias("day_idx"), F.date_add(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    d = combos.withColumn("bump", bump).select("project", "combo_id", "bump").join(days, "project")
    z = normal(seed, "z", F.col("combo_id"), F.col("day_idx"))
    if tail == "jumps":
        z = jump(seed, "z", F.col("combo_id"), F.col("day_idx"))
    d = d.withColumn("z", z)
    if rho:
        near = neighbours(combos)
        mean = near.join(d.select("project", F.col("combo_id").alias("near"), "day_idx", "z"), ["project", "near"]).groupBy("project", "combo_id", "day_idx").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("common"))
        d = d.join(mean, ["project", "combo_id", "day_idx"]).withColumn("z", math.sqrt(rho) * F.col("common") + math.sqrt(1 - rho) * F.col("z"))
    alive = F.col("day_idx") < split if structure == "decay" else F.lit(True)
    active = fast_uniform(seed, "t", F.col("day_idx")) < trade_p
    d = d.withColumn("pnl", F.when(active, F.round(noise * F.col("z") + F.when(alive, F.col("bump")).otherwise(-F.col("bump")), 2)).otherwise(0.0))
    exits = d.where(active).select("project", "combo_id", "date", F.lit(1).cast("bigint").alias("n"))
    return {"combos": combos.select("project", "combo_id", "params", "pos"), "days": days, "grid_daily": d.select("project", "combo_id", "day_idx", "date", "pnl"), "grid_exits": exits}


def planted_grids(spark: SparkSession, seeds: list[int], shape: tuple[int, ...] = (6, 6), structure: str = "noise", rho: float = 0.9, trade_p: float = 0.2, n_days: int = 600, split: int | None = None, signal: float = 0.3, tail: str = "normal") -> dict[str, DataFrame]:
    """combos, days, grid_daily and grid_exits of a grid for each seed, the project being its seed; for size and power of tests.

    All cells of a grid trade on the same days. A trade's result is 100 (mean of the cell + noise) to the cent. The noise has
    mean 0 and variance 1; rho of its variance is that of the mean white noise within two steps, so neighbours share it.
    structure: noise has mean 0, ridge a narrow bump on flat ground, persistent a wide one with a rim below 0, and decay the
    wide one turned over from day `split` on, two thirds of the days by default. signal is the bump's height. tail: normal, or
    jumps. Days are weekdays. Draws are named by seed, cell and day.
    """
    if structure not in ("noise", "persistent", "ridge", "decay") or tail not in ("normal", "jumps"):
        raise ValueError("structure must be noise, persistent, ridge or decay, and tail normal or jumps")
    cells = list(product(*map(range, shape)))
    near = [[j for j, b in enumerate(cells) if max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 2] for a in cells]
    wide = structure != "ridge"
    width = [max(1.0, 0.6 * (n - 1)) if wide else max(0.7, 0.28 * (n - 1)) for n in shape]
    middle = [(0.3 + 0.4 * fast_uniform("middle", F.col("seed"), F.lit(a))) * (n - 1) for a, n in enumerate(shape)]
    far = lambda c: sum((F.pow((F.lit(float(c[a])) - middle[a]) / width[a], 2) for a in range(len(shape))), F.lit(0.0))
    bump = F.array(*(F.lit(0.0) if structure == "noise" else signal * (F.exp(-far(c)) - (0.45 if wide else 0.0)) for c in cells))
    turn = int(n_days * 2 / 3) if split is None else split
    runs = spark.createDataFrame([(s,) for s in seeds], "seed long").select("seed", F.concat(F.lit("seed"), "seed").alias("project"), bump.alias("mu"))
    date = lambda d: F.date_add(F.lit("2020-01-06").cast("date"), (7 * F.floor(d / 5) + d % 5).cast("int"))
    d = spread(runs.withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1)))), "project", "day_idx")
    d = d.withColumns({"active": fast_uniform("day", F.col("seed"), F.col("day_idx")) < trade_p, "turned": F.when((F.col("day_idx") >= turn) & F.lit(structure == "decay"), -1.0).otherwise(1.0)})
    every = F.sequence(F.lit(0), F.lit(len(cells) - 1))
    draw = normal if tail == "normal" else jump
    # each array is kept before the next reads it, or it would be drawn anew for each of its readers
    d = cut(d.where("active").withColumn("white", F.transform(every, lambda c: draw("field", F.col("seed"), F.col("day_idx"), c))))
    around = F.array(*(F.array(*map(F.lit, n)) for n in near))
    field = F.transform(around, lambda n: F.aggregate(n, F.lit(0.0), lambda a, j: a + F.get("white", j)) / F.sqrt(F.size(n)))
    d = cut(d.withColumn("field", field).drop("white"))
    noise = lambda c: math.sqrt(rho) * F.get("field", c) + math.sqrt(1 - rho) * draw("own", F.col("seed"), F.col("day_idx"), c)
    pnl = F.transform(every, lambda c: F.round(100 * (F.get("mu", c) * F.col("turned") + noise(c)), 2))
    traded = cut(d.select("project", "day_idx", F.posexplode(pnl).alias("combo_id", "pnl")))
    params = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in cells))
    combos = runs.select("project", F.posexplode(params).alias("combo_id", "params")).withColumn("pos", F.transform("params", lambda x: x.cast("int")))
    days = runs.select("project", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("day_idx")).withColumn("date", date(F.col("day_idx")))
    daily = combos.select("project", "combo_id").join(days, "project").join(traded, ["project", "combo_id", "day_idx"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    exits = traded.select("project", "combo_id", date(F.col("day_idx")).alias("date"), F.lit(1).cast("bigint").alias("n"))
    return {"combos": combos, "days": days, "grid_daily": daily, "grid_exits": exits}


def schedule_of(days: DataFrame, split: int, in_days: int) -> DataFrame:
    """(project, window, oos_start, oos_end, in_len, in_type, anchored, grid_row): a schedule that fits a made grid: one window of
    in_days days before day `split`, tried on the days from there on."""
    d = days.groupBy("project").agg(F.max(F.when(F.col("day_idx") == split, F.col("date"))).alias("oos_start"), F.max("date").alias("oos_end"), F.max(F.when(F.col("day_idx") == split - in_days, F.col("date"))).alias("first"))
    return d.select("project", F.lit(1).alias("window"), "oos_start", "oos_end", F.datediff("oos_start", "first").alias("in_len"), F.lit("Day").alias("in_type"), F.lit(False).alias("anchored"), F.lit(1).alias("grid_row"))


def demo_grid(spark: SparkSession) -> dict[str, DataFrame]:
    """A ready example: 240 combinations of three parameters over 1500 days, and a schedule for them."""
    g = planted_grids(spark, [42], (5, 8, 6), "persistent", n_days=1500)
    return g | {"schedule": schedule_of(g["days"], 1000, 500)}


def demo_trades(spark: SparkSession, edge: bool = False) -> dict[str, DataFrame]:
    """A ready example: bars, and 300 trades that have an edge or none."""
    bars = make_bars(spark, 20_000, seed=30)
    return {"bars": bars, "trades": make_trades(bars, 300, seed=31, edge=edge)}


def grid_lines(grid: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(file, line, s): optimisation files of grids, a line for each combination; grid_exits with n trades a row.

    A combination's records meet in one aggregation and no join, since lines are long and a join might broadcast them.
    """
    pnl = F.col("pnl").cast("string")
    day = F.concat_ws(",", F.date_format("date", "yyyyMMdd"), pnl, F.lit("0,0,0,0,0,0"), pnl)
    columns = {"params": "array<double>", "day": "struct<day_idx: int, r: string>", "out": "struct<date: date, n: bigint>"}
    only = lambda d, name, value: d.select("project", "combo_id", *((value if c == name else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))
    records = only(grid["combos"], "params", F.col("params")).union(only(grid["grid_daily"], "day", F.struct("day_idx", day.alias("r")))).union(only(grid["grid_exits"].where("n > 0"), "out", F.struct("date", "n")))
    got = records.groupBy("project", "combo_id").agg(F.first("params", True).alias("params"), F.array_sort(F.collect_list("day")).alias("days"), F.array_sort(F.collect_list("out")).alias("outs"))
    trade = lambda x: F.concat(F.date_format(x["date"], "yyyyMMdd"), F.lit(",1000,X,L,100.0,0,0,0"))
    trades = F.array_join(F.transform("outs", lambda x: F.concat(trade(x), F.repeat(F.concat(F.lit("|"), trade(x)), (x["n"] - 1).cast("int")))), "|")
    row = F.concat(F.array_join(F.transform("params", lambda x: x.cast("string")), ","), F.lit("~v1,1|"), F.array_join(F.col("days.r"), "|"), F.lit("~v2"), F.when(F.size("outs") > 0, F.concat(F.lit("|"), trades)).otherwise(""))
    each = got.where("params is not null and size(days) > 0").select(F.col("project").alias("file"), (F.col("combo_id") + 1).cast("bigint").alias("line"), row.alias("s"))
    return each.union(grid["combos"].select("project").distinct().select("project", F.lit(0).cast("bigint"), F.lit(",".join(names))))


def grid_text(grid: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(file, text): as grid_lines, each file one text."""
    return whole_text(grid_lines(grid, names))


#: Trades of a day that are a row, at most.
RUN = 1000


def grid_records(grid: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(file, line, place, r, n): the records of optimisation files, each n times over; a line's come in order of place. So no row
    grows with the trades. A line's last record, and that of its days, is empty."""
    on = ["project", "combo_id"]
    combos = grid["combos"].join(grid["grid_daily"].select(*on).distinct(), on, "left_semi")
    row = lambda d, kind, a, b, r, n=F.lit(1): d.select(F.col("project").alias("file"), (F.col("combo_id") + 1).cast("bigint").alias("line"), F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("place"), r.alias("r"), n.cast("int").alias("n"))
    top = F.when(F.row_number().over(Window.partitionBy("project").orderBy("combo_id")) == 1, F.lit(",".join(names))).otherwise("")
    heads = row(combos.withColumn("top", top), 0, F.lit(0), F.lit(0), F.concat("top", F.lit("\n"), F.array_join(F.transform("params", lambda x: x.cast("string")), ","), F.lit("~v1,1")))
    pnl = F.col("pnl").cast("string")
    day = F.concat_ws(",", F.date_format("date", "yyyyMMdd"), pnl, F.lit("0,0,0,0,0,0"), pnl)
    days = row(grid["grid_daily"].join(combos, on, "left_semi"), 1, F.col("day_idx"), F.lit(0), day)
    runs = grid["grid_exits"].where("n > 0").join(combos, on, "left_semi").withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))))
    trades = row(runs, 3, F.unix_date("date"), F.col("run"), F.concat(F.date_format("date", "yyyyMMdd"), F.lit(",1000,X,L,100.0,0,0,0")), F.least(F.lit(RUN), F.col("n") - RUN * F.col("run")))
    return heads.union(days).union(row(combos, 2, F.lit(0), F.lit(0), F.lit("~v2"))).union(trades)
