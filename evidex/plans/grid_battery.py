"""The grid battery: windows, surfaces, region lift with its nulls, rank correlation, plateau, selection, verdict, base setting.

Many projects run as one job; each step's small table is kept where later steps read it again. Only the checks, a few rows
a project, decide anything on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import components as K
from evidex.operators import grid as G
from evidex.operators import region as R
from evidex.operators import wfc as W
from evidex.plans.export import nested, to_json
from evidex.session import cut

MANY_VARIANTS = 3.0


class GridValidationFailed(ValueError):
    def __init__(self, checks: list):
        super().__init__("; ".join(f"{c['project']} {c['name']}" for c in checks))
        self.checks = checks


@dataclass
class GridBattery:
    windows: DataFrame
    checks: DataFrame
    region: DataFrame
    correlation: DataFrame
    pooled_correlation: DataFrame
    plateau: DataFrame
    selection: DataFrame
    effective_trials: DataFrame
    verdict: DataFrame
    base: DataFrame
    trades: DataFrame
    meta: DataFrame

    def json(self) -> DataFrame:
        """(project, json): each project's whole result."""
        many = {k: getattr(self, k) for k in ("windows", "checks", "region", "correlation", "plateau", "selection", "effective_trials", "base", "trades", "meta")}
        return to_json(nested(self.verdict, many, ["project"]), ["project"])


def validate(combos: DataFrame, names: DataFrame, groups: DataFrame, schedule: DataFrame) -> DataFrame:
    """(project, name, passed, severity): does a schedule describe the grid? groups: (project, param_names, n_iterations, fitness_abbr);
    names: (project, names); schedule: (project, window, grid_row, params)."""
    shape = G.shape(combos).groupBy("project").agg(F.first("n_iter").alias("n_iter"), F.first("is_full").alias("is_full"))
    near = F.forall(F.zip_with("params", "grid_params", lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9 + 1e-5 * F.abs(b), F.lit(False))), lambda x: x)
    on = schedule.join(combos.select("project", (F.col("combo_id") + 1).alias("grid_row"), F.col("params").alias("grid_params")), ["project", "grid_row"], "left")
    on = on.groupBy("project").agg(F.every(F.coalesce(near, F.lit(False))).alias("on_grid"), F.count("*").alias("n_windows"))
    a = groups.join(shape, "project").join(names, "project").join(on, "project", "left")
    rows = [
        ("param_names_match", F.col("names") == F.col("param_names"), "error"),
        ("iteration_count", F.col("n_iter") == F.col("n_iterations"), "error"),
        ("full_grid", F.col("is_full"), "warn"),
        ("picks_on_grid", F.coalesce("on_grid", F.lit(True)), "error"),
        ("windows_present", F.coalesce("n_windows", F.lit(0)) > 0, "error"),
        ("fitness_supported", F.col("fitness_abbr").isin(*G.METRICS), "warn"),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), F.lit(s).alias("severity")) for n, p, s in rows))
    return a.select("project", F.explode(each).alias("c")).select("project", "c.*")


def run(combos: DataFrame, daily: DataFrame, exits: DataFrame, days: DataFrame, schedule: DataFrame | None = None, scheme: str = "schedule", metric: str = "NP", checks: DataFrame | None = None, n_null: int = 999, n_boot: int = 500, seed: int = 0, min_trades: int = 10, alpha: float = 0.05, null: str = "signflip", block: int = R.BLOCK) -> GridBattery:
    """Every test of every project. schedule is needed for scheme `schedule`; the other schemes pick the best in-sample combination."""
    if scheme not in G.SCHEMES or null not in W.NULLS:
        raise ValueError(f"scheme must be one of {G.SCHEMES} and null one of {W.NULLS}")
    if checks is not None and (bad := checks.where("not passed and severity = 'error'").limit(100).collect()):
        raise GridValidationFailed([r.asDict() for r in bad])
    windows = cut(G.schedule_windows(schedule, days) if scheme == "schedule" else G.custom_windows(days, scheme))
    metrics = cut(G.surface_metrics(daily, windows))
    counts = cut(G.exit_counts(exits, combos, windows))
    pairs = cut(G.metric_pairs(metrics, metric, counts, min_trades))
    if scheme != "schedule":
        windows = cut(windows.drop("pick").join(G.best_pick(pairs), G.WINDOW))
    whole = cut(G.metric_pairs(metrics, "NP"))
    r = cut(R.region(whole, combos))
    blocks = cut(R.block_sums(daily, windows, block))
    n = R.n_blocks(blocks)
    signs, boots = R.signs(windows, n, n_null, seed), R.picks(n, n_null, seed)
    lifts = R.lifts(r).join(windows.select(*G.WINDOW, "complete"), G.WINDOW)
    flip, boot = cut(R.lift_draws(r, blocks, signs)), cut(R.lift_draws(r, R.centred(blocks), boots))
    patterns = cut(R.distinct_patterns(daily, windows))
    surfaces = cut(R.surface_draws(blocks, signs))
    precision = R.precision(r, patterns)
    p_precision = R.window_p(R.precision_draws(r, surfaces, combos), precision, "null_precision", "precision").where("precision is not null").select(*G.WINDOW, F.col("p").alias("p_precision"))
    ridge_is, ridge_oos = cut(K.ridges(r, combos, "x_pooled")), cut(K.ridges(r, combos, "y_pooled"))
    centre = K.centres(r, ridge_is, combos, "x_pooled")
    per_window = lambda d, name: R.window_p(d, lifts, "null_lift", "lift").select(*G.WINDOW, F.col("p").alias(name))
    rules = G.best_pick(whole).select(*G.WINDOW, F.lit("best_is").alias("rule"), F.col("pick").alias("combo_id")).union(r.where("place = 1").select(*G.WINDOW, F.lit("best_pooled"), "combo_id")).union(windows.where("pick is not null").select(*G.WINDOW, F.lit("pick"), "pick")).union(centre.select(*G.WINDOW, F.lit("centre"), "centre"))
    pct = R.pick_percentiles(r, rules).groupBy(*G.WINDOW).agg(F.array_sort(F.collect_list(F.struct("rule", "pct"))).alias("pct"))
    region = lifts.join(per_window(flip, "p_lift"), G.WINDOW).join(per_window(boot, "p_lift_boot"), G.WINDOW).join(patterns, G.WINDOW).join(precision, G.WINDOW).join(p_precision, G.WINDOW, "left").join(R.ridge_overlap(r, ridge_is, ridge_oos, combos), G.WINDOW, "left").join(centre.select(*G.WINDOW, "centre", "is_peak"), G.WINDOW).join(pct, G.WINDOW, "left")
    read = R.reading(F.col("p_lift"), F.col("region_oos_mean"), F.col("grid_oos_mean"), R.scoreable(F.col("n_distinct"), F.col("k")), alpha)
    region = cut(region.withColumns({"reading": read, "margin": F.col("region_oos_mean") - F.col("grid_oos_mean"), "jaccard": F.when(R.scoreable(F.col("n_distinct"), F.col("k")), F.col("jaccard"))}))
    draws = surfaces if null == "signflip" and metric == "NP" else None
    if null == "torus":
        draws = W.torus_draws(pairs, combos, G.shape(combos), n_null, seed)
    elif draws is None:
        draws = R.path_draws(daily, windows, signs, metric, block)
    rho = cut(W.spearman_draws(pairs, draws))
    corr = cut(W.correlations(pairs))
    in_sample = G.sides(daily, windows.where("complete")).where("side = 'is'").join(windows.select(*G.WINDOW, F.col("is_first").alias("f_")), G.WINDOW)
    in_sample = cut(in_sample.select(*G.WINDOW, "combo_id", (F.col("day_idx") - F.col("f_")).cast("int").alias("day"), "pnl"))
    trials = cut(W.effective_trials(in_sample.withColumnRenamed("day", "day_idx")))
    selection = W.reality_check(in_sample, windows, n_boot, seed=seed)
    whole_p = lambda d, name: R.pooled_p(d, lifts, "null_lift", "lift").select("project", F.col("p").alias(name))
    guard = region.where("complete").groupBy("project").agg(F.avg("lift").alias("lift"), F.avg("region_oos_mean").alias("region_oos_mean"), F.avg("grid_oos_mean").alias("grid_oos_mean"), F.percentile("n_distinct", 0.5).alias("n_distinct"), F.first("k").alias("k"), F.count_if(F.col("margin") > 0).alias("windows_ahead"), F.count("*").alias("windows_complete"))
    verdict = windows.select("project").distinct().join(guard, "project", "left").join(whole_p(flip, "p_lift"), "project", "left").join(whole_p(boot, "p_lift_boot"), "project", "left").join(trials.groupBy("project").agg(F.percentile("n_eff", 0.5).alias("n_eff")), "project", "left")
    read = F.when(F.col("windows_complete").isNull(), "insufficient").otherwise(R.reading(F.col("p_lift"), F.col("region_oos_mean"), F.col("grid_oos_mean"), R.scoreable(F.col("n_distinct"), F.col("k")), alpha))
    trades = cut(G.trade_medians(counts, min_trades))
    scores = cut(W.plateau(pairs, windows, combos))
    oos = trades.join(windows.where("complete").select(*G.WINDOW), G.WINDOW).groupBy("project").agg(F.percentile("oos_trades_median", 0.5).alias("oos_trades_median"))
    verdict = verdict.join(oos, "project", "left").join(W.pooled_plateau(scores, windows).select("project", F.col("pooled_score").alias("plateau_score")), "project", "left")
    verdict = cut(verdict.withColumns({"reading": read, "gate": R.gate(read), "few_variants": F.coalesce(F.col("n_eff") < MANY_VARIANTS, F.lit(False)), "nulls_disagree": R.nulls_disagree(F.col("p_lift"), F.col("p_lift_boot"), alpha)}))
    dropped = counts.groupBy(*G.WINDOW, "combo_id").agg(F.min("n_trades").alias("n")).groupBy("project").agg((F.count_if(F.col("n") < min_trades) == 0).alias("passed")).select("project", F.lit("min_trades").alias("name"), "passed", F.lit("warn").alias("severity"))
    every = dropped if checks is None else checks.select("project", "name", "passed", "severity").union(dropped)
    base = K.base_setting(daily, days, windows, combos, verdict.select("project", "reading"), scheme)
    told = {"metric": metric, "window_scheme": scheme, "pick_from": "schedule" if scheme == "schedule" else "best in-sample", "n_null": n_null, "n_boot": n_boot, "seed": seed, "min_trades": min_trades, "alpha": alpha, "null": null, "block": block}
    meta = run_facts(combos, days, windows).withColumns({k: F.lit(v) for k, v in told.items()})
    return GridBattery(windows, every, region, W.correlation_test(corr, rho, alpha), W.pooled_test(corr, rho, windows, alpha), scores, selection, trials, verdict, base, trades, meta)


def run_facts(combos: DataFrame, days: DataFrame, windows: DataFrame) -> DataFrame:
    """(project, shape, n_iter, region_k, n_days, dates_start, dates_end, n_windows, n_complete): what a run was about."""
    axes = G.shape(combos).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "size"))), lambda x: x["size"]).alias("shape"), F.first("n_iter").alias("n_iter"))
    d = days.groupBy("project").agg(F.count("*").alias("n_days"), F.min("date").alias("dates_start"), F.max("date").alias("dates_end"))
    w = windows.groupBy("project").agg(F.count("*").alias("n_windows"), F.count_if("complete").alias("n_complete"))
    return axes.join(d, "project").join(w, "project", "left").withColumn("region_k", G.region_size(F.col("n_iter")))
