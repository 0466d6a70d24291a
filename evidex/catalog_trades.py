"""Trade-side queries over the driver's tables, each with SQL of its own for the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import scalars as S
from evidex.operators import costs as C
from evidex.operators import drawdown as D
from evidex.operators import nulls as N
from evidex.operators import temporal as X
from evidex.operators import timing as G
from evidex.operators import trades as T
from evidex.session import cut
from evidex.sources import tables

PV = tables.POINT_VALUE
#: Draws of the null and the delays looked at, the operators' defaults.
N_PERM, MAX_K = 1_000, 10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


class Inputs:
    """What the trade queries share; each piece is built once in a query, when it is first asked for."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def bars(self) -> DataFrame:
        return cut(tables.bars(self.spark, self.sf))

    @cached_property
    def trades(self) -> DataFrame:
        return tables.trades(self.spark, self.sf, bars=self.bars)

    @cached_property
    def joined(self) -> DataFrame:
        return T.join_bars(self.trades, self.bars)

    @cached_property
    def based(self) -> DataFrame:
        return T.with_baseline(self.joined, self.bars)

    @cached_property
    def pnl(self) -> DataFrame:
        return self.trades.select("strategy_id", "trade_id", "entry_time", "exit_time", F.round(T.usd_per_contract(PV), 2).alias("pnl"))

    def points(self, leg: str, mode: str = "fixed_exit", early: bool = False) -> DataFrame:
        return G.shifted(self.joined, self.bars, leg, mode, MAX_K, early, PV)


def _curve(leg, mode="fixed_exit", early=False):
    return lambda i: rounded(G.delay_curve(i.points(leg, mode, early)), 9)


def _drawdown(i):
    return rounded(D.drawdown_summary(i.pnl).drop("worst", "capital_basis"), 4)


def _margin(i):
    d = D.drawdown_summary(i.pnl).select("strategy_id", "capital")
    return rounded(d.withColumns(D.margin_ratios(F.col("capital"), F.lit(1500.0))))


#: Symbols of the cost lookup, by strategy_id modulo 5: a large and a micro contract, months, and an unknown root.
COST_SYMBOLS = ("@ES", "@MNQ", "MESZ26", "@m2k", "@XYZZY")


def _cost_lookup(i):
    t = i.trades.withColumn("symbol", F.element_at(F.array(*map(F.lit, COST_SYMBOLS)), (F.col("strategy_id") % 5 + 1).cast("int")))
    return rounded(C.cost_per_strategy(t))


def _date_join(i):
    """Daily bars; trades carry dates only, so they are joined by date."""
    b = i.bars.withColumn("d", F.to_date("ts"))
    daily = b.groupBy("symbol", "d").agg(F.min_by("open", "bar_idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), (F.max("ts")).alias("ts"))
    daily = daily.select("symbol", F.datediff("d", F.lit("2024-01-01").cast("date")).cast("bigint").alias("bar_idx"), "ts", "open", "high", "low")
    midnight = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias(c)
    t = i.trades.select("strategy_id", "trade_id", "symbol", midnight("entry_time"), midnight("exit_time"), "entry_price", "exit_price")
    flag = T.dates_only(t, daily).select("strategy_id", "by_date")
    return T.join_bars(t, daily, by_date=True).join(flag, "strategy_id").select("strategy_id", "trade_id", "by_date", "entry_idx", "exit_idx", "hold_bars")


def _histogram(i):
    """Drawdown depths in 30 bins of equal width for each strategy."""
    d = D.episodes(D.equity(i.pnl)).select("strategy_id", (-F.col("depth")).alias("x"))
    from evidex.plans.views import histogram

    return rounded(histogram(d, ["strategy_id"], "x", 30), 4)


def _portfolio(i):
    """All trades as one strategy: a single key with every row."""
    return D.equity(i.pnl.withColumn("strategy_id", F.lit(0).cast("bigint")))


def _table(i, name: str) -> DataFrame:
    return i.spark.read.parquet(f"{i.sf}/{name}.parquet")


def _one_of(key: str, *cells) -> F.Column:
    """The cell that the key modulo their number names."""
    n = F.col(key) % len(cells)
    return F.coalesce(*(F.when(n == k, c) for k, c in enumerate(cells)))


def _money(i):
    """Order totals as reports write money."""
    usd = lambda fmt: F.format_string(fmt, F.col("o_totalprice"))
    s = _one_of("o_orderkey", usd("$%.2f"), usd("($%.2f)"), usd(" -%,.2f%% "), F.lit("n/a"), usd("($%,.2f)"), F.lit(""), usd("%,.2f"))
    return rounded(_table(i, "orders").select(F.col("o_orderkey").alias("id"), S.money(s).alias("v")), 2)


def _stamps(i):
    """Times of events as reports write them: to the minute, as dates, and in layouts that are none."""
    at = lambda fmt: F.date_format("ts", fmt)
    s = _one_of("event_id", at("M/d/yyyy HH:mm"), at("M/d/yyyy"), at("yyyy-MM-dd HH:mm"), at("MM/dd/yyyy H:mm"), F.lit(""))
    return _table(i, "events").select(F.col("event_id").alias("id"), S.stamp(s).alias("v"), S.is_date_only(s).alias("date_only"))


def _intervals(i):
    """Labels of bar intervals, the size of a part being the number."""
    n = F.col("p_size").cast("string")
    s = _one_of("p_partkey", F.concat(n, F.lit(" min.")), F.concat(n, F.lit(" hour")), F.lit("Daily"), F.concat(n, F.lit(" ticks")), F.lit("weekly"), F.concat(n, F.lit("min")), F.lit(None))
    return _table(i, "part").select(F.col("p_partkey").alias("id"), S.interval_minutes(s).alias("v"))


#: Month codes of futures.
MONTHS = "FGHJKMNQUVXZ"


def _roots(i):
    """Symbols of made-up contracts: a root from a customer's segment and nation, with and without month and year."""
    root = F.concat(F.substring("c_mktsegment", 1, 2), F.char(65 + F.col("c_nationkey")))
    code = F.concat(F.substring(F.lit(MONTHS), (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(1)), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    s = _one_of("c_custkey", F.concat(F.lit("@"), root), F.concat(root, code), F.lower(root), F.concat(F.lit("@"), F.lower(root), F.lower(code)))
    return _table(i, "customer").select(F.col("c_custkey").alias("id"), S.symbol_root(s).alias("v"))


#: Ends of parameter names.
SUFFIXES = ("StopATR", "ProfitTarget", "Length", "SL", "fastFAC", "BarsBack", "Mystery", "TgtDollar", "Period", "_stop_pts", "TPSize")


def _axis_names(i):
    """Parameter names: a part's name in camel case and an ending."""
    s = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), _one_of("p_partkey", *map(F.lit, SUFFIXES)))
    return _table(i, "part").select(F.col("p_partkey").alias("id"), S.axis_class(s).alias("v"))


def queries() -> dict:
    def query(f):
        return lambda spark, sf: f(Inputs(spark, sf))

    each = {
        "bars_from_events": lambda i: i.bars,
        "bar_interval_mode": lambda i: T.bar_interval(i.bars),
        "trades_joined": lambda i: T.join_bars(tables.trades(i.spark, i.sf, True, i.bars), i.bars).select("strategy_id", "trade_id", F.coalesce("entry_idx", F.lit(-1)).cast("bigint").alias("entry_idx"), F.coalesce("exit_idx", F.lit(-1)).cast("bigint").alias("exit_idx"), "hold_bars"),
        "date_only_join": _date_join,
        "join_checks": lambda i: T.join_checks(i.joined, i.bars),
        "cost_basis": lambda i: T.cost_basis(i.joined),
        "pct_usd_returns": lambda i: rounded(i.joined.select("strategy_id", "trade_id", T.pct_return().alias("pct"), T.usd_per_contract(PV).alias("usd")), 8),
        "forward_returns_h": lambda i: rounded(T.forward_returns(i.bars, i.spark.createDataFrame([("@ES", h) for h in (1, 5, 24)], "symbol string, hold bigint")).select("hold", "bar_idx", "fwd"), 8),
        "matched_baseline": lambda i: rounded(i.based.select("strategy_id", "trade_id", "hold", "base_mean", "base_win"), 8),
        "baseline_lift": lambda i: rounded(T.lift(i.based), 8),
        "random_entry_null": lambda i: rounded(N.random_entry_test(i.based, i.bars, N_PERM), 6),
        "temporal_windows": lambda i: rounded(X.window_results(i.joined, i.bars, PV)),
        "temporal_score": lambda i: rounded(X.window_score(X.window_results(i.joined, i.bars, PV))),
        "rolling_volatility": lambda i: rounded(X.volatility(i.bars).select("bar_idx", "vol"), 8),
        "crisis_split": lambda i: rounded(X.regime_results(i.joined, i.bars, PV)),
        "yearly_pnl": lambda i: rounded(X.yearly(i.trades, PV), 4),
        "cost_curve": lambda i: rounded(C.cost_curve(i.based, C.cost_per_strategy(i.trades), PV)),
        "cost_summary": lambda i: rounded(C.cost_summary(i.based, C.cost_per_strategy(i.trades), PV)),
        "cost_lookup_fallback": _cost_lookup,
        "equity_curve": lambda i: rounded(D.equity(i.pnl).select("strategy_id", "trade_id", F.col("seq").cast("bigint").alias("seq"), "eq", "dd"), 4),
        "drawdown_episodes": lambda i: rounded(D.episodes(D.equity(i.pnl)).select("strategy_id", *(F.col(c).cast("bigint").alias(c) for c in ("peak_i", "trough_i", "recovery_i")), "depth"), 4),
        "cdar_capital": _drawdown,
        "sharpe_sortino": lambda i: rounded(D.sharpe_sortino(i.pnl)),
        "margin_check": _margin,
        "delay_entry_fixed_exit": _curve("entry"),
        "delay_entry_fixed_hold": _curve("entry", "fixed_hold"),
        "delay_exit": _curve("exit"),
        "delay_entry_early": _curve("entry", early=True),
        "delay_entry_early_fixed_hold": _curve("entry", "fixed_hold", early=True),
        "delay_exit_early": _curve("exit", early=True),
        "first_nonpositive_k": lambda i: G.first_nonpositive(G.delay_curve(i.points("exit"))),
        "paired_change": lambda i: rounded(G.paired_change(i.points("entry"))),
        "money_parse": _money,
        "interval_parse": _intervals,
        "root_normalise": _roots,
        "axis_class": _axis_names,
        "stamp_parse": _stamps,
        "portfolio_equity": lambda i: rounded(_portfolio(i).select("trade_id", F.col("seq").cast("bigint").alias("seq"), "eq", "dd"), 4),
        "portfolio_episodes": lambda i: rounded(D.episodes(_portfolio(i)).select(*(F.col(c).cast("bigint").alias(c) for c in ("peak_i", "trough_i", "recovery_i")), "depth"), 4),
        "histogram_view": _histogram,
    }
    return {name: query(f) for name, f in each.items()}


BARS = """bars AS (SELECT '@ES' AS symbol, row_number() OVER (ORDER BY hour) - 1 AS bar_idx, hour AS ts, open, high, low, close, volume FROM
  (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1))"""
TRADES = (
    BARS
    + """, tr AS (SELECT e.user_id % 8 AS strategy_id, e.event_id AS trade_id, CASE WHEN e.event_id % 2 = 0 THEN 1 ELSE -1 END AS direction, b.bar_idx AS entry_idx, x.bar_idx AS exit_idx, b.ts AS entry_time, x.ts AS exit_time,
  b.open AS entry_price, x.open AS exit_price, 1 + e.event_id % 3 AS contracts, 1 + e.event_id % 24 AS hold FROM events e JOIN bars b ON date_trunc('hour', e.ts) = b.ts JOIN bars x ON x.bar_idx = b.bar_idx + 1 + e.event_id % 24 WHERE e.event_type = 'purchase'),
t AS (SELECT *, round(2.0 * direction * (exit_price - entry_price) * contracts, 2) AS gross_pnl, direction * (exit_price / entry_price - 1.0) AS pct, direction * (exit_price - entry_price) * 2.0 AS usd FROM tr)"""
)
FWD = ", fwd AS (SELECT h.hold, b.bar_idx, x.open / b.open - 1.0 AS f FROM (SELECT DISTINCT hold FROM t) h, bars b JOIN bars x ON x.bar_idx = b.bar_idx + h.hold)"
BASE = FWD + ", dr AS (SELECT hold, avg(f) AS mu, avg((f > 0)::DOUBLE) AS up, avg((f < 0)::DOUBLE) AS dn FROM fwd GROUP BY hold), bs AS (SELECT t.*, direction * mu AS base_mean, CASE WHEN direction > 0 THEN up ELSE dn END AS base_win FROM t JOIN dr USING (hold))"
PNL = TRADES + ", p AS (SELECT strategy_id, trade_id, entry_time, exit_time, round(usd, 2) AS pnl FROM t), eq AS (SELECT *, row_number() OVER w - 1 AS seq, sum(pnl) OVER w AS eq FROM p WINDOW w AS (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)), ed AS (SELECT *, eq - greatest(0.0, max(eq) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS dd FROM eq)"
EPS = (
    PNL
    + """, il AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island, max(seq) OVER (PARTITION BY strategy_id) AS fin FROM ed),
ep AS (SELECT strategy_id, min(seq) - 1 AS peak_i, first(seq ORDER BY dd, seq) AS trough_i, CASE WHEN max(seq) < max(fin) THEN max(seq) + 1 END AS recovery_i, min(dd) AS depth FROM il WHERE dd < 0 GROUP BY strategy_id, island)"""
)
STATS = ", ss AS (SELECT strategy_id, count(*) AS n_trades, greatest(date_sub('day', min(entry_time), max(exit_time)), 1) / 365.25 AS years, sum(pnl) AS sum_usd, avg(pnl) AS m, stddev_samp(pnl) AS s, sqrt(avg(pow(least(pnl, 0.0), 2))) AS d FROM p GROUP BY strategy_id), sr AS (SELECT strategy_id, n_trades, years, sum_usd, coalesce(m / nullif(s, 0) * sqrt(n_trades / years), 0) AS sharpe, coalesce(m / nullif(d, 0) * sqrt(n_trades / years), 0) AS sortino FROM ss)"
DD = (
    EPS
    + STATS
    + """, et AS (SELECT ep.*, coalesce(a.exit_time, f.fe) AS pk, b.exit_time AS tt, c.exit_time AS rt FROM ep JOIN (SELECT strategy_id, min(entry_time) AS fe FROM p GROUP BY 1) f USING (strategy_id)
  LEFT JOIN eq a ON a.strategy_id = ep.strategy_id AND a.seq = peak_i LEFT JOIN eq b ON b.strategy_id = ep.strategy_id AND b.seq = trough_i LEFT JOIN eq c ON c.strategy_id = ep.strategy_id AND c.seq = recovery_i),
ea AS (SELECT strategy_id, count(*) AS n_episodes, sum(CASE WHEN recovery_i IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unrecovered, max(-depth) AS max_dd, avg(-depth) AS mean_dd, quantile_cont(-depth, 0.5) AS median_dd,
  avg(date_sub('day', pk, tt)) AS pt_mean, max(date_sub('day', pk, tt))::DOUBLE AS pt_max, avg(date_sub('day', pk, rt)) AS pr_mean, max(date_sub('day', pk, rt))::DOUBLE AS pr_max FROM et GROUP BY 1),
cd AS (SELECT strategy_id, avg(-depth) AS cdar FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY depth, peak_i) AS r, count(*) OVER (PARTITION BY strategy_id) AS n FROM ep) WHERE r <= greatest(1, ceil((1.0 - 0.8::DOUBLE) * n)) GROUP BY 1),
s5 AS (SELECT sr.*, coalesce(n_episodes, 0) AS n_episodes, coalesce(n_unrecovered, 0) AS n_unrecovered, coalesce(max_dd, 0) AS max_dd, coalesce(mean_dd, 0) AS mean_dd, coalesce(median_dd, 0) AS median_dd, coalesce(pt_mean, 0) AS pt_mean, coalesce(pt_max, 0) AS pt_max,
  coalesce(pr_mean, 0) AS pr_mean, coalesce(pr_max, 0) AS pr_max, coalesce(cdar, 0) AS cdar, sum_usd / years AS annual_usd, 5.0 * coalesce(cdar, 0) AS capital FROM sr LEFT JOIN ea USING (strategy_id) LEFT JOIN cd USING (strategy_id))"""
)


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round(({c.split(' AS ')[0]})::DOUBLE, {digits}) AS {c.split(' AS ')[-1]}" for c in cols)


def _subset_sql(mask: str, key: str) -> str:
    """Means against the drift of the bars under a mask (bar_idx, key)."""
    return f""", mk AS ({mask}), fm AS (SELECT {key}, hold, avg(f) AS mu FROM fwd JOIN mk USING (bar_idx) GROUP BY 1, 2),
sb AS (SELECT t.strategy_id, mk.{key}, count(*) AS n, avg(pct) AS mean, avg(direction * mu) AS baseline, avg((pct > 0)::DOUBLE) AS win_rate, sum(usd) AS usd_sum FROM t JOIN mk ON mk.bar_idx = t.entry_idx LEFT JOIN fm ON fm.{key} = mk.{key} AND fm.hold = t.hold GROUP BY 1, 2)"""


W4 = _subset_sql('SELECT bar_idx, ntile(4) OVER (ORDER BY bar_idx) AS "window" FROM bars', '"window"')
VOL = ", rt AS (SELECT bar_idx, close / lag(close) OVER (ORDER BY bar_idx) - 1 AS r FROM bars), vo AS (SELECT bar_idx, stddev_samp(r) OVER (ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM rt)"
WIN = (
    "WITH "
    + TRADES
    + FWD
    + W4
    + """, sp AS (SELECT "window", min(ts) AS start, max(ts) AS "end" FROM mk JOIN bars USING (bar_idx) GROUP BY 1), ww AS (SELECT s.strategy_id, sp."window", sp.start, sp."end", coalesce(n, 0) AS n, CASE WHEN n >= 10 THEN mean END AS mean, CASE WHEN n >= 10 THEN baseline END AS baseline,
  CASE WHEN n >= 10 THEN win_rate END AS win_rate, coalesce(usd_sum, 0) AS usd_sum, coalesce(n >= 10, false) AS counted FROM (SELECT DISTINCT strategy_id FROM t) s CROSS JOIN sp LEFT JOIN sb ON sb.strategy_id = s.strategy_id AND sb."window" = sp."window") """
)
COSTC = ", co AS (SELECT 30.0::DOUBLE AS cost), ga AS (SELECT strategy_id, avg(usd) AS g, avg(base_mean * entry_price * 2.0) AS b, sum(greatest(usd - 30.0, 0)) AS won, sum(greatest(30.0 - usd, 0)) AS lost FROM bs GROUP BY 1)"


def _delay_sql(leg: str, mode: str, early: bool) -> str:
    s = "-" if early else "+"
    if leg == "exit":
        alive, en, ex = ("exit_idx - k > entry_idx" if early else "exit_idx + k <= lasti"), "entry_price", f"(SELECT open FROM bars WHERE bar_idx = exit_idx {s} k)"
    elif mode == "fixed_exit":
        alive, en, ex = ("entry_idx - k >= 0" if early else "entry_idx + k < exit_idx"), f"(SELECT open FROM bars WHERE bar_idx = entry_idx {s} k)", "exit_price"
    else:
        alive, en, ex = ("entry_idx - k >= 0" if early else "exit_idx + k <= lasti"), f"(SELECT open FROM bars WHERE bar_idx = entry_idx {s} k)", f"(SELECT open FROM bars WHERE bar_idx = exit_idx {s} k)"
    return (
        TRADES
        + f""", kk AS (SELECT t.*, k, (SELECT max(bar_idx) FROM bars) AS lasti FROM t CROSS JOIN (SELECT unnest(range(0, {MAX_K + 1})) AS k)), ka AS (SELECT *, k = 0 OR ({alive}) AS alive FROM kk),
kp AS (SELECT *, CASE WHEN k = 0 THEN entry_price ELSE {en} END AS ep, CASE WHEN k = 0 THEN exit_price ELSE {ex} END AS xp FROM ka), pt AS (SELECT strategy_id, trade_id, k, alive, CASE WHEN alive THEN direction * (xp / ep - 1.0) END AS pct2, CASE WHEN alive THEN direction * (xp - ep) * 2.0 END AS u FROM kp),
cv AS (SELECT strategy_id, k, sum(alive::INT)::BIGINT AS n_alive, sum((NOT alive)::INT)::BIGINT AS n_skipped, coalesce(sum(u), 0) AS total_usd, avg(u) AS mean_usd, avg(pct2) AS mean_pct, avg((u > 0)::DOUBLE) AS win_rate, sum(CASE WHEN u > 0 THEN u ELSE 0 END) AS won, sum(CASE WHEN u < 0 THEN -u ELSE 0 END) AS lost FROM pt GROUP BY 1, 2)"""
    )


def _curve_sql(leg: str, mode: str = "fixed_exit", early: bool = False) -> str:
    return f"WITH {_delay_sql(leg, mode, early)} SELECT c.strategy_id, c.k::INTEGER AS k, c.n_alive, c.n_skipped, {_r('c.total_usd AS total_usd', 'c.mean_usd AS mean_usd', 'c.mean_pct AS mean_pct', 'c.win_rate AS win_rate', digits=9)}, round(CASE WHEN c.lost > 0 THEN c.won / c.lost WHEN c.won > 0 THEN 'Infinity'::DOUBLE END, 9) AS profit_factor, round(CASE WHEN b.total_usd > 0 THEN c.total_usd / b.total_usd END, 9) AS retention FROM cv c JOIN cv b ON b.strategy_id = c.strategy_id AND b.k = 0"


def _words(ws, how: str) -> str:
    return " OR ".join(f"contains(lower(s), '{w}')" if how == "part" else f"list_contains(list_transform(regexp_extract_all(regexp_replace(s, '([A-Z][a-z])', ' \\1', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\\d+'), lambda x: lower(x)), '{w}')" for w in ws)


def _cells(key: str, *cells: str) -> str:
    return f"CASE {key} % {len(cells)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cells)) + " END"


def _all_as_one(sql: str) -> str:
    return sql.replace("p AS (SELECT strategy_id,", "p AS (SELECT 0::BIGINT AS strategy_id,")


_costs = "(VALUES " + ", ".join(f"('{k}', {round(2 * (c + s), 4)}::DOUBLE)" for k, (c, s) in S.COSTS.items()) + ") rc(root, rt)"
BASIS = "cb AS (SELECT strategy_id, 2 * (2.2 + 0.5::DOUBLE) AS c, gross_pnl, contracts, round(gross_pnl - 2 * (2.2 + 0.5::DOUBLE), 2) AS net_pnl FROM t)"


def oracle_sql() -> dict[str, str]:
    return {
        "bars_from_events": f"WITH {BARS} SELECT * FROM bars",
        "bar_interval_mode": f"WITH {BARS}, d AS (SELECT symbol, date_diff('minute', lag(ts) OVER (ORDER BY ts), ts) AS minutes FROM bars) SELECT symbol, minutes FROM d WHERE minutes IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, minutes LIMIT 1",
        "trades_joined": f"WITH {TRADES}, m AS (SELECT *, CASE WHEN trade_id % 97 = 0 THEN entry_time + INTERVAL 7 MINUTE ELSE entry_time END AS et FROM t) SELECT m.strategy_id, m.trade_id, coalesce(b.bar_idx, -1) AS entry_idx, coalesce(x.bar_idx, -1) AS exit_idx, x.bar_idx - b.bar_idx AS hold_bars FROM m LEFT JOIN bars b ON b.ts = et LEFT JOIN bars x ON x.ts = m.exit_time",
        "date_only_join": f"WITH {TRADES}, dd AS (SELECT CAST(ts AS DATE) AS d, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i FROM bars GROUP BY 1, 2) SELECT strategy_id, trade_id, true AS by_date, a.i AS entry_idx, b.i AS exit_idx, b.i - a.i AS hold_bars FROM t LEFT JOIN dd a ON a.d = CAST(entry_time AS DATE) LEFT JOIN dd b ON b.d = CAST(exit_time AS DATE)",
        "join_checks": f"""WITH {TRADES}, {BASIS}, pv AS (SELECT strategy_id, round_even(sum(gross_pnl * pts) / sum(pts * pts), 4) AS pv FROM (SELECT *, direction * (exit_price - entry_price) * contracts AS pts FROM t) WHERE pts <> 0 GROUP BY 1),
rs AS (SELECT t.strategy_id, max(abs(gross_pnl - round_even(pv * direction * (exit_price - entry_price) * contracts, 2))) AS res FROM t JOIN pv USING (strategy_id) WHERE exit_price <> entry_price GROUP BY 1),
a AS (SELECT strategy_id, count(*) AS n, avg(exit_idx - entry_idx) + 1.0 AS held FROM t GROUP BY 1), g AS (SELECT strategy_id, least(max(abs(gross_pnl - c - net_pnl)), max(abs(gross_pnl - c * contracts - net_pnl))) AS gap FROM cb GROUP BY 1)
SELECT strategy_id, u.name, u.passed, u.severity, round(u.value::DOUBLE, 6) AS value FROM a JOIN pv USING (strategy_id) JOIN rs USING (strategy_id) JOIN g USING (strategy_id) CROSS JOIN LATERAL (VALUES ('has_trades', true, 'error', n::DOUBLE), ('timestamps_found', true, 'error', 0), ('exit_after_entry', true, 'error', 0),
('prices_in_bar_range', true, 'error', 1), ('point_value_constant', res <= 0.011, 'error', pv), ('net_reconciles', gap < 0.011, 'warn', gap), ('hold_matches_summary', true, 'warn', held), ('interval_matches_bars', true, 'error', 60), ('min_trades', n >= 30, 'warn', n)) u(name, passed, severity, value)""",
        "cost_basis": f"WITH {TRADES}, {BASIS} SELECT strategy_id, CASE WHEN max(abs(gross_pnl - c - net_pnl)) < 0.011 THEN 'per_trade' WHEN max(abs(gross_pnl - c * contracts - net_pnl)) < 0.011 THEN 'per_contract' ELSE 'unknown' END AS cost_basis FROM cb GROUP BY 1",
        "pct_usd_returns": f"WITH {TRADES} SELECT strategy_id, trade_id, {_r('pct', 'usd', digits=8)} FROM t",
        "forward_returns_h": f"WITH {BARS} SELECT hold, b.bar_idx, round(x.open / b.open - 1.0, 8) AS fwd FROM (SELECT unnest([1, 5, 24])::BIGINT AS hold), bars b JOIN bars x ON x.bar_idx = b.bar_idx + hold",
        "matched_baseline": f"WITH {TRADES}{BASE} SELECT strategy_id, trade_id, hold, {_r('base_mean', 'base_win', digits=8)} FROM bs",
        "baseline_lift": f"WITH {TRADES}{BASE} SELECT strategy_id, count(*) AS n_trades, {_r('avg(pct) AS observed_mean', 'avg(base_mean) AS baseline_mean', 'avg((pct > 0)::INT) AS observed_win_rate', 'avg(base_win) AS baseline_win_rate', 'avg(pct) - avg(base_mean) AS lift', digits=8)} FROM bs GROUP BY 1",
        "random_entry_null": f"""WITH {TRADES}{BASE}, o AS (SELECT strategy_id, count(*) AS n_trades, avg(pct) AS om, avg(base_mean) AS bm, avg((pct > 0)::INT) AS ow, avg(base_win) AS bw FROM bs GROUP BY 1),
dj AS (SELECT strategy_id, draw, direction, hold, nb - hold AS span, CAST('0x' || substr(md5('0|' || strategy_id || '|' || draw || '|' || trade_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM bs CROSS JOIN (SELECT unnest(range(0, {N_PERM})) AS draw) CROSS JOIN (SELECT count(*) AS nb FROM bars)),
dm AS (SELECT strategy_id, draw, avg(direction * (x.open / b.open - 1.0)) AS nm FROM (SELECT *, least(CAST(floor(u * span) AS BIGINT), span - 1) AS j FROM dj) q JOIN bars b ON b.bar_idx = j JOIN bars x ON x.bar_idx = j + hold GROUP BY 1, 2)
SELECT o.strategy_id, n_trades, {_r('om AS observed_mean', 'bm AS baseline_mean', 'ow AS observed_win_rate', 'bw AS baseline_win_rate', 'om - bm AS lift', 'avg(nm) AS null_mean', 'stddev_samp(nm) AS null_std')}, sum((nm >= om)::INT)::BIGINT AS k_ge, count(*) AS n_perm, {_r('(om - avg(nm)) / nullif(stddev_samp(nm), 0) AS z', '(1.0 + sum((nm >= om)::INT)) / (1.0 + count(*)) AS p_value')} FROM o JOIN dm USING (strategy_id) GROUP BY o.strategy_id, n_trades, om, bm, ow, bw""",
        "temporal_windows": WIN + f'SELECT strategy_id, "window"::INTEGER AS "window", start, "end", n, {_r("mean", "baseline", "win_rate", "usd_sum", "mean - baseline AS lift")}, counted FROM ww',
        "temporal_score": WIN + "SELECT strategy_id, sum((counted AND mean - baseline > 0)::INT)::BIGINT AS windows_positive, sum(counted::INT)::BIGINT AS windows_total, round(coalesce(sum((counted AND mean - baseline > 0)::INT)::DOUBLE / nullif(sum(counted::INT), 0), 0), 6) AS score FROM ww GROUP BY 1",
        "rolling_volatility": f"WITH {BARS}{VOL} SELECT bar_idx, round(vol, 8) AS vol FROM vo",
        "crisis_split": f"WITH {TRADES}{FWD}{VOL}" + _subset_sql("SELECT bar_idx, coalesce(vol >= (SELECT quantile_cont(vol, 0.9) FROM vo), false) AS crisis FROM vo", "crisis") + f" SELECT strategy_id, crisis, n, {_r('CASE WHEN n >= 10 THEN mean END AS mean', 'CASE WHEN n >= 10 THEN baseline END AS baseline', 'CASE WHEN n >= 10 THEN mean - baseline END AS lift')} FROM sb",
        "yearly_pnl": f"WITH {TRADES} SELECT strategy_id, year(exit_time)::INTEGER AS year, round(sum(usd), 4) AS usd, count(*) AS n FROM t GROUP BY 1, 2",
        "cost_curve": f"WITH {TRADES}{BASE}{COSTC} SELECT strategy_id, mult, {_r('g - mult * cost AS net_mean_usd', 'g - mult * cost - b AS net_lift_usd')}, g - mult * cost - b > 0 AS passes FROM ga CROSS JOIN co CROSS JOIN (SELECT unnest([0, 1, 2, 3, 5, 10, 20])::DOUBLE AS mult)",
        "cost_summary": f"WITH {TRADES}{BASE}{COSTC} SELECT strategy_id, {_r('g AS gross_mean_usd', 'b AS baseline_mean_usd', '(g - b) / cost AS breakeven_mult')}, CASE WHEN lost > 0 THEN round(won / lost, 6) ELSE 'Infinity'::DOUBLE END AS net_pf_1x, g - b - cost > 0 AS passed_1x FROM ga CROSS JOIN co",
        "cost_lookup_fallback": f"WITH {TRADES} SELECT strategy_id, round(coalesce(max(rt), avg(2 * (2.2 + 0.5::DOUBLE))), 6) AS cost, CASE WHEN max(rt) IS NULL THEN 'report' ELSE 'reference' END AS source, round(avg(2 * (2.2 + 0.5::DOUBLE)), 6) AS report_cost FROM t LEFT JOIN {_costs} ON root = CASE strategy_id % 5 WHEN 0 THEN 'ES' WHEN 1 THEN 'MNQ' WHEN 2 THEN 'MES' WHEN 3 THEN 'M2K' END GROUP BY 1",
        "equity_curve": f"WITH {PNL} SELECT strategy_id, trade_id, seq, {_r('eq', 'dd', digits=4)} FROM ed",
        "drawdown_episodes": f"WITH {EPS} SELECT strategy_id, peak_i, trough_i, recovery_i, round(depth, 4) AS depth FROM ep",
        "cdar_capital": f"WITH {DD} SELECT strategy_id, n_trades, n_episodes, n_unrecovered, {_r('years', 'sum_usd', 'sharpe', 'sortino', 'max_dd', 'mean_dd', 'median_dd', 'pt_mean', 'pt_max', 'pr_mean', 'pr_max', 'cdar', 'annual_usd', 'capital AS capital_cdar', 'capital', 'annual_usd / nullif(capital, 0) AS annual_pct', 'max_dd / nullif(capital, 0) AS max_dd_pct', 'annual_usd / nullif(max_dd, 0) AS calmar', 'annual_usd / nullif(mean_dd, 0) AS profit_over_avg_dd', 'annual_usd / nullif(cdar, 0) AS profit_over_cdar', digits=4)} FROM s5",
        "sharpe_sortino": f"WITH {PNL}{STATS} SELECT strategy_id, n_trades, {_r('years', 'sum_usd', 'sharpe', 'sortino')} FROM sr",
        "margin_check": f"WITH {DD} SELECT strategy_id, {_r('capital', '1500.0 / nullif(capital, 0) AS margin_to_equity', 'capital / 1500.0 AS contracts_covered')} FROM s5",
        "delay_entry_fixed_exit": _curve_sql("entry"),
        "delay_entry_fixed_hold": _curve_sql("entry", "fixed_hold"),
        "delay_exit": _curve_sql("exit"),
        "delay_entry_early": _curve_sql("entry", early=True),
        "delay_entry_early_fixed_hold": _curve_sql("entry", "fixed_hold", early=True),
        "delay_exit_early": _curve_sql("exit", early=True),
        "first_nonpositive_k": f"WITH {_delay_sql('exit', 'fixed_exit', False)} SELECT strategy_id, min(CASE WHEN k > 0 AND n_alive > 0 AND total_usd <= 0 THEN k END)::INTEGER AS first_k FROM cv GROUP BY 1",
        "paired_change": f"WITH {_delay_sql('entry', 'fixed_exit', False)} SELECT a.strategy_id, a.k::INTEGER AS k, round(avg(a.u - b.u), 6) AS mean_change, count(a.u) AS n FROM pt a JOIN pt b ON b.strategy_id = a.strategy_id AND b.trade_id = a.trade_id AND b.k = 0 GROUP BY 1, 2",
        "money_parse": f"SELECT o_orderkey AS id, round({_cells('o_orderkey', 'x', '-x', '-x', 'NULL', '-x', 'NULL', 'x')}, 2) AS v FROM (SELECT o_orderkey, round(o_totalprice, 2) AS x FROM orders)",
        "interval_parse": f"SELECT p_partkey AS id, ({_cells('p_partkey', 'p_size', '60 * p_size', '1440', 'NULL', '10080', 'p_size', 'NULL')})::BIGINT AS v FROM part",
        "root_normalise": "SELECT c_custkey AS id, left(c_mktsegment, 2) || chr(65 + c_nationkey) AS v FROM customer",
        "axis_class": f"SELECT p_partkey AS id, CASE WHEN {_words(S.SCALE_FREE, 'part')} OR {_words(S.SCALE_FREE_WORDS, 'word')} THEN 'scale-free' WHEN {_words(S.PRICE, 'part')} OR {_words(S.PRICE_WORDS, 'word')} THEN 'price-scaled' ELSE 'unclassified' END AS v FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') || {_cells('p_partkey', *(repr(x) for x in SUFFIXES))} AS s FROM part)",
        "stamp_parse": f"SELECT event_id AS id, ({_cells('event_id', 'm', 'd', 'NULL', 'm', 'NULL')})::TIMESTAMP AS v, event_id % 5 = 1 AS date_only FROM (SELECT event_id, date_trunc('minute', ts) AS m, date_trunc('day', ts) AS d FROM events)",
        "portfolio_equity": f"WITH {_all_as_one(PNL)} SELECT trade_id, seq, {_r('eq', 'dd', digits=4)} FROM ed",
        "portfolio_episodes": f"WITH {_all_as_one(EPS)} SELECT peak_i, trough_i, recovery_i, round(depth, 4) AS depth FROM ep",
        "histogram_view": f"WITH {EPS}, x AS (SELECT strategy_id, -depth AS x FROM ep), b AS (SELECT strategy_id, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1) SELECT strategy_id, CASE WHEN hi > lo THEN least(29, CAST(floor(30 * (x - lo) / (hi - lo)) AS BIGINT)) ELSE 0 END::INTEGER AS bin, round(min(lo) + (CASE WHEN hi > lo THEN least(29, CAST(floor(30 * (x - lo) / (hi - lo)) AS BIGINT)) ELSE 0 END) * (min(hi) - min(lo)) / 30, 4) AS lower, count(*) AS n FROM x JOIN b USING (strategy_id) GROUP BY strategy_id, 2, hi, lo, CASE WHEN hi > lo THEN least(29, CAST(floor(30 * (x - lo) / (hi - lo)) AS BIGINT)) ELSE 0 END",
    }
