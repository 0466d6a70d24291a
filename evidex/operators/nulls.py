"""The random-entry null: what the mean return would be had every trade entered at a random bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.md5 import uniforms
from evidex.functions.semantics import p_from_counts
from evidex.operators.trades import forward_returns, lift
from evidex.session import cut, ship, spread

#: Entry bars whose returns are one array of at most 8 MB, trades that are drawn for as one group, and draws made at once.
RANGE, GROUP, BATCH = 1 << 20, 4000, 1 << 15


def _text_rows(texts: list[bytes]) -> np.ndarray:
    """Texts of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), len(texts[0]))


def _draws_of(trades: pa.Table, entries: pa.Table, n_perm: int) -> pa.Table:
    """What the draws of a group of trades of one hold come to that enter in one range of bars, by strategy and draw."""
    if not entries.num_rows or not trades.num_rows:
        return trades.select(["strategy_id"]).slice(0, 0).append_column("draw", pa.array([], pa.int32())).append_column("total", pa.array([], pa.float64())).append_column("n", pa.array([], pa.int64()))
    at, fwd = (entries[c].combine_chunks()[0].values for c in ("at", "fwd"))
    at = at.to_numpy(zero_copy_only=False)
    first, size = int(at.min()), int(at.max() - at.min()) + 1
    value, known = np.zeros(size), np.zeros(size, bool)  # a bar that is missing, or whose return is NULL, counts for nothing
    value[at - first], known[at - first] = fwd.fill_null(0.0).to_numpy(), fwd.is_valid().to_numpy(zero_copy_only=False)
    gaps = not known.all()
    span = trades["span"][0].as_py()
    code = trades["strategy_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    head, tail = ([x.encode() for x in trades[c].to_pylist()] for c in ("head", "tail"))
    direction = trades["direction"].to_numpy()
    names, firsts = np.unique(code, return_index=True)
    total, n = np.zeros((len(names), n_perm)), np.zeros((len(names), n_perm), np.int64)
    lengths = np.array([(len(h), len(t)) for h, t in zip(head, tail, strict=True)])
    order = np.lexsort((code, lengths[:, 1], lengths[:, 0]))
    starts = np.flatnonzero(np.r_[True, np.any(np.diff(lengths[order], axis=0) != 0, axis=1)])
    for alike in np.split(order, starts[1:]):  # texts of one length
        lo = 0
        while lo < n_perm:
            hi = min(n_perm, 10 ** len(str(lo)), lo + BATCH)
            middles = _text_rows([b"%d" % d for d in range(lo, hi)])
            step = max(1, BATCH // (hi - lo))
            for some in (alike[i : i + step] for i in range(0, len(alike), step)):
                u = uniforms(_text_rows([head[i] for i in some]), middles, _text_rows([tail[i] for i in some]))
                j = np.minimum(np.floor(u * span).astype(np.int64), span - 1) - first
                inside = None
                if gaps or first or size < span:
                    inside = (j >= 0) & (j < size)
                    j[~inside] = 0
                    inside &= known[j]
                r = value[j] * direction[some, None]
                if inside is not None:
                    r[~inside] = 0.0
                own = np.flatnonzero(np.r_[True, np.diff(code[some]) != 0])
                rows = code[some][own]
                total[rows, lo:hi] += np.add.reduceat(r, own, axis=0)
                n[rows, lo:hi] += np.diff(np.r_[own, len(some)])[:, None] if inside is None else np.add.reduceat(inside.astype(np.int64), own, axis=0)
            lo = hi
    ids = trades["strategy_id"].combine_chunks().take(pa.array(np.repeat(firsts, n_perm)))
    return pa.table({"strategy_id": ids, "draw": pa.array(np.tile(np.arange(n_perm, dtype=np.int32), len(names))), "total": total.ravel(), "n": n.ravel()})


def random_entry_draws(based: DataFrame, bars: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """(strategy_id, draw, null_mean): each trade enters at a uniform bar from which its hold fits, n_perm times.

    A draw is named by seed, strategy, draw and trade, as in `uniform`, so it depends on no partitioning. Trades of one hold,
    in groups, meet the returns of that hold from every bar, in ranges; a group's draws are added where they are made.
    """
    ship(based.sparkSession)
    n = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    t = based.select("strategy_id", "symbol", "trade_id", "direction", F.col("hold").cast("bigint").alias("hold")).join(n, "symbol")
    t = t.withColumn("span", F.col("n_bars") - F.col("hold")).where("span > 0 and strategy_id is not null")
    holds = cut(t.groupBy("symbol", "hold").agg(F.ceil(F.count("*") / GROUP).alias("shares"), F.ceil(F.max("span") / RANGE).alias("ranges")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    keys = ["symbol", "hold", "range", "share"]
    text = t.join(holds, ["symbol", "hold"]).withColumns({
        "head": F.concat_ws("|", F.lit(str(seed)), F.col("strategy_id").cast("string"), F.lit("")), "tail": F.coalesce(F.concat(F.lit("|"), F.col("trade_id").cast("string")), F.lit("")),
        "share": F.pmod(F.xxhash64("strategy_id", "trade_id"), F.col("shares")).cast("int"), "range": every("ranges"), "direction": F.col("direction").cast("double"),
    }).select(*keys, "strategy_id", "head", "tail", "direction", "span")
    r = forward_returns(bars.select("symbol", "bar_idx", "open"), holds.select("symbol", "hold")).withColumn("range", F.floor(F.col("bar_idx") / RANGE).cast("int"))
    r = r.groupBy("symbol", "hold", "range").agg(F.collect_list(F.struct("bar_idx", "fwd")).alias("e"))
    r = r.join(holds.select("symbol", "hold", every("shares").alias("share")), ["symbol", "hold"]).select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("e.bar_idx").alias("at"), F.col("e.fwd").alias("fwd"))
    kind = based.schema["strategy_id"].dataType.simpleString()
    groups = spread(text, *keys).groupBy(*keys).cogroup(spread(r, *(f"{k}_" for k in keys)).groupBy(*(f"{k}_" for k in keys)))
    parts = groups.applyInArrow(lambda x, y: _draws_of(x, y, n_perm), f"strategy_id {kind}, draw int, total double, n bigint")
    return parts.groupBy("strategy_id", "draw").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("null_mean"))


def random_entry_test(based: DataFrame, bars: DataFrame, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """A row a strategy: observed and baseline figures, the null's mean, deviation and z, k_ge and p = (k + 1) / (n + 1)."""
    based = cut(based)
    bars = cut(bars.select("symbol", "bar_idx", "open"))
    bad = based.join(bars.groupBy("symbol").agg(F.count("*").alias("n_bars")), "symbol").where("hold < 1 or hold >= n_bars")
    if not bad.isEmpty():
        raise ValueError("every hold must be >= 1 bar and shorter than the bar series")
    o = lift(based)
    d = random_entry_draws(based, bars, n_perm, seed).join(o.select("strategy_id", "observed_mean"), "strategy_id")
    s = d.groupBy("strategy_id").agg(F.avg("null_mean").alias("null_mean"), F.stddev_samp("null_mean").alias("null_std"), F.count_if(F.col("null_mean") >= F.col("observed_mean")).alias("k_ge"), F.count("*").alias("n_perm"))
    out = o.join(s, "strategy_id")
    return out.withColumns({"z": F.try_divide(F.col("observed_mean") - F.col("null_mean"), F.col("null_std")), "p_value": p_from_counts(F.col("k_ge"), F.col("n_perm"))})
