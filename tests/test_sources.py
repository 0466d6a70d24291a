import datetime as dt

import pytest
from evidex.plans.export import to_json
from evidex.sources import grid_text, report, synthetic
from evidex.streaming.bars import streaming_bars
from pyspark.sql import functions as F

HEAD = report.TRADES_HEADER + ",Signal,Price,Roll Over Pips,Shares/Ctrts - Profit/Loss,Net Profit - Cum Net Profit,% Profit,Run-up/Drawdown,Efficiency,Total Eff.,Comm.,Slippage"
REPORT = f"""﻿TradeStation Performance Summary,,,,
,All Trades,Long Trades,Short Trades,
Total Net Profit,$12.40,$5.00,$7.40,
Profit Factor,n/a,n/a,n/a,
Total Net Profit,$99.00,,,
Avg. Bars in Total Trades,4.50,,,

{HEAD}

7,Sell Short,3/4/2024 09:00,In,$1500.00,$0.00,2,$34.60,23,500.00%,$36.00,50.00%,,$2.20,$0.50
,Buy to Cover,3/4/2024 11:30,Out,$1490.00,,$40.00,$34.60,,($12.00),70.00%,20.00%,$2.20,$0.50
8,Buy,3/5/2024 10:00,In,$1510.50,$0.00,1,($27.40),-0.06%,$16.00,40.00%,,$2.20,$0.50
,Sell,3/5/2024 13:00,"Stop, hit",$1499.50,,($22.00),$7.20,,($28.00),30.00%,-10.00%,$2.20,$0.50

Settings

Symbol,@MNQ,,
Interval,30 min.,,
TradeStation Strategies Applied,,,
Demo(On),,,
Cost,3,,
TradeStation Strategy Settings,,,
Demo - Length,20,,
Trade Size,,,
Fixed Shares/Contracts:,1,,
"""


def texts(spark, *ts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(ts)], "file string, text string")


def test_report(spark):
    t, w, v = report.parse_trades(texts(spark, REPORT.replace("\n", "\r\n")))
    assert v.count() == 0 and w.count() == 0
    a, b = t.orderBy("trade_id").collect()
    assert (a.trade_id, a.direction, a.entry_time, a.exit_price, a.contracts, a.gross_pnl, a.net_pnl, a.comm_side, a.drawdown_usd) == (7, -1, dt.datetime(2024, 3, 4, 9), 1490.0, 2, 40.0, 34.6, 2.2, -12.0)
    assert (b.exit_signal, b.net_pnl, b.cum_net_pnl) == ("Stop, hit", -27.4, 7.2)
    s = report.parse_settings(texts(spark, REPORT)).first()
    assert (s.symbol, s.interval, s.fixed_contracts, s.strategies, s.inputs) == ("@MNQ", "30 min.", "1", ["Demo(On)"], {"Cost": "3", "Demo - Length": "20"})
    assert report.parse_settings(texts(spark, "x")).first().strategies == []
    m = {r.label: (r.num, r.raw) for r in report.parse_summary(texts(spark, REPORT)).collect()}
    assert m["Total Net Profit"] == (12.4, "$12.40") and m["Profit Factor"] == (None, "n/a") and m["Avg. Bars in Total Trades"][0] == 4.5


ROWS = REPORT.split("\n")
FIRST = next(i for i, x in enumerate(ROWS) if x.startswith("7,"))


def changed(**by):
    out = list(ROWS)
    for k, new in by.items():
        out[FIRST + int(k[1:])] = new
    return "\n".join(x for x in out if x is not None)


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("nothing", "trades_header"),
        (HEAD + "\n\nother", "trade_rows"),
        (changed(r0=None), "orphan_exit line="),
        (changed(r1=None), "unclosed trade=7 later=1"),
        (changed(r2=ROWS[FIRST + 1]), "exit_count trade=7 exits=3"),
        (changed(r1=ROWS[FIRST + 1].replace("Buy to Cover", "Sell")), "exit_type trade=7 entry=Sell Short exit=Sell"),
        (changed(r0=ROWS[FIRST].replace(",2,$34", ",x,$34")), "contracts trade=7 cell=x"),
        (changed(r0=ROWS[FIRST].replace("$1500.00", "none")), "price trade=7 entry=none"),
        (changed(r0=ROWS[FIRST].replace("3/4/2024 09:00", "soon")), "time trade=7 entry=soon"),
        (changed(r1=None, r2=None, r3=None), "none_closed trade=7"),
    ],
)
def test_report_refusals(spark, text, says):
    _, _, v = report.parse_trades(texts(spark, text))
    with pytest.raises(report.ReportFormatError, match=says):
        report.refuse(v, report.ReportFormatError)


def test_open_and_date_only_trades(spark):
    t, w, v = report.parse_trades(texts(spark, changed(r3=None)))
    assert v.count() == 0 and t.count() == 1 and "kept=1 of=2" in w.first().text
    t, w, v = report.parse_trades(texts(spark, REPORT.replace(" 09:00", "").replace(" 11:30", "")))
    assert v.count() == 0 and t.count() == 2 and "times_are_dates" in w.first().text


BARS = '"Date","Time","Open","High","Low","Close","Up","Down","PLOT1"\n01/08/2024,09:00,10.5,11,10,10.75,5,6,0\n01/08/2024,08:30,10,11,9.5,10.5,3,4,0\n'


def test_bars(spark):
    b, v = report.parse_bars(texts(spark, BARS, "Date, Time, Open, High, Low, Close, Vol, OI\n1/8/2024,16:00,1,2,0.5,1.5,77,0\n1/9/2024,16:00,1,2,0.5,1.5,78,0"))
    assert v.count() == 0
    rows = b.orderBy("file", "bar_idx").collect()
    assert [(r.ts, r.open, r.volume) for r in rows[:2]] == [(dt.datetime(2024, 1, 8, 8, 30), 10.0, 7.0), (dt.datetime(2024, 1, 8, 9), 10.5, 11.0)] and rows[2].volume == 77.0
    again, v = report.parse_bars(report.bars_text(b.where("file = 'f0'")))
    assert v.count() == 0 and [(r.ts, r.close, r.volume) for r in again.orderBy("bar_idx").collect()] == [(r.ts, r.close, r.volume) for r in rows[:2]]


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [('"Close"', '"Last"', "columns missing=Close"), ("01/08/2024,09:00", "2024-01-08,09:00", "bar_time row=2 cell=2024-01-08 09:00"), ("10.5,11,10", "ten,11,10", "bar_price row=2 column=Open cell=ten"), ("08:30", "09:00", "bar_time_again"), ("10.5,11,10", "0,11,10", "bar_price_sign"), ("01/08/2024,08:30,10,11,9.5,10.5,3,4,0\n", "", "bar_count bars=1")],
)
def test_bar_refusals(spark, old, new, says):
    _, v = report.parse_bars(texts(spark, BARS.replace(old, new)))
    with pytest.raises(report.BarsFormatError, match=says):
        report.refuse(v, report.BarsFormatError)


GRID = """A,B
1,10~v1,1|20240102,0.00,0,0,0,0,0,0,0.00|20240103,50.00,1,0,1,1,0,300,30.00~v2|20240103,1000,E,L,100.0,0,0,0|20240104,1100,X,L,100.5,30,-10,40
2,10~v1,1|20240102,-5.00,0,0,0,0,0,0,0.00|20240103,7.00,1,0,1,1,0,300,0.00
"""


def test_optimisation_text(spark):
    t, v = grid_text.parse_grid(texts(spark, GRID))
    assert v.count() == 0
    c = t["combos"].orderBy("combo_id").collect()
    assert [(r.params, r.pos) for r in c] == [([1.0, 10.0], [0, 0]), ([2.0, 10.0], [1, 0])]
    d = t["grid_daily"].orderBy("combo_id", "day_idx").collect()
    assert [(r.date.day, r.pnl, r.closed_pnl) for r in d] == [(2, 0, 0), (3, 50, 30), (2, -5, 0), (3, 7, 0)]
    assert [(r.combo_id, r.pnl) for r in t["grid_exits"].collect()] == [(0, 30.0)]


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [("A,B\n", "", "parameter_names"), ("2,10~", "x,10~", "parameter cells=x,10 iteration=2"), ("2,10~", "2~", "parameter_count values=1 names=2"), ("2,10~v1", "2,10~w1", "daily_version cell=w1"), ("~v2", "~z2", "trade_version cell=z2"), (",300,0.00", "", "daily_fields least="), ("|20240102,-5", "|20240101,-5", "calendar days=2 first=2 iteration=2"), ("7.00", "seven", "field iteration=2")],
)
def test_optimisation_refusals(spark, old, new, says):
    _, v = grid_text.parse_grid(texts(spark, GRID.replace(old, new)))
    with pytest.raises(report.GridFormatError, match=says):
        report.refuse(v, report.GridFormatError)


def test_grid_round_trip(spark):
    g = synthetic.make_grid(spark, (3, 2), 12, 6, seed=1)
    t, v = grid_text.parse_grid(synthetic.grid_text(g, ["A", "B"]))
    assert v.count() == 0
    a = {(r.combo_id, r.day_idx): r.pnl for r in g["grid_daily"].collect()}
    assert a == {(r.combo_id, r.day_idx): r.pnl for r in t["grid_daily"].collect()}
    assert g["grid_exits"].count() == t["grid_exits"].count()


SCHEDULE = "v2,stamp~A,B~P|20240103,20240105,1,0,0,0,1.5|1,10|1,0,0,0|first~P|20240106,20240110,1,0,0,0,2|2,10|2,0,0,0|second~other"


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def same(a, b):
    """Equal rows but for the files' names, which are a path in one of them."""
    base = lambda d: sorted((tuple(str(v).rsplit("/", 1)[-1] if c in ("file", "project") else v for c, v in zip(d.columns, r)) for r in d.collect()), key=repr)
    assert base(a) == base(b)


def written(spark, folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    lines = report.read_lines(spark, str(folder))
    texts = report.read_texts(spark, str(folder))
    return lines, texts


def test_lines_of_blocks_are_those_of_whole_files(spark, tmp_path, small_blocks):
    files = {"a": "\n".join(f"line {k} " + "x" * (k * 7 % 90) for k in range(200)), "b": "\ufeffone\r\ntwo\r\n\r\nfour", "c": "", "d": "long " * 500 + "\nlast\n"}
    lines, texts = written(spark, tmp_path, files)
    assert lines.where("file like '%/a'").select("block").distinct().count() > 10
    whole = report.lines(texts).where("s <> ''").select("file", "line", "s")
    same(lines.where("s <> ''").select("file", "line", "s"), whole)
    assert [r.s for r in lines.where("file like '%/c'").collect()] == [""]


def test_report_in_blocks(spark, tmp_path, small_blocks):
    """Section, header, trade numbers and violations are carried over blocks; files of all kinds are one job."""
    trades = "\n".join(x for k in range(60) for x in (ROWS[FIRST].replace("7,", f"{k + 10},", 1), ROWS[FIRST + 1]))
    long = REPORT.replace(ROWS[FIRST], trades + "\n" + ROWS[FIRST])
    files = {"good": long, "open": long.replace(ROWS[FIRST + 1] + "\n8", "8"), "late": REPORT + "\n" * 300, "none": "x\n" * 100, "orphan": REPORT.replace(ROWS[FIRST] + "\n", "")}
    lines, texts = written(spark, tmp_path, files)
    for a, b in zip(report.parse_trades(lines), report.parse_trades(texts)):
        same(a, b)
    same(report.parse_settings(lines), report.parse_settings(texts))
    same(report.parse_summary(lines), report.parse_summary(texts))
    assert report.parse_trades(lines)[0].where("file like '%/good'").count() == 62


def test_bars_in_blocks(spark, tmp_path, small_blocks):
    head = '"Date","Time","Open","High","Low","Close","Up","Down"\n'
    rows = [f"01/{1 + k // 24:02d}/2024,{k % 24:02d}:00,{100 + k},{101 + k},{99 + k},{100 + k}.5,{k},1" for k in range(100)]
    bad = [r.replace(",150,", ",x,") for r in rows] + [rows[3]]
    lines, texts = written(spark, tmp_path, {"good": head + "\n".join(rows), "bad": head + "\n".join(bad), "head": head, "other": "a,b\n1,2\n" * 80})
    for a, b in zip(report.parse_bars(lines), report.parse_bars(texts)):
        same(a, b)
    assert [r.bar_idx for r in report.parse_bars(lines)[0].where("file like '%/good'").orderBy("ts").collect()] == list(range(100))


def test_grid_in_blocks(spark, tmp_path, small_blocks):
    text = synthetic.grid_text(synthetic.make_grid(spark, (3, 2), 12, 6, seed=1), ["A", "B"]).first().text
    torn = text.replace("~v2", "~v3", 3).replace("20200", "2x200", 1)
    lines, texts = written(spark, tmp_path, {"good": text, "torn": torn, "headless": text.split("\n", 1)[1], "blank": "\n\n"})
    (a, v), (b, w) = grid_text.parse_grid(lines), grid_text.parse_grid(texts)
    same(v, w)
    for name in a:
        same(a[name], b[name])
    assert a["combos"].where("project like '%/good'").count() == 6 and v.count() > 3


def test_schedule_database(spark, tmp_path):
    g = [{"group_no": 2, "in_len": 3, "in_type_id": 9, "out_len": 1, "out_type_id": 8, "n_iterations": 2, "schedule": SCHEDULE, "fitness": 2}, {"group_no": 3, "in_len": 3, "in_type_id": 1, "out_len": 1, "out_type_id": 8, "n_iterations": 2, "schedule": SCHEDULE}]
    good, bad = tmp_path / "a.db", tmp_path / "b.db"
    good.write_bytes(grid_text.schedule_bytes(g))
    bad.write_bytes(b"text")
    groups, windows, v = grid_text.read_schedules(spark, [str(good), str(bad)])
    r = grid_text.group_label(groups).collect()
    assert len(r) == 1 and (r[0].fitness_abbr, r[0].in_type, r[0].param_names, r[0].strategy) == ("NPAvgDD", "Month", ["A", "B"], "Demo") and r[0].label.startswith("group 2: @ES 30 min., 3 Month in")
    w = windows.orderBy("window").collect()
    assert [(x.window, x.oos_start, x.params, x.grid_row, x.label) for x in w] == [(1, dt.date(2024, 1, 3), [1.0, 10.0], 1, "first"), (2, dt.date(2024, 1, 6), [2.0, 10.0], 2, "second")]
    assert sorted(x.message for x in v.collect()) == ["database", "period group=3 in=1 out=8"]


def test_report_round_trip(spark):
    b = synthetic.make_bars(spark, 300, seed=2).cache()
    t = synthetic.make_trades(b, 20, seed=2).cache()
    text = report.report_text(t.withColumns({"file": F.lit("f"), "interval": F.lit("30 min.")}))
    got, _, v = report.parse_trades(text)
    assert v.count() == 0
    key = lambda d: sorted((r.trade_id, r.direction, r.entry_time, r.exit_time, r.entry_price, r.gross_pnl, r.net_pnl) for r in d.collect())
    assert key(got) == key(t)


def test_json_is_finite(spark):
    d = spark.createDataFrame([(1, float("nan"), [float("inf"), 1.0], dt.datetime(2024, 1, 2, 3))], "k int, a double, b array<double>, t timestamp_ntz")
    assert to_json(d, ["k"]).first().json == '{"k":1,"a":null,"b":[null,1.0],"t":"2024-01-02T03:00:00"}'


def test_streaming_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, h, m), h * 60 + m, float(h * 60 + m)) for h in range(3) for m in (0, 30, 59)], "symbol string, ts timestamp_ntz, event_id long, value double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("append").format("memory").queryName("bars_").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.open, r.close, r.volume) for r in spark.table("bars_").orderBy("ts").collect()][:2] == [(0.0, 59.0, 3.0), (60.0, 119.0, 3.0)]


def test_driver_contract(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_grid_lines_meet_in_no_join(spark):
    """A line may be many megabytes, and the side of a join that is broadcast passes through the driver."""
    g = synthetic.make_grid(spark, (2, 2), 12, 6, seed=1)
    g["grid_exits"] = g["grid_exits"].where("combo_id > 0").withColumn("n", F.when(F.col("combo_id") == 1, F.lit(0)).otherwise(F.col("combo_id")).cast("bigint"))
    kept = {k: spark.createDataFrame(d.collect(), d.schema) for k, d in g.items()}
    text = synthetic.grid_lines(kept, ["A", "B"])
    assert "Join" not in text._jdf.queryExecution().executedPlan().toString()
    t, v = grid_text.parse_grid(synthetic.grid_text(kept, ["A", "B"]))
    assert v.count() == 0 and t["combos"].count() == 4
    count = lambda d: {r.combo_id: r.n for r in d.groupBy("combo_id").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    assert count(t["grid_exits"]) == count(kept["grid_exits"])


def test_grid_records_are_those_of_lines(spark, tmp_path, small_blocks):
    """Lines, parts and the order of records are carried over blocks, whatever the ends of lines and wherever a record is empty."""
    text = synthetic.grid_text(synthetic.make_grid(spark, (2, 2), 8, 4, seed=1), ["A", "B"]).first().text
    files = {
        "good": text, "torn": text.replace("~v2", "~v3", 2).replace("20150", "2x150", 1), "headless": text.split("\n", 1)[1], "blank": "\n\n", "empty": "", "names": "A,B\n", "no_records": "x,y\n1,2\n3,4", "one_line": "|", "open": GRID.rstrip("\n"),
        "windows": "\ufeff" + GRID.replace("\n", "\r\n"), "mac": GRID.replace("\n", "\r"), "spaced": "  \n" + GRID.replace("A,B\n", " A , B \n\n").replace("30.00~v2", "30.00||~v2||").replace("\n2,10", "|\n  2,10").replace("0.00\n", "0.00|  \n"), "pipes": GRID.replace("A,B", "A|B,C").replace("1,10~", "1|1,10~"),
        "parts": GRID.replace(",-10,40", ",-10,40~v9|20240104,1100,X,L,100.5,30,-10,40~more|x"), "late": GRID.replace("X,L,100.5,30", "X,L,100.5,thirty"), "early": GRID.replace("~v2|20240103,1000,E", "~v2|20240103,1000,X"), "tildes": GRID + "~~~|a\n3,10\n",
    }
    lines, _ = written(spark, tmp_path, files)
    records = grid_text.read_records(spark, str(tmp_path))
    assert records.where("file like '%/good'").select("block").distinct().count() > 5
    (a, v), (b, w) = grid_text.parse_grid(records), grid_text.parse_grid(lines)
    same(v, w)
    for k in a:
        same(a[k], b[k])
    assert a["grid_exits"].where("project like '%/early'").count() == 2 and a["combos"].where("project like '%/windows'").count() == 2


def test_no_row_holds_a_line_of_a_grid(spark, tmp_path, monkeypatch):
    """A combination may have millions of trades: neither the writer nor the reader has them in one row."""
    g = synthetic.make_grid(spark, (2, 2), 12, 6, seed=1)
    many = F.when(F.col("combo_id") == 1, F.lit(0)).when(F.col("combo_id") == 2, F.lit(40_000)).otherwise(F.lit(1)).cast("bigint")
    g["grid_exits"] = g["grid_exits"].withColumn("n", many)
    kept = {k: spark.createDataFrame(d.collect(), d.schema) for k, d in g.items()}
    rows = synthetic.grid_records(kept, ["A", "B"])
    assert rows.agg(F.max(F.length("r") * F.col("n"))).first()[0] < 100 * synthetic.RUN
    grid_text.write_records(rows, str(tmp_path / "grid"))
    records = grid_text.read_records(spark, str(tmp_path / "grid"))
    assert records.agg(F.max(F.length("r"))).first()[0] < 200
    monkeypatch.setattr(grid_text, "SMALL_TABLE", 0)  # the look-up of lines as a shuffle
    t, v = grid_text.parse_grid(records)
    assert v.count() == 0 and t["combos"].count() == 4
    count = lambda d: {r.combo_id: r.n for r in d.groupBy("combo_id").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    assert count(t["grid_exits"]) == count(kept["grid_exits"]) and max(count(t["grid_exits"]).values()) >= 40_000
    daily = lambda d: sorted((r.combo_id, r.day_idx, r.date, r.pnl) for r in d.collect())
    assert daily(t["grid_daily"]) == daily(kept["grid_daily"])


def test_the_block_scan_reads_records(spark, sf, monkeypatch):
    """The query itself goes by records, and gives what it gave by lines."""
    import __spark_entry__ as e

    monkeypatch.setattr(report, "read_lines", None)
    monkeypatch.setattr(synthetic, "grid_lines", None)
    assert e.queries()["grid_block_scan"](spark, sf).count() > 0
