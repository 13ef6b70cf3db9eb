"""Ordered operators: retention, tails, latest, EMA, stock ledger, global rank."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import pieces
from millrace.operators import timeseries as ts

T0 = dt.datetime(2024, 1, 1)


def readings(spark, per_machine: dict[str, int], start=T0):
    data = [(m, start + dt.timedelta(minutes=i), float(i)) for m, n in per_machine.items() for i in range(n)]
    return spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double")


@pytest.mark.parametrize("n", [5, 20, 35])
def test_retention_keeps_newest_10_per_machine(spark, n):
    df = readings(spark, {"A": n, "B": 2})
    kept = ts.rolling_retention(df, "Machine", ["Timestamp", "Machine"], per_key=10)
    total = n + 2
    assert kept.count() == min(total, 20)
    newest = max(r["Timestamp"] for r in df.collect())
    assert newest in [r["Timestamp"] for r in kept.collect()]


def test_tail_large_n_uses_distributed_rank(spark, monkeypatch):
    df = readings(spark, {"A": 30, "B": 30})
    got = ts.tail_n(df, 10, ["Timestamp", "Machine"], rank_col="r")
    small = df.orderBy(F.desc("Timestamp"), F.desc("Machine")).limit(10)
    assert rows(got, "Machine", "Timestamp") == rows(small, "Machine", "Timestamp")
    assert sorted(r["r"] for r in got.collect()) == list(range(1, 11))


def test_newest_ranks_ties_at_the_cut(spark):
    same = T0 + dt.timedelta(hours=5)
    data = [("A", T0 + dt.timedelta(minutes=i), float(i)) for i in range(100)]
    data += [(f"M{i}", same, 0.0) for i in range(30)]          # 30 rows tied at one instant
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double")
    for n in (40, 0, 1, 31, 129, 130, 500):
        got = ts.newest(df, n, ["Timestamp", "Machine"])
        want = df.orderBy(F.desc("Timestamp"), F.desc("Machine")).limit(n)
        assert rows(got, "Machine", "Timestamp") == rows(want, "Machine", "Timestamp")


def test_newest_of_rows_far_apart_without_a_time_and_repeated(spark):
    times = [None, None, dt.datetime(1960, 5, 1, 3, 4, 5, 7), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), T0, T0,
             T0 + dt.timedelta(microseconds=1), T0 + dt.timedelta(milliseconds=70), dt.datetime(9000, 1, 1)]
    df = spark.createDataFrame([(f"M{i % 2}", t, float(i)) for i, t in enumerate(times)] * 2,
                               "Machine string, Timestamp timestamp_ntz, Temperature double")
    order = ["Timestamp", "Machine", "Temperature"]
    for n in range(0, 20):
        want = df.orderBy(*[F.desc(c) for c in order]).limit(n)
        assert rows(ts.newest(df, n, order)) == rows(want), n


def test_retention_reads_the_feed_three_times(spark, smoke_dir, tmp):
    from millrace.sources.testdata import DriverTables
    DriverTables(spark, smoke_dir).fact_sensor.write.parquet(f"{tmp}/feed")
    kept = ts.rolling_retention(spark.read.parquet(f"{tmp}/feed"), "Machine", ["Timestamp", "Machine", "Temperature"])
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("FileScan parquet") <= 3 and "Subquery" not in plan


def test_sequence_ids_ascending(spark, monkeypatch):
    df = spark.createDataFrame([(k,) for k in ["c", "a", "b"]], "k string")
    got = dict(rows(ts.sequence_ids(df, ["k"], fmt="M-%05d"), "k", "Seq_ID"))
    assert got == {"a": "M-00001", "b": "M-00002", "c": "M-00003"}


def test_latest_and_tail_per_key(spark):
    df = readings(spark, {"A": 7, "B": 3})
    latest = dict(rows(ts.latest_per_key(df, "Machine", ["Timestamp"]), "Machine", "Temperature"))
    assert latest == {"A": 6.0, "B": 2.0}
    tail = ts.tail_per_key(df, "Machine", ["Timestamp"], 5, pos_col="Position")
    got = rows(tail.where("Machine = 'A'"), "Position", "Temperature")
    assert got == [(2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0), (6, 6.0)]


def _fold(xs, s0, a=0.15):
    out, s = [], s0
    for x in xs:
        if x is not None:
            s = s + a * (x - s)
        out.append(s)
    return out


def test_ema_matches_sequential_fold_across_chunks(spark):
    # three days of readings (three chunks) including NULL readings
    data = []
    for i in range(72):
        x = None if i % 11 == 5 else float((i * 37) % 50)
        data.append(("A", T0 + dt.timedelta(hours=i), x))
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double")
    init = spark.createDataFrame([("A", 40.0)], "Machine string, Temperature double")
    out = ts.ema_smooth(df, "Machine", "Timestamp", [], ["Temperature"], init, chunk_rows=20)
    got = [r["Temperature"] for r in out.orderBy("Timestamp").collect()]
    want = _fold([d[2] for d in data], 40.0)
    assert len(got) == 72
    assert max(abs(g - w) for g, w in zip(got, want)) < 1e-9


def test_stock_ledger_cases(spark):
    demand = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), 30), (1, dt.date(2024, 1, 2), 20), (1, dt.date(2024, 1, 3), 100),
         (2, dt.date(2024, 1, 1), 10)], "Part_Key long, Date date, Need long")
    stock = spark.createDataFrame([(1, 50, 25, 60), (2, 40, 30, 60), (3, 5, 100, 40)],
                                  "Part_Key long, Opening_Stock long, Safety_Stock long, Refill long")
    out = {(r["Part_Key"], r["Date"].day): r for r in ts.stock_ledger(demand, stock).collect()}
    d1 = out[(1, 1)]
    assert (d1["Consumed"], d1["Shortage"], d1["Refilled"], d1["Closing_Stock"]) == (30, False, True, 80)
    d2 = out[(1, 2)]
    assert (d2["Opening_Stock"], d2["Consumed"], d2["Refilled"], d2["Closing_Stock"]) == (80, 20, False, 60)
    d3 = out[(1, 3)]                                   # shortage: take what is there, then refill
    assert (d3["Consumed"], d3["Shortage"], d3["Closing_Stock"]) == (60, True, 60)
    p2 = out[(2, 1)]                                   # exactly at safety stock: no refill, then quiet days
    assert (p2["Closing_Stock"], p2["Refilled"], p2["Until_Date"]) == (30, False, dt.date(2024, 1, 3))
    # a part without demand is refilled on every quiet day while it is below its safety stock
    p3 = [(d, out[(3, d)]["Opening_Stock"], out[(3, d)]["Closing_Stock"]) for d in (1, 2, 3)]
    assert p3 == [(1, 5, 45), (2, 45, 85), (3, 85, 125)]
    assert all(r["Closing_Stock"] >= 0 for r in out.values())


def test_stock_ledger_equals_a_daily_replay(spark):
    import random
    rnd = random.Random(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=2 * i) for i in range(40)]
    parts = {k: (rnd.randint(0, 60), rnd.randint(10, 90), rnd.randint(5, 30)) for k in range(12)}
    need = {(k, d): rnd.randint(1, 40) for k in list(parts)[:-1] for d in days if rnd.random() < 0.2}
    need.update({(0, d): 1 for d in days})              # every day is a production day
    demand = spark.createDataFrame([(k, d, n) for (k, d), n in need.items()], "Part_Key long, Date date, Need long")
    stock = spark.createDataFrame([(k, *v) for k, v in parts.items()],
                                  "Part_Key long, Opening_Stock long, Safety_Stock long, Refill long")
    got = ts.stock_ledger(demand, stock).collect()
    for k, (s, safety, refill) in parts.items():
        mine = sorted((r for r in got if r["Part_Key"] == k), key=lambda r: r["Date"])
        for d in days:
            s = max(0, s - need.get((k, d), 0))
            s += refill if s < safety else 0
            row = [r for r in mine if r["Date"] <= d <= r["Until_Date"]]
            assert len(row) == 1 and row[0]["Closing_Stock"] == s, (k, d)


def test_queries_build_without_jobs(spark, smoke_dir):
    from millrace.plans.registry import run
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-build", "")
    try:
        run("live_tail", spark, smoke_dir)              # file footers are read here
        before = len(tracker.getJobIdsForGroup("lazy-build"))
        for name in ("live_tail", "rolling_retention", "machine_sequence_ids", "stock_ledger",
                     "telemetry_gaps", "causal_chain", "active_alerts", "range_breach", "rule_override"):
            run(name, spark, smoke_dir)
        jobs = tracker.getJobIdsForGroup("lazy-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) - before <= 8                      # schema reads of tables not opened before


def test_ema_hot_key_spans_many_chunks(spark):
    data = [("HOT", T0 + dt.timedelta(seconds=7 * i), float((i * 13) % 40)) for i in range(600)]
    for m in range(5):
        data += [(f"C{m}", T0 + dt.timedelta(hours=i), float(i + m)) for i in range(4)]
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double")
    init = spark.createDataFrame([("HOT", 10.0)] + [(f"C{m}", 1.0) for m in range(5)],
                                 "Machine string, Temperature double")
    out = ts.ema_smooth(df, "Machine", "Timestamp", [], ["Temperature"], init, chunk_rows=25)
    got = {}
    for r in out.orderBy("Machine", "Timestamp").collect():
        got.setdefault(r["Machine"], []).append(r["Temperature"])
    assert len(got["HOT"]) == 600
    want_hot = _fold([x for (m, _, x) in data if m == "HOT"], 10.0)
    assert max(abs(a - b) for a, b in zip(got["HOT"], want_hot)) < 1e-9
    for m in range(5):
        assert got[f"C{m}"] == _fold([float(i + m) for i in range(4)], 1.0)


def _burst(spark):
    """A third of all rows of one machine within a second, many of them at one instant or equal in every column."""
    data = [("HOT", T0 + dt.timedelta(microseconds=i * 500), float(i % 31), float(i)) for i in range(1000)]
    data += [("HOT", T0 + dt.timedelta(seconds=2), float(i % 7), float(i % 250)) for i in range(1000)]
    data += [("HOT", T0 + dt.timedelta(seconds=3), 4.0, 4.0)] * 1000
    data += [(f"C{i % 40:02d}", T0 + dt.timedelta(hours=i), float(i % 13), float(i)) for i in range(3000)]
    return spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double, Tie double"), data


def test_pieces_hold_equal_numbers_of_rows_whatever_their_times(spark):
    df, data = _burst(spark)
    cut = pieces.sorted_pieces(df.repartition(5), "Machine", ["Timestamp", "Tie", "Temperature"], 300)
    sizes = {r["_piece"]: (r["count"], r["hot"]) for r in cut.groupBy("_piece").agg(
        F.count("*").alias("count"), F.count_if(F.col("Machine") == "HOT").alias("hot")).collect()}
    assert len(sizes) == 20 and max(n for n, _ in sizes.values()) <= 600
    assert sum(hot > 0 for _, hot in sizes.values()) >= 9
    got = [tuple(r)[:4] for r in cut.orderBy("_piece", "_seq").collect()]
    assert got == sorted(data, key=lambda r: (r[0], r[1], r[3], r[2]))


@pytest.mark.parametrize("piece_rows", [40, 300, 10**6])
def test_positions_and_smoothing_over_any_pieces(spark, piece_rows):
    df, data = _burst(spark)
    series = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[3], r[2])):
        series.setdefault(r[0], []).append(r)
    order = ["Timestamp", "Tie", "Temperature"]
    placed = {}
    for r in pieces.row_position(df, "Machine", order, piece_rows=piece_rows).collect():
        placed.setdefault(r["Machine"], {})[r["Position"]] = tuple(r)[:4]
    assert {k: [v[i] for i in range(len(v))] for k, v in placed.items()} == series
    init = spark.createDataFrame([(m, 10.0) for m in [*series, "NO READINGS"] if m != "C07"], "Machine string, Temperature double")
    out = {}
    for r in ts.ema_smooth(df, "Machine", "Timestamp", ["Tie", "Temperature"], ["Temperature"], init, chunk_rows=piece_rows).collect():
        out.setdefault(r["Machine"], []).append((r["Timestamp"], r["Tie"], r["Temperature"]))
    assert set(out) == set(series)
    for m, rows_ in series.items():
        want = _fold([r[2] for r in rows_], float("nan") if m == "C07" else 10.0)
        got = sorted(out[m], key=lambda x: (x[0], x[1]))
        assert len(got) == len(want)
        if m == "C07":
            assert all(x[2] != x[2] or x[2] is None for x in got)      # no starting state
            continue
        by_time = {}
        for r, w in zip(rows_, want):
            by_time.setdefault((r[1], r[3]), []).append(w)
        have = {}
        for t, tie, v in got:
            have.setdefault((t, tie), []).append(v)
        assert have.keys() == by_time.keys()
        for k, w in by_time.items():
            assert max(abs(a - b) for a, b in zip(sorted(have[k]), sorted(w))) < 1e-9


def test_positions_of_rows_without_key_or_time(spark):
    df = spark.createDataFrame([(None, None), (None, T0), ("A", T0), ("A", None)], "Machine string, Timestamp timestamp_ntz")
    for n in (1, 2, 10):
        got = pieces.row_position(df, "Machine", ["Timestamp"], piece_rows=n)
        assert rows(got, "Machine", "Timestamp", "Position") == sorted(
            [(None, None, 0), (None, T0, 1), ("A", None, 0), ("A", T0, 1)], key=repr)
    assert pieces.row_position(df.limit(0), "Machine", ["Timestamp"]).count() == 0


def test_ema_chunk_spanning_arrow_batches(spark):
    data = [("A", T0 + dt.timedelta(minutes=i), None if i % 9 == 4 else float(i % 23)) for i in range(90)]
    data += [("B", T0 + dt.timedelta(minutes=i), float(i)) for i in range(15)]
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double")
    init = spark.createDataFrame([("A", 5.0), ("B", 0.0)], "Machine string, Temperature double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = ts.ema_smooth(df, "Machine", "Timestamp", [], ["Temperature"], init)
        got = {}
        for r in out.orderBy("Machine", "Timestamp").collect():
            got.setdefault(r["Machine"], []).append(r["Temperature"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["A"] == _fold([x for (m, _, x) in data if m == "A"], 5.0)
    assert got["B"] == _fold([float(i) for i in range(15)], 0.0)


def test_ema_rows_without_a_time_come_first(spark):
    data = [("A", None, 7.0, 3.0), ("A", None, 5.0, 1.0), ("B", None, 4.0, 1.0)]
    data += [("A", T0 + dt.timedelta(minutes=i), float(i % 23), 0.0) for i in range(60)]
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz, Temperature double, Tie double")
    init = spark.createDataFrame([("A", 5.0), ("B", 2.0)], "Machine string, Temperature double")
    out = ts.ema_smooth(df, "Machine", "Timestamp", ["Tie"], ["Temperature"], init, chunk_rows=20)
    got = {}
    for r in out.orderBy("Machine", "Timestamp", "Tie").collect():
        got.setdefault(r["Machine"], []).append(r["Temperature"])
    want = _fold([5.0, 7.0, *(float(i % 23) for i in range(60))], 5.0)
    assert len(got["A"]) == len(want) and max(abs(a - b) for a, b in zip(got["A"], want)) < 1e-9
    assert got["B"] == _fold([4.0], 2.0)
