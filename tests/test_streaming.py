"""Streaming == batch on the same files; restart keeps state; sink isolation."""

import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import gold, operations, pieces, silver
from millrace.operators import rules as R
from millrace.operators import timeseries as ts
from millrace.sources.files import commits, insert_batch, read_published
from millrace.sources.testdata import DriverTables
from millrace.streaming import live
from millrace.streaming.outbox import Outbox, SinkError


@pytest.fixture(scope="module")
def bronze(spark, smoke_dir):
    return DriverTables(spark, smoke_dir)


def _init(b):
    return R.initial_state(b.dim_machine, live.current_baselines(b.spark, None))


def _write_ticks(b, folder, cuts):
    first = b.fact_sensor.select(F.min(F.to_date("Timestamp"))).first()[0]
    fs = b.fact_sensor.withColumn("_d", F.datediff(F.to_date("Timestamp"), F.lit(first)))
    for lo, hi in cuts:
        (fs.where((F.col("_d") >= lo) & (F.col("_d") < hi)).drop("_d").coalesce(1)
         .write.mode("append").parquet(folder))


def _run(spark, tmp, b, fanout, rules=None, max_files=100):
    q1 = live.start_ingest(spark, f"{tmp}/ticks", f"{tmp}/work", f"{tmp}/ck1", rules_path=rules,
                           dim_machine=b.dim_machine)
    q1.awaitTermination()
    q2 = live.start_smoothing(spark, f"{tmp}/work", f"{tmp}/ck2", fanout, max_files_per_trigger=max_files)
    q2.awaitTermination()


def _batch_ema(b):
    sm = ts.ema_smooth(b.fact_sensor.select("Machine", "Timestamp", *live.SMOOTHED), "Machine", "Timestamp",
                       ["Temperature", "RPM"], live.SMOOTHED, _init(b))
    return ts.ema_rounding(sm, R.DECIMALS)


def _max_diff(spark, tmp, b):
    hist = spark.read.parquet(f"{tmp}/work/history")
    j = hist.alias("h").join(_batch_ema(b).alias("e"), ["Machine", "Timestamp"])
    assert j.count() == b.fact_sensor.count() == hist.count()
    return max(j.select(*[F.max(F.abs(F.col(f"h.{c}") - F.col(f"e.{c}"))) for c in live.SMOOTHED]).first())


def test_stream_equals_batch_and_restart_keeps_state(spark, tmp, bronze):
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 12)])
    fan = live.SinkFanout(f"{tmp}/work")
    _run(spark, tmp, bronze, fan)
    _write_ticks(bronze, f"{tmp}/ticks", [(12, 20), (20, 40)])     # new files after a stop
    _run(spark, tmp, bronze, fan)                                    # restart from checkpoints
    assert fan.failures == []
    assert _max_diff(spark, tmp, bronze) < 1e-9
    live_rows = read_published(spark, f"{tmp}/work/live")
    n_machines = bronze.fact_sensor.select("Machine").distinct().count()
    assert live_rows.count() == min(10 * n_machines, bronze.fact_sensor.count())
    k = read_published(spark, f"{tmp}/work/kpis").first()
    assert k["Machines"] <= n_machines and k["Warnings"] >= 0
    status = read_published(spark, f"{tmp}/work/status")
    assert status.count() == live_rows.select("Machine").distinct().count()
    assert {r["Status_Colour"] for r in status.collect()} <= {"green", "red"}
    recent = read_published(spark, f"{tmp}/work/recent")
    assert recent.groupBy("Machine").count().agg(F.max("count")).first()[0] <= 5


def _labelled(b):
    return live.label_batch(b.fact_sensor, R.rules_clear(b.spark), _init(b))


def test_smoothing_in_batches_with_a_crash_at_every_step(spark, tmp, bronze, monkeypatch):
    """Two batches, over pieces of 50 rows; the state and the rows are as in one batch, whatever was lost on the way."""
    rows_ = _labelled(bronze)
    noon = rows_.select(F.percentile_approx(F.unix_micros(F.col("Timestamp").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("Timestamp").cast("timestamp")) < noon
    fan = live.SinkFanout(f"{tmp}/work")
    smoother = live.Smoother(f"{tmp}/work", fan, piece_rows=50)
    smoother(rows_.where(early), 0)

    def lost(*_):
        raise OSError("lost")

    late = rows_.where(~early).select(*[c for c in rows_.columns if c not in live.START.values()],
                                                 *[F.lit(1e6).alias(s) for s in live.START.values()])
    for where, name in ((live, "publish_version"), (fan.outbox, "store"), (fan.outbox, "deliver")):
        monkeypatch.setattr(where, name, lost)
        with pytest.raises(OSError):
            smoother(late, 1)
        monkeypatch.undo()
    state = rows(read_published(spark, f"{tmp}/work/state"))
    for _ in range(3):
        smoother(late, 1)
    assert rows(read_published(spark, f"{tmp}/work/state")) == state
    assert fan.outbox.behind(spark) == {}
    # machines that were in the first batch go on from its state; the others start from their own row
    first = {r["Machine"] for r in rows_.where(early).select("Machine").distinct().collect()}
    hist = spark.read.parquet(f"{tmp}/work/history").where(F.col("Machine").isin(list(first)))
    j = hist.alias("h").join(_batch_ema(bronze).alias("e"), ["Machine", "Timestamp"])
    assert j.count() == hist.count() > 0
    assert max(j.select(*[F.max(F.abs(F.col(f"h.{c}") - F.col(f"e.{c}"))) for c in live.SMOOTHED]).first()) < 1e-9
    others = [r["Temperature"] for r in spark.read.parquet(f"{tmp}/work/history").where(~F.col("Machine").isin(list(first))).collect()]
    assert all(t > 1e5 for t in others[:1])


def test_one_machines_large_batch_is_folded_in_pieces(spark, bronze):
    """No task of the smoothing holds more than a few pieces of a machine that is the whole batch."""
    n = 40_000
    one = _labelled(bronze).limit(1).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    one = one.withColumn("Timestamp", F.timestamp_add("MILLISECOND", F.col("_i") % 1000, F.col("Timestamp"))).withColumn(
        "Temperature", (F.col("_i") * 7919 % 101).cast("double")).drop("_i")
    cut = pieces.sorted_pieces(one.select("Machine", "Timestamp", "Temperature"), "Machine", ["Timestamp", "Temperature"], 2000)
    assert cut.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 6000
    out, state = live.smooth_batch(one, None, piece_rows=2000)
    whole, whole_state = live.smooth_batch(one, None)
    assert out.count() == n
    a, b = state.first(), whole_state.first()
    assert max(abs(a[c] - b[c]) for c in live.SMOOTHED) < 1e-9
    sums = [df.agg(*[F.sum(c) for c in live.SMOOTHED]).first() for df in (out, whole)]
    assert max(abs(x - y) for x, y in zip(*sums)) < 1e-6 * n


def test_rules_apply_from_next_batch_and_sink_isolation(spark, tmp, bronze):
    rules_path = os.path.join(tmp, "rules.json")
    with open(rules_path, "w") as f:
        json.dump([{"machine": "M-00008", "sensor": "Temperature", "min": 500, "max": 600}, {"machine": "M-1"}], f)
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 40)])

    down = [True]

    def warehouse(batch, batch_id):
        if down[0]:
            raise RuntimeError("warehouse down")
        insert_batch(batch, f"{tmp}/warehouse", batch_id)

    fan = live.SinkFanout(f"{tmp}/work", extra={"warehouse": warehouse})
    _run(spark, tmp, bronze, fan, rules=rules_path)
    assert {f[1] for f in fan.failures} == {"warehouse"}              # reported, others written
    first = spark.read.parquet(f"{tmp}/work/history").count()
    assert fan.catch_up(spark) == {"warehouse": 1}
    down[0] = False
    assert fan.catch_up(spark) == {}                                  # no batch is replayed for it
    hist = spark.read.parquet(f"{tmp}/work/history")
    n = bronze.fact_sensor.count()
    assert first == n == hist.count() == spark.read.parquet(f"{tmp}/warehouse").count()
    assert _max_diff(spark, tmp, bronze) < 1e-9                       # the state was not folded twice
    m8 = hist.where("Machine = 'M-00008'").collect()
    assert m8 and all(r["Mode"] == "Custom Disturbance" and r["Running_Status"] == "Warning" for r in m8)
    given = bronze.fact_sensor.where("Machine <> 'M-00008'").groupBy("Mode").count()
    assert rows(hist.where("Machine <> 'M-00008'").groupBy("Mode").count()) == rows(given)
    assert read_published(spark, f"{tmp}/work/rejected_rules").count() == 1


def test_replayed_batch_leaves_the_window_as_it_was(spark, tmp, bronze):
    fan = live.SinkFanout(f"{tmp}/work", per_machine=3)
    fs = bronze.fact_sensor.orderBy("Timestamp").limit(130).persist()
    first, second = fs.limit(100), fs.exceptAll(fs.limit(100))
    fan(first, 0)
    window = rows(read_published(spark, f"{tmp}/work/live"))
    fan(first, 0)                                                     # a replay
    assert rows(read_published(spark, f"{tmp}/work/live")) == window
    fan(second, 1)
    fan(second, 1)
    kept = ts.rolling_retention(fs, "Machine", live.ORDER, 3)
    assert read_published(spark, f"{tmp}/work/live").count() == kept.count()
    assert spark.read.parquet(f"{tmp}/work/history").count() == 130
    assert fan.failures == []


def _small_batches(b, n):
    fs = b.fact_sensor.withColumn("_n", F.row_number().over(Window.orderBy("Timestamp", "Machine")))
    fs = fs.withColumn("_b", F.col("_n") % n).drop("_n").persist()
    return [fs.where(F.col("_b") == i).drop("_b") for i in range(n)]


def test_twenty_replays_leave_window_and_history(spark, tmp, bronze):
    fan = live.SinkFanout(f"{tmp}/work", per_machine=3)
    first, second, _ = _small_batches(bronze, 3)
    fan(first, 0)
    fan(second, 1)
    window, kpis = rows(read_published(spark, f"{tmp}/work/live")), rows(read_published(spark, f"{tmp}/work/kpis"))
    log, n = commits(spark, f"{tmp}/work/live"), spark.read.parquet(f"{tmp}/work/history").count()
    for i in range(20):
        fan(second if i % 2 else first, i % 2)
        if i < 3:
            fan.retention(second, 1)                                  # the sink itself, as after a lost record
    assert rows(read_published(spark, f"{tmp}/work/live")) == window and rows(read_published(spark, f"{tmp}/work/kpis")) == kpis
    assert commits(spark, f"{tmp}/work/live") == log and spark.read.parquet(f"{tmp}/work/history").count() == n
    assert rows(read_published(spark, f"{tmp}/work/live")) == rows(
        ts.rolling_retention(first.unionByName(second), "Machine", live.ORDER, 3))


def test_a_sink_down_for_ten_batches_gets_them_in_order(spark, tmp, bronze):
    seen, others, down = [], [], [True]

    def flaky(batch, batch_id):
        if down[0]:
            raise RuntimeError("down")
        seen.append((batch_id, batch.count()))

    box = Outbox(f"{tmp}/box", live.SENSOR_SCHEMA, {"steady": lambda b, i: others.append((i, b.count())), "flaky": flaky}, keep=2)
    batches = _small_batches(bronze, 12)
    for i in range(10):
        assert box.store(batches[i], i, "q") and box.deliver(spark) == {"flaky": i + 1}
    want = [(i, b.count()) for i, b in enumerate(batches)]
    assert others == want[:10] and not seen                           # each once, without replays
    assert len(box.stored(spark)) == 10                               # kept for the sink that is behind
    again = Outbox(f"{tmp}/box", live.SENSOR_SCHEMA, box.sinks, keep=2, at_once=4)    # after a restart
    down[0] = False
    assert again.store(batches[10], 10, "q") and again.deliver(spark) == {"flaky": 7}
    assert again.deliver(spark) == {"flaky": 3} and again.deliver(spark) == {}
    assert seen == want[:11] == others
    assert box.stored(spark) == [9, 10]                               # taken by all, but for the newest
    assert not again.store(batches[0], 0, "q") and not again.store(batches[10], 10, "q")
    with pytest.raises(SinkError):
        again.store(batches[11], 11, "another query")


def test_replayed_ingest_does_not_publish_twice(spark, tmp, bronze):
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 40)])
    for _ in range(2):                                                # a new checkpoint replays batch 0
        live.start_ingest(spark, f"{tmp}/ticks", f"{tmp}/work", f"{tmp}/ck-{_}",
                          dim_machine=bronze.dim_machine).awaitTermination()
    assert spark.read.parquet(f"{tmp}/work/labelled").count() == bronze.fact_sensor.count()


def test_factory_kpi_stream_matches_batch(spark, tmp, bronze):
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 40)])
    q = (live.factory_kpi_stream(live.read_ticks(spark, f"{tmp}/ticks"))
         .writeStream.outputMode("update").format("memory").queryName("kpi_stream_test")
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["Factory_ID"], r["Event_Date"]): r for r in spark.table("kpi_stream_test").collect()}
    want = {(r["Factory_ID"], r["Event_Date"]): r for r in gold.factory_kpi(silver.silver_sensor(bronze.fact_sensor)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g["Total_Warnings"] == w["Total_Warnings"] and g["Total_Errors"] == w["Total_Errors"]
        assert abs(g["Total_Power_Consumed_kW"] - w["Total_Power_Consumed_kW"]) < 1e-6
        assert abs(g["Active_Machines"] - w["Active_Machines"]) <= max(1, 0.1 * w["Active_Machines"])


def test_cli_available_now(spark, tmp, bronze):
    from millrace.sources.bronze import write_bronze
    write_bronze(bronze, f"{tmp}/bronze", ["dim_machine"])
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 40)])
    live.main(["--ticks", f"{tmp}/ticks", "--work", f"{tmp}/work", "--bronze", f"{tmp}/bronze",
               "--available-now"])
    assert spark.read.parquet(f"{tmp}/work/history").count() == bronze.fact_sensor.count()
    energy = spark.read.parquet(f"{tmp}/work/gold_energy")
    want = operations.energy_daily(silver.silver_sensor(bronze.fact_sensor))
    assert rows(energy, "Date", "Machine", "Peak_Usage") == rows(want, "Date", "Machine", "Peak_Usage")


def test_factory_kpi_stream_drops_late_days(spark, tmp, bronze):
    first = bronze.fact_sensor.select(F.min(F.to_date("Timestamp"))).first()[0]
    fs = bronze.fact_sensor.withColumn("_d", F.datediff(F.to_date("Timestamp"), F.lit(first)))
    fs.where("_d >= 10").drop("_d").coalesce(1).write.mode("append").parquet(f"{tmp}/ticks")

    def sink(batch, batch_id):
        batch.write.mode("append").parquet(f"{tmp}/kpi_updates")

    def run():
        q = (live.factory_kpi_stream(live.read_ticks(spark, f"{tmp}/ticks"))
             .writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return live.late_rows(q)

    run()
    fs.where("_d < 3").drop("_d").coalesce(1).write.mode("append").parquet(f"{tmp}/ticks")   # far too late
    assert run() > 0                                                  # counted
    days = {r["Event_Date"] for r in spark.read.parquet(f"{tmp}/kpi_updates").collect()}
    assert days and all((d - first).days >= 10 for d in days)


def test_exact_factory_days_equal_the_batch_and_late_rows_are_kept(spark, tmp, bronze, monkeypatch):
    """Batches of a few days each, replays and a crash between; a batch of old days comes far too late."""
    fs = bronze.fact_sensor
    first = fs.select(F.min(F.to_date("Timestamp"))).first()[0]
    part = fs.withColumn("_d", F.datediff(F.to_date("Timestamp"), F.lit(first))).persist()
    top = part.agg(F.max("_d")).first()[0]
    early, handler = part.where("_d < 2 AND RPM % 120 = 0").drop("_d"), live.FactoryDays(f"{tmp}/kpi", "1 day")
    rest = part.where("NOT (_d < 2 AND RPM % 120 = 0)")
    step = max(1, top // 4)
    cuts = [rest.where((F.col("_d") >= lo) & (F.col("_d") < lo + step)).drop("_d") for lo in range(0, top + 1, step)]
    for i, batch in enumerate(cuts):
        if i == 1:
            def lost(*_):
                raise OSError("lost")
            for name in ("publish_version", "store"):
                monkeypatch.setattr(live, name, lost)
                with pytest.raises(OSError):
                    handler(batch, i)
                monkeypatch.undo()
        handler(batch, i)
        handler(batch, i)                                             # a replay
    handler(early, len(cuts))
    want = gold.factory_kpi(silver.silver_sensor(rest.drop("_d")))
    got = live.FactoryDays.read(spark, f"{tmp}/kpi")
    assert rows(got.select(*want.columns)) == rows(want.withColumn("Total_Power_Consumed_kW", F.col("Total_Power_Consumed_kW").cast("double")))
    late = spark.read.parquet(f"{tmp}/kpi_late")
    assert early.count() > 0
    assert rows(late.select("Machine", "Timestamp", "Temperature")) == rows(early.select("Machine", "Timestamp", "Temperature"))
    days = read_published(spark, f"{tmp}/kpi_open").select(F.min("Event_Date")).first()[0]
    assert (days - first).days >= top - 1                             # closed days are not held


def test_gold_queries_of_the_live_feed(spark, tmp, bronze):
    _write_ticks(bronze, f"{tmp}/ticks", [(0, 40)])
    live.start_ingest(spark, f"{tmp}/ticks", f"{tmp}/work", f"{tmp}/ck1", dim_machine=bronze.dim_machine).awaitTermination()
    for q in live.start_gold(spark, f"{tmp}/work", f"{tmp}/ck2"):
        q.awaitTermination()
    want = gold.factory_kpi(silver.silver_sensor(spark.read.parquet(f"{tmp}/work/labelled")))
    got = live.FactoryDays.read(spark, f"{tmp}/work/gold_factory_kpi")
    assert rows(got, "Factory_ID", "Event_Date", "Active_Machines", "Total_Warnings", "Total_Errors") == rows(
        want, "Factory_ID", "Event_Date", "Active_Machines", "Total_Warnings", "Total_Errors")
