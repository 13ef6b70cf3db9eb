"""Structured Streaming versions of the live telemetry loop (ST1-ST7).

Pipeline (two chained queries, both checkpointed):

1. ``ingest``: file source of ticks -> ``foreachBatch``: re-read the rule and
   baseline files (so edits apply on the next tick), label modes, attach each
   machine's starting state, and publish the batch as ``<work>/labelled/batch=<id>``
   by one folder rename. A replayed batch that is already published is left
   alone, so the second query never meets the same rows under new file names.
2. ``smooth``: file source over the labelled folder -> ``foreachBatch``:
   per-machine exponential smoothing from the published state of the batch
   before (it survives restarts); then the batch goes to an outbox, from which
   each sink takes it at its own pace: history append keyed by batch id, rolling
   retention and live KPIs published as new versions, optional JDBC replace. A
   failing sink is reported, stops nothing else and catches up later.

Streaming gold: ``FactoryDays`` keeps sums per factory, open day and machine, so
its KPIs are exact and readings that come too late are kept apart;
``factory_kpi_stream`` is the same as one streaming aggregate with a watermark,
whose active machines are ``approx_count_distinct``.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import rules as R
from millrace.functions import half_up, status_colour
from millrace.operators.operations import CO2_PER_KWH, COST_PER_KWH
from millrace.operators.pieces import PIECE_ROWS
from millrace.operators.timeseries import (
    EMA_ALPHA, ema_rounding, ema_smooth, latest_per_key, rolling_retention, tail_n, tail_per_key,
)
from millrace.schemas import SCHEMAS
from millrace.session import ship_package, store
from millrace.sources.files import (
    _fs, current_version, insert_batch, jdbc_replace, publish_version, read_published, read_published_before,
)
from millrace.streaming.outbox import Outbox

log = logging.getLogger(__name__)

SENSOR_SCHEMA = SCHEMAS["fact_sensor"]
SMOOTHED = list(R.NOMINAL)
START = {c: f"Start_{c}" for c in SMOOTHED}
LABELLED_SCHEMA = T.StructType([*SENSOR_SCHEMA.fields, *(T.StructField(s, T.DoubleType()) for s in START.values())])
ORDER = ["Timestamp", "Machine"]
LINES = ".jsonl"  # rule and baseline files of one entry a line; others are one document


# ---------------------------------------------------------------------- ST1


def read_ticks(spark: SparkSession, folder: str, fmt: str = "parquet",
               max_files_per_trigger: int | None = None, recursive: bool = False) -> DataFrame:
    """Tick files as a stream with the bronze sensor schema (no inference)."""
    ship_package(spark)
    r = spark.readStream.schema(SENSOR_SCHEMA).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.load(folder)


# ---------------------------------------------------------------------- ST5


def current_rules(spark: SparkSession, rules_path: str | None) -> tuple[DataFrame, DataFrame | None]:
    """(rules, rejected entries) of the rule file as it is now; a missing file is no rules."""
    if not rules_path:
        return R.rules_clear(spark), None
    fs, p = _fs(spark, rules_path)
    if not fs.exists(p):
        return R.rules_clear(spark), None
    return (R.read_rules_lines if rules_path.endswith(LINES) else R.read_rules_file)(spark, rules_path)


def current_baselines(spark: SparkSession, path: str | None) -> DataFrame:
    """Baselines as they are now; a missing file is no baselines."""
    if path:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            return (R.read_baselines_lines if path.endswith(LINES) else R.read_baselines_file)(spark, path)
    return spark.createDataFrame([], "machine string, sensor string, value double")


def label_batch(batch: DataFrame, rules: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Label the modes of one batch and attach every machine's starting state."""
    out = R.label_modes(batch, rules).select(*[f.name for f in SENSOR_SCHEMA.fields])
    if start is None:
        return out.select("*", *[F.lit(None).cast("double").alias(s) for s in START.values()])
    start = start.select(F.col("Machine").alias("_sm"), *[F.col(c).cast("double").alias(s) for c, s in START.items()])
    return out.join(start, out["Machine"] == start["_sm"], "left").drop("_sm")


def start_ingest(spark: SparkSession, ticks: str, work: str, checkpoint: str,
                 rules_path: str | None = None, fmt: str = "parquet", available_now: bool = True,
                 interval: str = "5 seconds", max_files_per_trigger: int | None = None,
                 dim_machine: DataFrame | None = None, baselines_path: str | None = None):
    """Query 1: ticks -> rules and baselines of this moment -> labelled batches."""
    work = work.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id)

    def publish_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, target = _fs(spark, f"{work}/labelled/batch={batch_id}")
        if fs.exists(target):
            return  # a replay of a published batch
        rules, rejected = current_rules(spark, rules_path)
        if rejected is not None:
            publish_version(rejected, f"{work}/rejected_rules", f"b{batch_id:012d}")
        start = None if dim_machine is None else R.initial_state(dim_machine, current_baselines(spark, baselines_path))
        staged = f"{work}/_staging/batch={batch_id}"
        label_batch(batch, rules, start).write.mode("overwrite").parquet(staged)
        fs.mkdirs(target.getParent())
        if not fs.rename(_fs(spark, staged)[1], target):
            raise OSError(f"cannot publish {target}")

    src = read_ticks(spark, ticks, fmt, max_files_per_trigger)
    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


# ---------------------------------------------------------------------- ST2

STATE_SCHEMA = T.StructType([T.StructField("Machine", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in SMOOTHED)])


def smooth_batch(batch: DataFrame, state: DataFrame | None, alpha: float = EMA_ALPHA,
                 piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with smoothed channels, state after them) of one labelled micro-batch.

    ``state`` holds each machine's unrounded channels after the batch before. A
    machine that is not in it starts from the ``Start_`` columns of its first
    row, which ingest took from the baselines of that moment. Rows are folded in
    event-time order, over pieces of ``piece_rows`` rows (``ema_smooth``), so no
    task holds a machine's whole batch. Outputs are rounded per channel.
    """
    spark = batch.sparkSession
    order = ["Timestamp", "Temperature", "RPM", *[c for c in SMOOTHED if c not in ("Temperature", "RPM")]]
    known = spark.createDataFrame([], STATE_SCHEMA) if state is None else state
    first = F.min_by(F.struct(*[F.col(s).alias(c) for c, s in START.items()]), F.struct(*order))
    new = (batch.groupBy("Machine").agg(first.alias("_s")).select("Machine", *[F.col("_s")[c].alias(c) for c in SMOOTHED])
           .join(known.select("Machine"), "Machine", "left_anti"))
    rows = ema_smooth(batch.select(*SENSOR_SCHEMA.fieldNames()), "Machine", "Timestamp", order[1:], SMOOTHED,
                      known.unionByName(new), alpha, piece_rows, places=True)
    last = F.max_by(F.struct(*SMOOTHED), F.struct("_piece", "_seq"))
    seen = rows.groupBy("Machine").agg(last.alias("_s")).select("Machine", *[F.col("_s")[c].alias(c) for c in SMOOTHED])
    after = seen.unionByName(known.join(seen.select("Machine"), "Machine", "left_anti"))
    return ema_rounding(rows.drop("_piece", "_seq"), R.DECIMALS), after


class Smoother:
    """``foreachBatch`` handler: smooths a micro-batch, publishes the state after it and hands the rows on.

    The state is a published table with one version a batch. A replayed batch
    starts from the version before it, so it gives the same rows and state.
    """

    def __init__(self, work: str, fanout: SinkFanout, piece_rows: int = PIECE_ROWS):
        self.state = f"{work.rstrip('/')}/state"
        self.fanout = fanout
        self.piece_rows = piece_rows

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = f"b{batch_id:012d}"
        stored = self.fanout.outbox.stored(spark)
        if (current_version(spark, self.state) or "") >= version and stored and stored[-1] >= batch_id:
            self.fanout.catch_up(spark)  # a replay of a batch that is done
            return
        rows, after = smooth_batch(batch, read_published_before(spark, self.state, version, STATE_SCHEMA), piece_rows=self.piece_rows)
        publish_version(after, self.state, version)
        self.fanout(rows, batch_id)


# ------------------------------------------------------- ST3 / ST4 / ST6


def live_kpis(window: DataFrame, n: int = 500) -> DataFrame:
    """Machines, warnings and mean power over the newest ``n`` rows."""
    w = tail_n(window, n, ORDER)
    return w.agg(F.countDistinct("Machine").alias("Machines"),
                 F.sum(F.when(F.col("Running_Status") == "Warning", 1).otherwise(0)).alias("Warnings"),
                 F.avg("Power_Consumption").alias("Avg_Power"))


def machine_status(window: DataFrame) -> DataFrame:
    """Newest row per machine with its status colour (W1 + P15)."""
    latest = latest_per_key(window.select("Machine", "Timestamp", "Mode", "Running_Status", "Error_Code"),
                            "Machine", ORDER)
    return latest.withColumn("Status_Colour", status_colour("Running_Status"))


class SinkFanout:
    """``foreachBatch`` handler that gives one micro-batch to every sink.

    The batch is stored once in ``<work>/outbox``; then each sink takes what it
    has not had yet, in order (see ``outbox``). A sink that is down is reported
    in ``failures`` (batch id, sink, error) and stays behind alone: the stream
    and the other sinks go on, no batch is replayed for its sake, and it catches
    up with the next batch or with ``catch_up``. The stream fails only if the
    batch cannot be stored. All writes depend only on the batch, its id and what
    was published before that id, so a repeated delivery leaves the same result.
    """

    def __init__(self, work: str, per_machine: int = 10, kpi_rows: int = 500,
                 jdbc: tuple[str, str, dict] | None = None,
                 extra: dict[str, Callable[[DataFrame, int], None]] | None = None):
        self.work = work.rstrip("/")
        self.per_machine = per_machine
        self.kpi_rows = kpi_rows
        self.jdbc = jdbc
        sinks = {"history": self.history, "retention": self.retention, **({"relational": self.relational} if jdbc else {}),
                 **(extra or {})}
        self.outbox = Outbox(f"{self.work}/outbox", SENSOR_SCHEMA, sinks)

    @property
    def failures(self) -> list[tuple[int, str, str]]:
        return self.outbox.failures

    def history(self, batch: DataFrame, batch_id: int) -> None:
        insert_batch(batch, f"{self.work}/history", batch_id)

    def retention(self, batch: DataFrame, batch_id: int) -> None:
        spark, base = batch.sparkSession, f"{self.work}/live"
        version = f"b{batch_id:012d}"
        if (current_version(spark, base) or "") < version:  # else a repeated delivery
            prev = read_published(spark, base, SENSOR_SCHEMA)
            full = batch if prev is None else prev.unionByName(batch)
            kept = rolling_retention(full, "Machine", ORDER, self.per_machine)
            publish_version(kept, base, version, parent=current_version(spark, base))
        window = read_published(spark, base, SENSOR_SCHEMA)
        publish_version(live_kpis(window, self.kpi_rows), f"{self.work}/kpis", version)
        publish_version(machine_status(window), f"{self.work}/status", version)
        publish_version(tail_per_key(window, "Machine", ORDER, 5, pos_col="Position"),
                        f"{self.work}/recent", version)

    def relational(self, batch: DataFrame, batch_id: int) -> None:
        url, table, props = self.jdbc
        jdbc_replace(read_published(batch.sparkSession, f"{self.work}/live", SENSOR_SCHEMA), url, table, props)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.outbox.store(batch, batch_id, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        self.outbox.deliver(spark)

    def catch_up(self, spark: SparkSession) -> dict[str, int]:
        """Call the sinks that are behind; returns those that still are, with their number of batches."""
        left = self.outbox.behind(spark)
        while left:
            now = self.outbox.deliver(spark)
            if now == left:
                break
            left = now
        return left


def start_smoothing(spark: SparkSession, work: str, checkpoint: str, fanout: SinkFanout,
                    available_now: bool = True, interval: str = "5 seconds",
                    max_files_per_trigger: int = 100):
    """Query 2: labelled batches -> smoothing from the state before -> sink fan-out."""
    fs, p = _fs(spark, f"{work.rstrip('/')}/labelled")
    fs.mkdirs(p)
    stream = (spark.readStream.schema(LABELLED_SCHEMA).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{work.rstrip('/')}/labelled"))
    w = stream.writeStream.foreachBatch(Smoother(work, fanout)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


# ---------------------------------------------------------------------- ST7


def factory_kpi_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming factory KPIs per event-time day with bounded state."""
    ts = F.col("Timestamp").cast("timestamp")
    s = stream.withColumn("_ts", ts).withWatermark("_ts", watermark)
    return (s.groupBy(F.upper("Factory").alias("Factory_ID"), F.window("_ts", "1 day").alias("w"))
             .agg(F.approx_count_distinct("Machine").alias("Active_Machines"),
                  F.sum(F.col("Power_Consumption").cast("decimal(10,2)")).cast("double")
                   .alias("Total_Power_Consumed_kW"),
                  F.sum(F.when(F.col("Running_Status") == "Warning", 1).otherwise(0)).alias("Total_Warnings"),
                  F.sum(F.when(F.nullif("Error_Code", F.lit("None")).isNotNull(), 1).otherwise(0))
                   .alias("Total_Errors"))
             .select("Factory_ID", F.to_date("w.start").alias("Event_Date"), "Active_Machines",
                     "Total_Power_Consumed_kW", "Total_Warnings", "Total_Errors"))


OPEN_SCHEMA = T.StructType([
    T.StructField("Factory_ID", T.StringType()), T.StructField("Event_Date", T.DateType()), T.StructField("Machine_ID", T.StringType()),
    T.StructField("Power", T.DecimalType(38, 2)), T.StructField("Warnings", T.LongType()), T.StructField("Errors", T.LongType())])
CLOCK_SCHEMA = T.StructType([T.StructField("Newest", T.TimestampType())])


class FactoryDays:
    """``foreachBatch`` handler: exact factory KPIs per day of a feed that never ends.

    What is kept between batches is one row per factory, open day and machine
    (sums so far), so distinct machines are counted exactly and the state is
    bounded by the open days. A day closes when the newest reading is ``lateness``
    past its end. The days that a batch changes are written under the batch's
    number, and the newest number of a day holds (``read``). Readings of closed
    days change nothing: they go to ``<out>_late``, row by row, under the number
    of the batch that brought them. State and clock are published tables with
    one version a batch; a replayed batch starts from the versions before it.
    Readings without a time are left out, as in the batch KPIs.
    """

    def __init__(self, out: str, lateness: str = "1 day"):
        self.out = out.rstrip("/")
        self.lateness = lateness

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, f"b{batch_id:012d}"
        if (current_version(spark, f"{self.out}_clock") or "") >= version:
            return  # a replay of a batch that is done
        was_open = read_published_before(spark, f"{self.out}_open", version, OPEN_SCHEMA)
        clock = read_published_before(spark, f"{self.out}_clock", version, CLOCK_SCHEMA)
        newest = clock.first()["Newest"] if clock is not None else None
        day = F.to_date("Timestamp")

        def closed(d, at):
            """Whether a day is over, ``lateness`` included, when the newest reading is of time ``at``."""
            end = F.date_add(d, 1).cast("timestamp") + F.expr(f"INTERVAL {self.lateness}")
            return F.coalesce(end <= at, F.lit(False))

        before = F.lit(newest).cast("timestamp")
        insert_batch(batch.where(closed(day, before)).select(*SENSOR_SCHEMA.fieldNames()), f"{self.out}_late", batch_id)
        fresh = batch.where(F.col("Timestamp").isNotNull() & ~closed(day, before))
        part = fresh.groupBy(F.upper("Factory").alias("Factory_ID"), day.alias("Event_Date"), F.upper("Machine").alias("Machine_ID")).agg(
            F.sum(F.col("Power_Consumption").cast("decimal(10,2)")).cast("decimal(38,2)").alias("Power"),
            F.sum(F.when(F.col("Running_Status") == "Warning", 1).otherwise(0)).alias("Warnings"),
            F.sum(F.when(F.nullif("Error_Code", F.lit("None")).isNotNull(), 1).otherwise(0)).alias("Errors"),
        ).withColumn("_now", F.lit(True))
        held = part if was_open is None else part.unionByName(was_open.withColumn("_now", F.lit(False)))
        # stored: the days that this batch changes and the state are both made of it
        days = store(held.groupBy("Factory_ID", "Event_Date", "Machine_ID").agg(
            F.sum("Power").cast("decimal(38,2)").alias("Power"), F.sum("Warnings").alias("Warnings"), F.sum("Errors").alias("Errors"),
            F.bool_or("_now").alias("_now")), "factory-days")
        kpi = days.groupBy("Factory_ID", "Event_Date").agg(
            F.count("Machine_ID").alias("Active_Machines"), F.sum("Power").cast("double").alias("Total_Power_Consumed_kW"),
            F.sum("Warnings").alias("Total_Warnings"), F.sum("Errors").alias("Total_Errors"), F.bool_or("_now").alias("_now"))
        insert_batch(kpi.where("_now").drop("_now"), self.out, batch_id)
        latest = fresh.select(F.col("Timestamp").cast("timestamp").alias("t")).unionByName(spark.range(1).select(before.alias("t")))
        now = latest.agg(F.max("t").alias("Newest")).first()["Newest"]
        still = days.where(~closed(F.col("Event_Date"), F.lit(now).cast("timestamp"))).drop("_now")
        publish_version(still, f"{self.out}_open", version)
        publish_version(spark.createDataFrame([(now,)], CLOCK_SCHEMA), f"{self.out}_clock", version)

    @staticmethod
    def read(spark: SparkSession, out: str) -> DataFrame:
        """The KPIs as they are now: of each factory and day the row of the newest batch."""
        rows = spark.read.parquet(out)
        values = [c for c in rows.columns if c not in ("Factory_ID", "Event_Date", "batch_id")]
        newest = F.max_by(F.struct(*values), "batch_id")
        return rows.groupBy("Factory_ID", "Event_Date").agg(newest.alias("_v")).select(
            "Factory_ID", "Event_Date", *[F.col("_v")[c].alias(c) for c in values])


def energy_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming energy, cost, carbon and peak per machine-day with bounded state."""
    s = stream.withColumn("_ts", F.col("Timestamp").cast("timestamp")).withWatermark("_ts", watermark)
    power = F.col("Power_Consumption").cast("decimal(10,2)")
    day = (s.groupBy(F.upper("Machine").alias("Machine"), F.window("_ts", "1 day").alias("w"))
           .agg(F.sum(power).cast("double").alias("_kwh"), F.max(power).cast("double").alias("_peak")))
    return day.select(F.to_date("w.start").alias("Date"), "Machine", half_up("_kwh", 2).alias("Energy"),
                      half_up(F.col("_kwh") * COST_PER_KWH, 2).alias("Cost"),
                      half_up(F.col("_kwh") * CO2_PER_KWH, 2).alias("Carbon_Emission"),
                      half_up("_peak", 2).alias("Peak_Usage"))


def start_gold(spark: SparkSession, work: str, checkpoint: str, available_now: bool = True,
               interval: str = "5 seconds", watermark: str = "1 day") -> list:
    """Start the streaming factory KPIs and energy over the labelled batches.

    Updated days of each batch land in ``<work>/gold_<name>/batch_id=<id>``,
    replaced when the batch is replayed; the newest batch of a day holds.
    """
    work = work.rstrip("/")
    fs, p = _fs(spark, f"{work}/labelled")
    fs.mkdirs(p)
    def labelled() -> DataFrame:
        return spark.readStream.schema(LABELLED_SCHEMA).option("recursiveFileLookup", True).parquet(f"{work}/labelled")

    energy = energy_stream(labelled(), watermark).writeStream.outputMode("update").foreachBatch(
        lambda df, i: insert_batch(df, f"{work}/gold_energy", i))
    kpi = labelled().writeStream.foreachBatch(FactoryDays(f"{work}/gold_factory_kpi", watermark))
    queries = []
    for name, w in (("factory_kpi", kpi), ("energy", energy)):
        w = w.option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        queries.append((w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start())
    return queries


def late_rows(query) -> int:
    """Rows that the query's watermark has dropped so far, from its progress reports."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0))
               for p in query.recentProgress for s in p.get("stateOperators", []))


def main(argv: list[str] | None = None) -> None:
    """Run the live pipeline: ``python -m millrace.streaming.live --ticks ... --work ...``."""
    import argparse

    from millrace.session import get_spark
    from millrace.sources.bronze import BronzeFolder

    ap = argparse.ArgumentParser(description="live telemetry pipeline")
    ap.add_argument("--ticks", required=True, help="folder where tick files arrive")
    ap.add_argument("--work", required=True, help="shared folder for labelled batches and sinks")
    ap.add_argument("--bronze", required=True, help="stored bronze folder (for dim_machine)")
    ap.add_argument("--rules", default=None, help="rule file, re-read every micro-batch")
    ap.add_argument("--baselines", default=None, help="baseline file (machine -> sensor -> value)")
    ap.add_argument("--interval", default="5 seconds")
    ap.add_argument("--max-files", type=int, default=None)
    ap.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    a = ap.parse_args(argv)
    spark = get_spark("millrace-live")
    dm = BronzeFolder(spark, a.bronze).dim_machine
    work = a.work.rstrip("/")
    q1 = start_ingest(spark, a.ticks, work, f"{work}/_checkpoints/ingest", a.rules,
                      available_now=a.available_now, interval=a.interval,
                      max_files_per_trigger=a.max_files, dim_machine=dm, baselines_path=a.baselines)
    fan = SinkFanout(work)
    if a.available_now:
        q1.awaitTermination()
    q2 = start_smoothing(spark, work, f"{work}/_checkpoints/smooth", fan,
                         available_now=a.available_now, interval=a.interval,
                         max_files_per_trigger=a.max_files or 100)
    gold = start_gold(spark, work, f"{work}/_checkpoints/gold", a.available_now, a.interval)
    for q in (q2, *gold):
        q.awaitTermination()
    if left := fan.catch_up(spark):
        log.error("sinks behind, with their number of batches: %s", left)
    for q in gold:
        log.info("rows behind the watermark: %s", late_rows(q))
    if not a.available_now:
        q1.awaitTermination()


if __name__ == "__main__":
    main()
