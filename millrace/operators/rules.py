"""Disturbance rules and machine baselines.

A rule is (machine, sensor, min, max): while a machine has at least one rule it
runs in 'Custom Disturbance' mode and each ruled sensor's target is drawn from
[min, max]. Baselines override a machine's nominal temperature / vibration.
Side files are JSON; they are parsed with ``from_json`` on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import three_phase_current

# Sensor display names (as used in rule files) in channel order,
# the default rule bounds and the alert line texts.
SENSOR_DISPLAY = ["Temperature", "Vibration", "Voltage", "Current", "Power Consumption",
                  "Pressure", "RPM", "Oil Level", "Humidity", "Noise"]
RULE_DEFAULT_MIN, RULE_DEFAULT_MAX = 0.0, 100.0
ALERT_RULE = "⚠️ %s | %s forced to %s-%s"
ALERT_BASELINE = "🎯 %s Baseline | %s"
ALERT_NONE = "All sensors in IDEAL state."

RULES_SCHEMA = T.StructType([
    T.StructField("machine", T.StringType()), T.StructField("sensor", T.StringType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])


def column_of(display: str) -> str:
    return display.replace(" ", "_")


# ------------------------------------------------------------------- S8 / S9


def read_rules_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parse a rules JSON array -> (rules, rejected).

    Non-objects and objects without ``machine`` are skipped; an object with a
    machine but without sensor/min/max is rejected (reported, not applied);
    for a repeated (machine, sensor) the last entry wins. An unreadable file
    yields no rules and one rejected row.
    """
    raw = spark.read.option("wholetext", True).text(path)
    items = raw.select(F.from_json("value", "array<string>").alias("items"))
    unreadable = items.where(F.col("items").isNull()).select(
        F.lit(None).cast("string").alias("item"), F.lit("unreadable file").alias("reason"))
    ex = items.select(F.posexplode("items").alias("pos", "item"))
    is_obj = F.trim(F.col("item")).startswith("{")
    m = F.get_json_object("item", "$.machine")
    s = F.get_json_object("item", "$.sensor")
    lo = F.get_json_object("item", "$.min").try_cast("double")
    hi = F.get_json_object("item", "$.max").try_cast("double")
    parsed = ex.where(is_obj & m.isNotNull()).select(
        "pos", "item", m.alias("machine"), s.alias("sensor"), lo.alias("min"), hi.alias("max"))
    complete = F.col("sensor").isNotNull() & F.col("min").isNotNull() & F.col("max").isNotNull()
    rejected = parsed.where(~complete).select("item", F.lit("missing sensor/min/max").alias("reason"))
    good = parsed.where(complete)
    rules = (good.groupBy("machine", "sensor")
             .agg(F.max_by(F.struct("min", "max"), "pos").alias("r"))
             .select("machine", "sensor", "r.min", "r.max"))
    return rules, rejected.unionByName(unreadable)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value) of the lines of one or many text files; places ascend with file name and line."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(place.alias("place"), "value").where(F.trim("value") != "")


def read_rules_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules as JSON lines, one entry a line, in any number of files -> (rules, rejected).

    The rules of ``read_rules_file`` for rule sets of any size: lines are read
    in parallel, no task sees all of them, and a line that is not JSON is
    rejected alone. For a repeated (machine, sensor) the last line of the last
    file by name wins.
    """
    entry = _lines(spark, path).withColumn("entry", F.try_parse_json("value"))

    def get(field: str, kind: str):
        return F.try_variant_get("entry", f"$.{field}", kind).alias(field)

    parsed = entry.where(F.col("entry").isNull() | F.schema_of_variant("entry").startswith("OBJECT")).select(
        "place", "value", "entry", get("machine", "string"), get("sensor", "string"), get("min", "double"), get("max", "double"))
    complete = F.col("sensor").isNotNull() & F.col("min").isNotNull() & F.col("max").isNotNull()
    with_machine = parsed.where(F.col("machine").isNotNull())
    rejected = with_machine.where(~complete).select(F.col("value").alias("item"), F.lit("missing sensor/min/max").alias("reason"))
    broken = parsed.where(F.col("entry").isNull()).select(F.col("value").alias("item"), F.lit("unreadable line").alias("reason"))
    rules = (with_machine.where(complete).groupBy("machine", "sensor")
             .agg(F.max_by(F.struct("min", "max"), "place").alias("r")).select("machine", "sensor", "r.min", "r.max"))
    return rules, rejected.unionByName(broken)


def read_baselines_lines(spark: SparkSession, path: str) -> DataFrame:
    """Baselines as JSON lines, each ``{machine: {sensor: value}}`` -> (machine, sensor, value).

    For any number of machines; a sensor given twice for a machine has its last value.
    """
    m = _lines(spark, path).select("place", F.from_json("value", "map<string,map<string,string>>").alias("b"))
    every = (m.select("place", F.explode("b").alias("machine", "vals"))
             .select("place", "machine", F.explode("vals").alias("sensor", "text")))
    return (every.groupBy("machine", "sensor").agg(F.max_by("text", "place").alias("text"))
            .select("machine", "sensor", F.col("text").try_cast("double").alias("value")))


def read_baselines_file(spark: SparkSession, path: str) -> DataFrame:
    """Baselines JSON ``{machine: {sensor: value}}`` -> (machine, sensor, value)."""
    raw = spark.read.option("wholetext", True).text(path)
    m = raw.select(F.from_json("value", "map<string,map<string,string>>").alias("b"))
    return (m.select(F.explode("b").alias("machine", "vals"))
             .select("machine", F.explode("vals").alias("sensor", "text"))
             .select("machine", "sensor", F.col("text").try_cast("double").alias("value")))


# ------------------------------------------------------------- D1 / D2 / D3


def rule_upsert(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rules with the same (machine, sensor), add the others.

    Missing bounds default to 0 and 100. Idempotent: upserting twice is a no-op.
    """
    new = new.select("machine", "sensor",
                     F.coalesce(F.col("min"), F.lit(RULE_DEFAULT_MIN)).alias("min"),
                     F.coalesce(F.col("max"), F.lit(RULE_DEFAULT_MAX)).alias("max"))
    kept = rules.join(new.select("machine", "sensor"), ["machine", "sensor"], "left_anti")
    return kept.unionByName(new)


def rules_clear(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULES_SCHEMA)


def rules_clear_machines(rules: DataFrame, machines: DataFrame) -> DataFrame:
    """The rules without those of the given machines."""
    return rules.join(machines.select("machine").distinct(), "machine", "left_anti")


def baseline_merge(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial baseline update: supplied sensors change, others are kept.

    ``updates``: (machine, sensor, text). One non-numeric value rejects the
    whole update of that machine.
    """
    u = updates.withColumn("value", F.col("text").try_cast("double"))
    ok = (u.groupBy("machine")
           .agg(F.bool_and(F.col("value").isNotNull() | F.col("text").isNull()
                           | (F.trim(F.col("text")) == "")).alias("ok"))
           .where("ok").select("machine"))
    accepted = (u.join(ok, "machine", "left_semi").where(F.col("value").isNotNull())
                 .select("machine", "sensor", F.col("value").alias("_new")))
    j = current.select("machine", "sensor", F.col("value").alias("_old")).join(
        accepted, ["machine", "sensor"], "full_outer")
    return j.select("machine", "sensor", F.coalesce("_new", "_old").alias("value"))


# ------------------------------------------------------------------ D4 - D8


def latest_rules(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Last entry wins per (machine, sensor) under ``order``."""
    return (candidates.groupBy("machine", "sensor")
            .agg(F.max_by(F.struct("min", "max"), F.struct(*order)).alias("r"))
            .select("machine", "sensor", "r.min", "r.max"))


def rules_by_machine(rules: DataFrame) -> DataFrame:
    """machine -> map(sensor -> struct(min, max)) (one entry per sensor)."""
    return rules.groupBy("machine").agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("sensor", F.struct("min", "max"))))).alias("rules"))


def disturbed_machine_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.countDistinct("machine").alias("Disturbed_Machines"))


def label_modes(rows: DataFrame, rules: DataFrame, machine_col: str = "Machine") -> DataFrame:
    """Mode labelling (D5, D6): a machine with any rule (even for an unknown sensor) runs in
    'Custom Disturbance' mode with status 'Warning'.

    Readings and error codes are measured facts and stay; so do status and mode
    of a machine without a rule.
    """
    ruled = rules.select(F.col("machine").alias("_rm")).distinct()
    j = rows.join(ruled, rows[machine_col] == ruled["_rm"], "left")
    hit = F.col("_rm").isNotNull()
    new = {"Mode": F.when(hit, "Custom Disturbance").otherwise(F.col("Mode")),
           "Running_Status": F.when(hit, "Warning").otherwise(F.col("Running_Status"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def active_alerts(rules: DataFrame, baselines: DataFrame) -> DataFrame:
    """One text line per rule and per machine baseline; a single 'all ideal'
    line when there is neither (D7). Output: Alert_Type, Machine, Alert."""
    r = rules.select(F.lit("rule").alias("Alert_Type"), F.col("machine").alias("Machine"),
                     F.format_string(ALERT_RULE, "machine", "sensor",
                                     F.col("min").cast("string"), F.col("max").cast("string")).alias("Alert"))
    b = (baselines.where(F.col("sensor").isin("Temperature", "Vibration") & F.col("value").isNotNull())
         .groupBy("machine")
         .agg(F.max(F.when(F.col("sensor") == "Temperature", F.col("value"))).alias("t"),
              F.max(F.when(F.col("sensor") == "Vibration", F.col("value"))).alias("v"))
         .select(F.lit("baseline").alias("Alert_Type"), F.col("machine").alias("Machine"),
                 F.format_string(ALERT_BASELINE, "machine", F.concat_ws(
                     ", ",
                     F.when(F.col("t").isNotNull(), F.concat(F.lit("Temp: "), F.col("t").cast("string"))),
                     F.when(F.col("v").isNotNull(), F.concat(F.lit("Vib: "), F.col("v").cast("string")))))
                 .alias("Alert")))
    lines = r.unionByName(b)
    # an aggregate without keys has one row also over no lines
    none = (lines.agg(F.count("*").alias("n")).where("n = 0")
            .select(F.lit("none").alias("Alert_Type"), F.lit(None).cast("string").alias("Machine"),
                    F.lit(ALERT_NONE).alias("Alert")))
    return lines.unionByName(none)


def range_breach(rows: DataFrame, rules: DataFrame, id_cols: list[str],
                 machine_col: str = "Machine") -> DataFrame:
    """Readings outside their rule's [min, max].

    Rows are joined to their machine's rules (one map per machine) before
    anything is unpivoted, so only the ruled sensors of ruled machines become
    rows of their own.
    """
    present = [d for d in SENSOR_DISPLAY if column_of(d) in rows.columns]
    by_m = rules.where(F.col("sensor").isin(present))
    by_m = rules_by_machine(by_m).withColumnRenamed("machine", "_rm")
    value = F.lit(None).cast("double")
    for d in present:
        value = F.when(F.col("Sensor") == d, F.col(column_of(d)).cast("double")).otherwise(value)
    j = rows.join(by_m, rows[machine_col] == by_m["_rm"], "inner")
    long = j.select("*", F.explode("rules").alias("Sensor", "_r")).withColumn("Value", value)
    return (long.where((F.col("Value") < F.col("_r.min")) | (F.col("Value") > F.col("_r.max")))
            .select(*id_cols, "Sensor", "Value", F.col("_r.min").alias("Rule_Min"), F.col("_r.max").alias("Rule_Max")))


def rules_from_maintenance(fact_maintenance: DataFrame) -> DataFrame:
    """A rule set derived from maintenance logs (one candidate rule per log;
    the failure code picks the sensor, downtime sets the band; latest log
    wins per machine and sensor)."""
    f = F.col("Failure")
    sensor = (F.when(f == "F0", "Temperature").when(f == "F1", "Vibration")
              .when(f == "F2", "Power Consumption").when(f == "F3", "RPM").otherwise("Pressure"))
    cand = fact_maintenance.select(
        F.col("Machine").alias("machine"), sensor.alias("sensor"),
        (F.col("Downtime") * 2).alias("min"), (F.col("Downtime") * 2 + 50).alias("max"),
        "Date", "Cost")
    return latest_rules(cand, ["Date", "Cost", "min"])


# Starting state of each smoothed channel -- a column of the
# machine dimension, or a number where the dimension has none -- and the
# decimals its smoothed values are rounded to.
NOMINAL = {"Temperature": "normal_temp", "Vibration": "vibration_base", "Voltage": 400.0, "Current": None,
           "Power_Consumption": "power_kw", "Pressure": 100.0, "RPM": "max_rpm", "Oil_Level": 95.0,
           "Humidity": 45.0, "Noise": 62.5}
DECIMALS = {"Temperature": 2, "Vibration": 3, "Voltage": 2, "Current": 2, "Power_Consumption": 2,
            "Pressure": 2, "RPM": 0, "Oil_Level": 2, "Humidity": 2, "Noise": 2}


def initial_state(dim_machine: DataFrame, baselines: DataFrame) -> DataFrame:
    """Starting state per machine and channel: a machine's baseline replaces the
    nominal value of that sensor, other sensors keep the nominal value (J6).

    The current starts at the three-phase current of nominal power and voltage.
    ``baselines``: (machine, sensor, value) with display sensor names.
    """
    b = (baselines.where(F.col("value").isNotNull())
         .groupBy(F.col("machine").alias("_bm"))
         .agg(*[F.max(F.when(F.col("sensor") == disp, F.col("value"))).alias(f"_b_{column_of(disp)}")
                for disp in ("Temperature", "Vibration")]))
    j = dim_machine.join(b, dim_machine["Machine"] == b["_bm"], "left")
    cols = []
    for c, nominal in NOMINAL.items():
        if nominal is None:
            v = three_phase_current(F.col("power_kw").cast("double"), F.lit(NOMINAL["Voltage"]))
        else:
            v = F.col(nominal).cast("double") if isinstance(nominal, str) else F.lit(nominal)
        if c in ("Temperature", "Vibration"):
            v = F.coalesce(F.col(f"_b_{c}"), v)
        cols.append(v.alias(c))
    return j.select("Machine", *cols)
