"""Operations transforms: energy, uptime, production/scrap/inspection plans,
shipments, repair cost, shifts, time grid, causal chain, extensions.

Coefficients that the reference draws at random are parameters or
hash-uniform columns here, so every result is repeatable and checkable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import half_up, safe_div
from millrace.session import store

# Tariff and emission factor per kWh.
COST_PER_KWH = 0.15
CO2_PER_KWH = 0.4
# Shift table (name, start hour, efficiency multiplier, staffing %).
SHIFTS = [("Morning", 6, 1.05, 100), ("Evening", 14, 1.0, 100), ("Night", 22, 0.9, 80)]
SHIFT_HOURS = 8


# ----------------------------------------------------------------------- A7


def energy_daily(silver_sensor: DataFrame, overhead: float | Column = 1.0) -> DataFrame:
    """Per machine-day energy (sum of power samples x overhead), cost, CO2 and
    peak power, each rounded half-up to 2 places."""
    ov = overhead if isinstance(overhead, Column) else F.lit(float(overhead))
    agg = (silver_sensor.groupBy(F.col("Event_Date").alias("Date"), F.col("Machine_ID").alias("Machine"))
           .agg(F.sum("Power_kW").cast("double").alias("_kwh"), F.max("Power_kW").cast("double").alias("_peak")))
    kwh = F.col("_kwh") * ov
    return agg.select("Date", "Machine",
                      half_up(kwh, 2).alias("Energy"),
                      half_up(kwh * COST_PER_KWH, 2).alias("Cost"),
                      half_up(kwh * CO2_PER_KWH, 2).alias("Carbon_Emission"),
                      half_up("_peak", 2).alias("Peak_Usage"))


# ---------------------------------------------------------------- A9 / J9


def failed_machines(fact_maintenance: DataFrame, dim_machine: DataFrame) -> DataFrame:
    """Distinct (Factory, Date, Machine) with a failure log that day."""
    logs = fact_maintenance.select("Machine", "Date").distinct()
    return logs.join(dim_machine.select("Machine", "Factory"), "Machine", "inner")


def uptime_factor(days: DataFrame, fact_maintenance: DataFrame, dim_machine: DataFrame) -> DataFrame:
    """1 - failed / total machines per (Factory, Date); 1.0 without machines.

    ``days``: the (Factory, Date) grid to report on.
    """
    total = dim_machine.groupBy("Factory").agg(F.count(F.lit(1)).alias("Total_Machines"))
    failed = (failed_machines(fact_maintenance, dim_machine)
              .groupBy("Factory", "Date").agg(F.count(F.lit(1)).alias("Failed_Machines")))
    j = days.join(total, "Factory", "left").join(failed, ["Factory", "Date"], "left")
    failed_n = F.coalesce(F.col("Failed_Machines"), F.lit(0))
    tot = F.coalesce(F.col("Total_Machines"), F.lit(0))
    return j.select("Factory", "Date", tot.alias("Total_Machines"), failed_n.alias("Failed_Machines"),
                    F.when(tot > 0, 1.0 - safe_div(failed_n, tot)).otherwise(F.lit(1.0)).alias("Uptime_Factor"))


# ---------------------------------------------------------------------- A10


def first_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """First occurrence per key under ``order_cols`` (partial-aggregated min_by)."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_f"))
              .select(key, *[F.col("_f")[c].alias(c) for c in rest]))


# ----------------------------------------------------------------------- X1


def daily_failure_prob(dim_machine: DataFrame) -> DataFrame:
    return dim_machine.select("Machine", "reliability",
                              ((1.0 - F.col("reliability")) / 365.0).alias("Daily_Failure_Prob"))


# ----------------------------------------------------------------------- X2

# Reading multipliers of a failing machine from mid-day on.
FAILURE_FACTORS = {"Temperature": 1.5, "Vibration": 3.0, "Power_Consumption": 1.2,
                   "Noise": 1.4, "Pressure": 0.8}


def failure_signature(fact_sensor: DataFrame, fact_maintenance: DataFrame, step_minutes: int = 60) -> DataFrame:
    """What-if overlay: readings of a failing machine after mid-day get the
    failure signature (temperature x1.5, vibration x3, power x1.2, noise x1.4,
    pressure x0.8, status Warning, the day's failure code as error code).

    A day has 1440 / step_minutes readings, numbered from 0; the signature
    starts after the middle one.
    """
    failing = fact_maintenance.groupBy(F.col("Machine").alias("_fm"), F.col("Date").alias("_fd")).agg(
        F.min("Failure").alias("_code"))
    j = fact_sensor.join(failing, (fact_sensor["Machine"] == failing["_fm"])
                         & (F.to_date(fact_sensor["Timestamp"]) == failing["_fd"]), "left")
    minute = F.hour("Timestamp") * 60 + F.minute("Timestamp")
    after = F.floor(minute / step_minutes) > (24 * 60 // step_minutes) // 2
    hit = F.col("_fm").isNotNull() & after
    out = j
    for c, f in FAILURE_FACTORS.items():
        out = out.withColumn(c, F.when(hit, F.col(c) * f).otherwise(F.col(c)))
    out = out.withColumn("Running_Status", F.when(hit, F.lit("Warning")).otherwise(F.col("Running_Status")))
    out = out.withColumn("Error_Code", F.when(hit, F.col("_code")).otherwise(F.col("Error_Code")))
    return out.withColumn("Failure_Window", hit).drop("_fm", "_fd", "_code")


# ----------------------------------------------------------------- X3 / X4


def expected_output(prod: DataFrame, fact_maintenance: DataFrame, dim_machine: DataFrame,
                    yield_factor: float = 0.95, night_factor: float = 0.9) -> DataFrame:
    """int(planned x yield x uptime), night shift x0.9 truncated again.

    Uptime of the order's factory on its start day is looked up directly:
    production rows join the failed-machine counts per factory-day and machine
    totals per factory -- no second pass over production. Both tables are stored
    first, so the planner knows their size: orders of a few factories are not
    dealt by factory while the tables are small.
    """
    total = dim_machine.groupBy(F.col("Factory").alias("_tf")).agg(F.count(F.lit(1)).alias("_tot"))
    failed = (failed_machines(fact_maintenance, dim_machine)
              .groupBy(F.col("Factory").alias("_ff"), F.col("Date").alias("_fd"))
              .agg(F.count(F.lit(1)).alias("_failed")))
    total, failed = store(total, "machine-totals"), store(failed, "failed-machines")
    j = (prod.join(total, prod["__factory"] == total["_tf"], "left")
             .join(failed, (prod["__factory"] == failed["_ff"])
                   & (F.to_date(prod["Start_Time"]) == failed["_fd"]), "left"))
    tot = F.coalesce(F.col("_tot"), F.lit(0))
    up = F.when(tot > 0, 1.0 - safe_div(F.coalesce(F.col("_failed"), F.lit(0)), tot)).otherwise(F.lit(1.0))
    base = (F.col("Quantity_Planned") * F.lit(yield_factor) * up).cast("int")
    out = F.when(F.col("Shift") == "Night", (base * F.lit(night_factor)).cast("int")).otherwise(base)
    return j.select("Production_Order", F.col("__factory").alias("Factory"), "Shift", "Quantity_Planned",
                    up.alias("Uptime_Factor"), out.alias("Expected_Output"))


def expected_scrap(prod: DataFrame, employees: DataFrame, failed_days: DataFrame,
                   base_rate: float = 0.03) -> DataFrame:
    """Scrap rate x1.2 for role 'Operator', x1.5 when the factory had a failure
    that day; scrap = int(produced x rate) (X4). The failed days are stored
    first, for their size (see ``expected_output``)."""
    ops = employees.select(F.col("Employee").alias("_op"), F.col("Role").alias("Operator_Role"))
    fd = failed_days.select(F.col("Factory").alias("_ff"), F.col("Date").alias("_fd")).distinct()
    fd = store(fd, "failed-days")
    j = (prod.join(ops, prod["Operator"] == ops["_op"], "left")
             .join(fd, (prod["__factory"] == fd["_ff"]) & (F.to_date(prod["Start_Time"]) == fd["_fd"]), "left"))
    rate = (F.lit(base_rate)
            * F.when(F.col("Operator_Role") == "Operator", 1.2).otherwise(1.0)
            * F.when(F.col("_ff").isNotNull(), 1.5).otherwise(1.0))
    return j.select("Production_Order", "Operator_Role", rate.alias("Scrap_Rate"),
                    (F.col("Quantity_Produced") * rate).cast("int").alias("Expected_Scrap"))


# ----------------------------------------------------------------------- X5


def inspection_coverage(prod: DataFrame, quality: DataFrame, sample_share: float = 0.1) -> DataFrame:
    """Inspections against the required sample, per product and day.

    Units = produced + scrap; required = max(1, int(0.1 x units)) where there
    are units. Days with inspections but no production stay, with nothing
    required.
    """
    need = (prod.groupBy("Product", F.to_date("Start_Time").alias("Date"))
            .agg(F.sum(F.col("Quantity_Produced") + F.col("Scrap")).alias("Units")))
    seen = quality.groupBy("Product", "Date").agg(
        F.count(F.lit(1)).alias("Inspected"), F.sum("Fail").alias("Failed"))
    j = need.join(seen, ["Product", "Date"], "full_outer")
    units = F.coalesce("Units", F.lit(0))
    required = F.when(units > 0, F.greatest(F.lit(1), (units * F.lit(sample_share)).cast("bigint"))).otherwise(F.lit(0))
    inspected = F.coalesce("Inspected", F.lit(0))
    return j.select("Product", "Date", units.alias("Units"), required.cast("bigint").alias("Required"),
                    inspected.alias("Inspected"), F.coalesce("Failed", F.lit(0)).alias("Failed"),
                    F.greatest(F.lit(0), required - inspected).cast("bigint").alias("Missing"))


# ----------------------------------------------------------------------- X6


def shipments_against_shortage(prod: DataFrame, shipments: DataFrame, shortage_days: DataFrame) -> DataFrame:
    """Each order with output beside its shipment and its day's shortage.

    An order without a shipment stays, with NULLs. A delay is explained by the
    shortage when a part was short on the production day.
    """
    p = prod.where(F.col("Quantity_Produced") > 0).select(
        "Production_Order", "Product", F.col("Quantity_Produced").alias("Quantity"),
        F.to_date("Start_Time").alias("Production_Date"))
    s = shipments.select("Production_Order", "Shipment_ID", "Dispatch_Date", "Expected_Delivery_Date", "Delayed", "Delay_Reason")
    sd = shortage_days.select(F.col("Date").alias("Production_Date"), "Any_Shortage")
    j = p.join(s, "Production_Order", "left").join(sd, "Production_Date", "left")
    short = F.coalesce("Any_Shortage", F.lit(False))
    return j.select("Production_Order", "Product", "Quantity", "Production_Date", "Shipment_ID", "Dispatch_Date",
                    F.datediff("Expected_Delivery_Date", "Dispatch_Date").alias("Promised_Days"), "Delayed", "Delay_Reason",
                    short.alias("Shortage_Day"), (F.col("Delayed") & short).alias("Delay_Explained"))


# ----------------------------------------------------------------------- X7


def repair_cost(maint: DataFrame, hours_col: str, parts_col: str, factor: float = 1.3,
                labour_rate: float = 150.0) -> DataFrame:
    """cost = hours x 150 + parts; downtime = hours x factor (1 dp)."""
    h = F.col(hours_col)
    return maint.select(
        "Date", "Machine", h.alias("Repair_Hours"),
        half_up(h * F.lit(labour_rate) + F.col(parts_col), 2).alias("Repair_Cost"),
        half_up(h * F.lit(factor), 1).alias("Expected_Downtime"))


# ----------------------------------------------------------------------- X8


def shift_windows(days: DataFrame, date_col: str = "Date") -> DataFrame:
    """Three shifts per day with start and end (+8 h; night ends next day).

    The shift table is a literal array inlined per day -- no join.
    """
    table = F.array(*[F.struct(F.lit(n).alias("Shift"), F.lit(h).alias("Start_Hour"),
                               F.lit(e).alias("Efficiency_Multiplier"), F.lit(s).alias("Staffing_Percent"))
                      for n, h, e, s in SHIFTS])
    d = days.select(F.col(date_col).alias("Date")).select("Date", F.inline(table))
    start = F.timestamp_add("HOUR", F.col("Start_Hour"), F.col("Date").cast("timestamp_ntz"))
    return d.select("Date", "Shift", start.alias("Shift_Start"),
                    F.timestamp_add("HOUR", F.lit(SHIFT_HOURS), start).alias("Shift_End"),
                    "Efficiency_Multiplier", "Staffing_Percent")


def shift_of(ts: Column | str) -> Column:
    """Shift name of a timestamp (E4): Morning [6,14), Evening [14,22), else Night."""
    h = F.hour(ts)
    return F.when((h >= 6) & (h < 14), "Morning").when((h >= 14) & (h < 22), "Evening").otherwise("Night")


def shift_multiplier(shift: Column | str) -> Column:
    s = F.col(shift) if isinstance(shift, str) else shift
    out = F.lit(None).cast("double")
    for n, _, e, _ in SHIFTS:
        out = F.when(s == n, F.lit(e)).otherwise(out)
    return out


# ----------------------------------------------------------------------- X9


def telemetry_gaps(readings: DataFrame, key: str, ts_col: str, step_minutes: int = 60) -> DataFrame:
    """Expected slots (key x day x step) that have no reading.

    The grid runs from the feed's first day to its last, for every key that
    ever reported, so a day on which a machine was silent is a gap as well. It
    is generated per key-day with ``sequence`` and anti-joined to the occupied
    slots.
    """
    ts = F.col(ts_col)
    day = F.to_date(ts).cast("timestamp_ntz")
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    slot = F.timestamp_add("MINUTE", F.floor(minute_of_day / step_minutes).cast("int") * step_minutes, day)
    occupied = readings.where(ts.isNotNull()).select(F.col(key), slot.alias("Slot_Start")).distinct()
    keys = readings.select(F.col(key)).distinct()
    first, last = (readings.agg(f(F.to_date(ts))).scalar() for f in (F.min, F.max))
    days = keys.select(key, F.explode(F.sequence(first, last)).alias("_day"))
    grid = days.select(
        key, F.explode(F.sequence(
            F.col("_day").cast("timestamp_ntz"),
            F.timestamp_add("MINUTE", F.lit(24 * 60 - step_minutes), F.col("_day").cast("timestamp_ntz")),
            F.expr(f"INTERVAL {step_minutes} MINUTES"))).alias("Slot_Start"))
    return grid.join(occupied, [key, "Slot_Start"], "left_anti")


def telemetry_gap_runs(readings: DataFrame, key: str, ts_col: str, step_minutes: int = 60) -> DataFrame:
    """(key, From_Slot, To_Slot, Slots): the runs of neighbouring slots without a reading.

    The slots of ``telemetry_gaps`` as intervals, without making a grid: a key's
    occupied slots are merged into bitmaps of 48 slots (an OR, combined before
    the shuffle, whatever the number of readings), and the runs between
    neighbouring occupied slots are read off them, with one look at the bitmap
    before. Work follows the readings: a silent year, or one stray date far off,
    is one row. A key whose readings have no time is one gap over the feed's days.
    """
    if 24 * 60 % step_minutes:
        raise ValueError("a day must hold a whole number of slots")
    per_day, word = 24 * 60 // step_minutes, 48
    ts = F.col(ts_col)
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    slot = day.cast("long") * per_day + F.floor((F.hour(ts) * 60 + F.minute(ts)) / step_minutes)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(word)).cast("int"))
    words = readings.groupBy(F.col(key), F.floor(slot / word).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    places = F.filter(F.sequence(F.lit(0), F.lit(word - 1)), lambda i: F.getbit("_bits", i) == 1)
    occupied = words.withColumn("_slots", F.transform(places, lambda i: F.col("_word") * word + i))
    floor_day = lambda x: F.floor(x / per_day) * per_day  # noqa: E731 - first slot of the slot's day
    first = occupied.agg(floor_day(F.min(F.array_min("_slots")))).scalar()
    last = occupied.agg(floor_day(F.max(F.array_max("_slots"))) + per_day - 1).scalar()
    w = Window.partitionBy(key).orderBy(F.col("_word").asc_nulls_first())
    before = F.coalesce(F.lag(F.array_max("_slots")).over(w), first - 1)
    ends = F.when(F.lead("_word").over(w).isNull(), F.array(last + 1)).otherwise(F.array().cast("array<bigint>"))
    marks = occupied.select(key, F.concat(F.array(before), F.coalesce("_slots", F.array().cast("array<bigint>")), ends).alias("_marks"))
    pairs = marks.select(key, F.explode(F.arrays_zip(F.expr("slice(_marks, 1, size(_marks) - 1)").alias("a"),
                                                     F.expr("slice(_marks, 2, size(_marks) - 1)").alias("b"))).alias("_p"))
    gaps = pairs.where(F.col("_p.b") - F.col("_p.a") > 1)

    def time(n):
        return F.timestamp_add("MINUTE", n * step_minutes,
                               F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return gaps.select(key, time(F.col("_p.a") + 1).alias("From_Slot"), time(F.col("_p.b") - 1).alias("To_Slot"),
                       (F.col("_p.b") - F.col("_p.a") - 1).alias("Slots"))


# ---------------------------------------------------------------------- X10


def causal_chain(prod: DataFrame, maintenance: DataFrame, dim_machine: DataFrame, quality: DataFrame,
                 dim_employee: DataFrame, shipments: DataFrame, shortage_days: DataFrame) -> DataFrame:
    """Failures -> output -> inspections -> shortage -> delays per factory and day.

    Every factory-day of any source is a row. Inspections belong to the
    inspector's factory, shipments to the factory of their order's production;
    what has no factory is counted under 'Unassigned', so sums over factories
    are totals. The shortage is a fact of the day, not of a factory.
    """
    none = F.lit("Unassigned")
    pr = (prod.groupBy(F.coalesce(F.col("__factory"), none).alias("Factory"), F.to_date("Start_Time").alias("Date"))
          .agg(F.sum("Quantity_Produced").alias("Produced"), F.sum("Scrap").alias("Scrap")))
    machines = dim_machine.select("Machine", "Factory")
    fl = (maintenance.join(machines, "Machine", "left").groupBy(F.coalesce("Factory", none).alias("Factory"), "Date")
          .agg(F.count(F.lit(1)).alias("Failures"), F.sum("Downtime").alias("Downtime_Hours")))
    staff = dim_employee.select(F.col("Employee").alias("Inspector"), "Factory")
    qf = (quality.join(staff, "Inspector", "left").groupBy(F.coalesce("Factory", none).alias("Factory"), "Date")
          .agg(F.sum("Fail").alias("Inspection_Fails")))
    made = prod.select("Production_Order", F.col("__factory").alias("Factory"))
    dl = (shipments.where("Delayed").join(made, "Production_Order", "left")
          .groupBy(F.coalesce("Factory", none).alias("Factory"), F.col("Dispatch_Date").alias("Date"))
          .agg(F.count(F.lit(1)).alias("Delayed_Shipments")))
    values = ["Failures", "Downtime_Hours", "Produced", "Scrap", "Inspection_Fails", "Delayed_Shipments"]

    def padded(df: DataFrame) -> DataFrame:
        return df.select("Factory", "Date", *[F.col(v) if v in df.columns else F.lit(None).cast("double" if v == "Downtime_Hours" else "bigint").alias(v)
                                              for v in values])

    rows = padded(pr).unionByName(padded(fl)).unionByName(padded(qf)).unionByName(padded(dl))
    days = rows.groupBy("Factory", "Date").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    short = shortage_days.select("Date", "Any_Shortage")
    return days.join(short, "Date", "left").select(
        "Factory", "Date", *values, F.coalesce("Any_Shortage", F.lit(False)).alias("Any_Shortage"))


# ---------------------------------------------------------------------- E1


def factory_maintenance_cost(silver_maint: DataFrame, dim_machine: DataFrame) -> DataFrame:
    """Per factory and month: failures, downtime hours, maintenance cost."""
    m = dim_machine.select(F.col("Machine").alias("Machine_ID"), "Factory")
    j = silver_maint.join(m, "Machine_ID", "left")
    return (j.groupBy("Factory", F.trunc("Maintenance_Date", "month").alias("Month"))
             .agg(F.count(F.lit(1)).alias("Failures"),
                  F.sum("Downtime_Hours").alias("Downtime_Hours"),
                  half_up(F.sum("Maintenance_Cost_USD"), 2).alias("Maintenance_Cost_USD")))


def factory_efficiency(prod: DataFrame) -> DataFrame:
    """Per factory and month: planned, produced, good units and yield ratios.

    Rolls up the production rows themselves (each carries its factory), so no
    join back by order id is needed -- order ids are not guaranteed unique.
    """
    g = (prod.groupBy(F.col("__factory").alias("Factory"),
                      F.trunc(F.to_date("Start_Time"), "month").alias("Month"))
         .agg(F.sum("Quantity_Planned").alias("Planned"), F.sum("Quantity_Produced").alias("Produced"),
              F.sum(F.col("Quantity_Produced") - F.col("Scrap")).alias("Good")))
    return g.select("Factory", "Month", "Planned", "Produced", "Good",
                    half_up(safe_div("Produced", "Planned"), 4).alias("Output_Ratio"),
                    half_up(safe_div("Good", "Produced"), 4).alias("Good_Ratio"))


# ---------------------------------------------------------------------- E2


def rolling_sensor_averages(silver_sensor: DataFrame, days: int = 7) -> DataFrame:
    """Trailing ``days``-day averages of the readings per machine.

    Daily sums and counts are aggregated first (one row per machine-day); a
    range frame over the day number then adds them up, so the average is the
    exact mean of all readings in the window and the window partition is
    bounded by the calendar, not by the row count.
    """
    d = (silver_sensor.groupBy("Machine_ID", "Event_Date")
         .agg(*[f(c).alias(f"_{n}{c}") for c in ("Temp_Celsius", "Vibration_Hz", "Power_kW")
                for n, f in (("s", F.sum), ("c", F.count))]))
    w = (Window.partitionBy("Machine_ID").orderBy(F.unix_date("Event_Date"))
         .rangeBetween(-(days - 1), 0))

    def avg(c):
        return safe_div(F.sum(f"_s{c}").over(w).cast("double"), F.sum(f"_c{c}").over(w))

    return d.select("Machine_ID", "Event_Date",
                    avg("Temp_Celsius").alias("Rolling_Avg_Temp"),
                    avg("Vibration_Hz").alias("Rolling_Avg_Vibration"),
                    avg("Power_kW").alias("Rolling_Avg_Power"),
                    F.count(F.lit(1)).over(w).alias("Days_In_Window"))


# ---------------------------------------------------------------------- E3


def bom_explosion(produced: DataFrame, bom: DataFrame) -> DataFrame:
    """Part demand = produced units x BOM quantity, summed per part and day.

    ``produced``: (Product, Date, Units); ``bom``: (Product, bom map<part, qty>).
    The joined rows are dealt by part and day before they are summed: a sum on
    each side of the shuffle would hold the groups of all rows of a join task,
    beside what the join itself holds, and few of them meet there.
    """
    b = bom.select("Product", F.explode("bom").alias("Part", "Qty_Per_Unit"))
    j = produced.join(b, "Product", "inner").select("Part", "Date", "Units", "Qty_Per_Unit")
    return (j.repartition("Part", "Date").groupBy("Part", "Date")
             .agg(F.sum(F.col("Units").cast("long") * F.col("Qty_Per_Unit")).alias("Part_Demand")))
