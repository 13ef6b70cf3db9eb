"""Bronze domain tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables plus an ``events`` stream; every bronze
table of the factory star schema is a projection / join of those, so that all
work grows with the input. The same rules are written as SQL in
``millrace.plans.oracle`` for the DuckDB check; keep the two in step.

All rules are plain column expressions (no Python per row). Foreign keys that
point at small tables are equi-joins left to the planner: Spark broadcasts a
side only when its estimated size is under ``autoBroadcastJoinThreshold``, and
AQE switches to a broadcast at runtime when a shuffled side turns out small.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.schemas import SCHEMAS

# Fixed values used by the adapter rules.
DAY_SHIFT = 9125          # days subtracted from event time so sensor dates meet production dates
SHIFT_BY_FLAG = {"A": ("Morning", 6), "N": ("Evening", 14), "R": ("Night", 22)}
ROLE_BY_MOD = ["Operator", "Senior Operator", "Technician", "Inspector"]
DEPT_BY_ROLE = {"Operator": "Production", "Senior Operator": "Production",
                "Technician": "Maintenance", "Inspector": "Quality"}
OPENING_STOCK_BASE = 50   # opening stock = 50 + partkey % 100
REFILL_QTY = 60           # replenishment added when a part ends a day below safety stock


def _s(c) -> Column:
    return c.cast("string")


def factory_of(user_id: Column) -> Column:
    return F.concat(F.lit("Plant "), _s(user_id % 4))


def formatted(pattern: str, c: Column) -> Column:
    """format_string that keeps NULL as NULL (as SQL printf does)."""
    return F.when(c.isNotNull(), F.format_string(pattern, c))


def machine_of(user_id: Column) -> Column:
    return formatted("M-%05d", user_id)


def order_of() -> Column:
    """Order, line, part and supplier: the first two alone are not unique in the driver's table."""
    return F.concat_ws("-", F.lit("ORD"), *[_s(F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def line_of(user_id: Column) -> Column:
    return F.concat(F.lit("Line "), _s(user_id % 5 + 1), F.lit(" - "), factory_of(user_id))


def event_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the registry schema by name; absent columns -> typed NULL."""
    have = set(df.columns)
    cols = []
    for f in SCHEMAS[table].fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


class DriverTables:
    """Lazy access to the bronze tables for one driver data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """The driver table as a DataFrame (built once: file listing and footers
        are read once per table, not once per query)."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # ---------------------------------------------------------------- facts
    @cached_property
    def fact_sensor(self) -> DataFrame:
        e = self.raw("events")
        uid = F.col("user_id")
        err = F.col("event_type") == "error"
        df = e.select(
            F.timestamp_add("DAY", F.lit(-DAY_SHIFT), F.col("ts")).alias("Timestamp"),
            factory_of(uid).alias("Factory"),
            line_of(uid).alias("Production_Line"),
            machine_of(uid).alias("Machine"),
            F.col("value").alias("Temperature"),
            (F.col("value") + 0.001).alias("Vibration"),
            (400 - F.col("event_id") % 9).cast("double").alias("Voltage"),
            (F.col("value") * 3 * 1000.0 / ((400 - F.col("event_id") % 9) * 1.732)).alias("Current"),
            (F.col("value") * 3).alias("Power_Consumption"),
            (95 + F.col("event_id") % 11).cast("double").alias("Pressure"),
            F.when(F.col("event_id") % 17 != 0, (90 + F.col("event_id") % 10).cast("double")).alias("Oil_Level"),
            (40 + F.col("event_id") % 13).cast("double").alias("Humidity"),
            (60 + (F.col("event_id") % 50) / 10.0).alias("Noise"),
            (event_k(F.col("props")) * 60).cast("double").alias("RPM"),
            F.when(err, "Warning").otherwise("Running").alias("Running_Status"),
            F.when(err, "E101").otherwise("None").alias("Error_Code"),
            F.when(err, "Custom Disturbance").otherwise("Ideal").alias("Mode"),
        )
        return conform(df, "fact_sensor")

    @cached_property
    def fact_maintenance(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        uid = F.col("user_id")
        downtime = (F.col("event_id") % 25).cast("double")
        df = e.select(
            F.to_date(F.timestamp_add("DAY", F.lit(-DAY_SHIFT), F.col("ts"))).alias("Date"),
            machine_of(uid).alias("Machine"),
            F.concat(F.lit("F"), _s(event_k(F.col("props")) % 8)).alias("Failure"),
            F.when(F.col("value") > 100, "Critical").otherwise("High").alias("Severity"),
            F.concat(F.lit("RC"), _s(F.col("event_id") % 5)).alias("Root_Cause"),
            F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("T"), _s(uid % 10)))
             .otherwise(formatted("Supplier#%09d", uid % 20)).alias("Technician"),
            downtime.alias("Downtime"),
            (downtime * 150 + F.col("value")).alias("Cost"),
        )
        return conform(df, "fact_maintenance")

    @cached_property
    def fact_erp_production(self) -> DataFrame:
        li = self.raw("lineitem")
        q = F.col("l_quantity").cast("int")
        flag = F.col("l_returnflag")
        shift, hour = F.lit(None).cast("string"), F.lit(None).cast("int")
        for f, (name, start) in SHIFT_BY_FLAG.items():
            shift = F.when(flag == f, F.lit(name)).otherwise(shift)
            hour = F.when(flag == f, F.lit(start)).otherwise(hour)
        start = F.timestamp_add("HOUR", hour, F.col("l_shipdate"))
        df = li.select(
            order_of().alias("Production_Order"),
            F.concat(F.lit("P-"), _s(F.col("l_partkey"))).alias("Product"),
            F.greatest(F.lit(0), q + F.col("l_linenumber") - 3).alias("Quantity_Planned"),
            q.alias("Quantity_Produced"),
            F.least(q, (F.col("l_partkey") % 4).cast("int")).alias("Scrap"),
            formatted("Supplier#%09d", F.col("l_suppkey")).alias("Operator"),
            shift.alias("Shift"),
            start.alias("Start_Time"),
            F.timestamp_add("HOUR", F.lit(8), start).alias("End_Time"),
            factory_of(F.col("l_suppkey")).alias("__factory"),
        )
        return conform(df, "fact_erp_production")

    @cached_property
    def fact_quality(self) -> DataFrame:
        lb = self.raw("labels")
        insp = F.concat(F.lit("INSP-"), _s(F.col("doc_id")))
        df = lb.select(
            insp.alias("Inspection_ID"),
            F.date_add(F.lit("2024-01-01").cast("date"),
                       (F.col("doc_id") % 30).cast("int") - DAY_SHIFT).alias("Date"),
            F.concat(F.lit("P-"), _s(F.col("doc_id") % 200)).alias("Product"),
            insp.alias("Inspection"),
            F.when(F.col("toxic") == 1, "Surface Scratch").otherwise("None").alias("Defect_Type"),
            F.col("quality").alias("Pass"),
            (1 - F.col("quality")).alias("Fail"),
            F.when(F.col("doc_id") % 7 != 0, formatted("Supplier#%09d", F.col("doc_id") % 24)).alias("Inspector"),
        )
        return conform(df, "fact_quality")

    @cached_property
    def fact_shipments(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        od = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        cu = self.raw("customer").select("c_custkey", "c_name")
        order_id = order_of()
        delayed = (F.col("l_partkey") % 14) > 5
        df = (li.join(od, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
                .join(cu, F.col("o_custkey") == F.col("c_custkey"), "left")
                .select(
                    order_id.alias("Shipment_ID"),
                    order_id.alias("Production_Order"),
                    F.col("c_name").alias("Customer"),
                    F.concat(F.lit("P-"), _s(F.col("l_partkey"))).alias("Product"),
                    F.col("l_quantity").cast("int").alias("Quantity"),
                    F.to_date("o_orderdate").alias("Dispatch_Date"),
                    F.date_add(F.to_date("o_orderdate"),
                               (1 + F.col("l_partkey") % 14).cast("int")).alias("Expected_Delivery_Date"),
                    delayed.alias("Delayed"),
                    F.when(delayed, "Inventory Shortage").otherwise("None").alias("Delay_Reason"),
                ))
        return conform(df, "fact_shipments")

    @cached_property
    def part_day_demand(self) -> DataFrame:
        """Stock-ledger input: one row per (part, day) with the day's need (produced and scrapped units).

        Pre-aggregated from lineitem, so the ordered fold later sees at most one
        row per calendar day per part, however many order lines there are.
        """
        li = self.raw("lineitem")
        return (li.groupBy("l_partkey", F.to_date("l_shipdate").alias("Date"))
                  .agg(F.sum(F.col("l_quantity").cast("int")
                             + F.least(F.col("l_quantity").cast("int"), (F.col("l_partkey") % 4).cast("int"))).alias("Need"))
                  .select(F.concat(F.lit("P-"), _s(F.col("l_partkey"))).alias("Product"),
                          F.col("l_partkey").alias("Part_Key"), "Date",
                          F.col("Need").cast("long").alias("Need")))

    # ----------------------------------------------------------- dimensions
    @cached_property
    def dim_machine(self) -> DataFrame:
        uid = F.col("user_id")
        df = (self.raw("events").select("user_id").distinct().select(
            machine_of(uid).alias("Machine"),
            line_of(uid).alias("Production_Line"),
            factory_of(uid).alias("Factory"),
            (40 + uid % 40).cast("double").alias("normal_temp"),
            (500 * (uid % 3)).cast("double").alias("max_rpm"),
            (9 + uid % 37).cast("double").alias("power_kw"),
            F.lit(0.5).alias("vibration_base"),
            (0.95 + (uid % 5) / 100.0).alias("reliability"),
        ))
        return conform(df, "dim_machine")

    @cached_property
    def dim_production_line(self) -> DataFrame:
        return conform(self.dim_machine.select("Production_Line", "Factory").distinct(),
                       "dim_production_line")

    @cached_property
    def dim_factory(self) -> DataFrame:
        """One factory per region; its Type is the region-key-th product type
        (in sorted order), so factory/product matching has real pairs."""
        r = self.raw("region")
        types = (self.raw("part").select("p_type").distinct()
                 .withColumn("_idx", F.row_number().over(Window.orderBy("p_type")) - 1))
        df = r.join(types, F.col("r_regionkey") == F.col("_idx"), "left").select(
            F.concat(F.lit("Plant "), _s(F.col("r_regionkey"))).alias("Factory"),
            F.col("p_type").alias("Type"), F.col("r_name").alias("Location"))
        return conform(df, "dim_factory")

    @cached_property
    def dim_product(self) -> DataFrame:
        p = self.raw("part")
        return conform(p.select(F.concat(F.lit("P-"), _s(F.col("p_partkey"))).alias("Product"),
                                F.col("p_type").alias("Factory_Type")), "dim_product")

    @cached_property
    def dim_employee(self) -> DataFrame:
        s = self.raw("supplier")
        m = F.col("s_suppkey") % len(ROLE_BY_MOD)
        role, dept = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i, r in enumerate(ROLE_BY_MOD):
            role = F.when(m == i, F.lit(r)).otherwise(role)
            dept = F.when(m == i, F.lit(DEPT_BY_ROLE[r])).otherwise(dept)
        return conform(s.select(F.col("s_name").alias("Employee"), dept.alias("Department"),
                                role.alias("Role"),
                                F.concat(F.lit("Plant "), _s(F.col("s_suppkey") % 5)).alias("Factory")),
                       "dim_employee")

    @cached_property
    def dim_supplier(self) -> DataFrame:
        s = self.raw("supplier")
        return conform(s.select(F.col("s_name").alias("Supplier"),
                                (3 + F.col("s_suppkey") % 12).alias("Delivery_Time"),
                                (85 + F.col("s_suppkey") % 15).alias("Quality_Score")),
                       "dim_supplier")

    @cached_property
    def dim_customer(self) -> DataFrame:
        c = self.raw("customer")
        return conform(c.select(F.col("c_name").alias("Customer"),
                                F.col("c_mktsegment").alias("Type")), "dim_customer")

    @cached_property
    def dim_warehouse(self) -> DataFrame:
        n = self.raw("nation")
        return conform(n.select(
            formatted("WH-%02d", F.col("n_nationkey")).alias("Warehouse"),
            F.concat(F.lit("Plant "), _s(F.col("n_regionkey"))).alias("Factory"),
            F.when(F.col("n_nationkey") % 2 == 0, "Raw Material").otherwise("Finished Goods").alias("Type"),
        ), "dim_warehouse")

    @cached_property
    def dim_part(self) -> DataFrame:
        p = self.raw("part")
        s = self.raw("supplier").select("s_suppkey", "s_name")
        n_sup = s.select(F.count(F.lit(1))).first()[0]
        df = (p.join(s, (F.col("p_partkey") % n_sup) == F.col("s_suppkey"), "left")
               .select(F.concat(F.col("p_name"), F.lit("#"), _s(F.col("p_partkey"))).alias("Part"),
                       F.col("s_name").alias("Supplier"),
                       F.col("p_retailprice").alias("Cost"),
                       (5 + F.col("p_size")).alias("Lead_Time"),
                       (20 + F.col("p_size")).alias("Safety_Stock")))
        return conform(df, "dim_part")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
