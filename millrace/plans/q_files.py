"""Registered queries: the file layer.

Each query writes files derived from the driver's tables into the shared
folder and reads them back through the sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import rules as R
from millrace.plans.q_relations import _load
from millrace.plans.q_rules import _baselines, _rules
from millrace.plans.q_timeseries import INVENTORY_CTE
from millrace.plans.registry import register
from millrace.schemas import FILE_ROUTES, SCHEMAS
from millrace.session import checkpoint_dir
from millrace.sources import files as S

_COLUMNS = ["Timestamp", "Factory", "Machine", "Temperature", "Vibration", "RPM", "Running Status", "Error Code"]
_CSV = {"header": True, "compression": "gzip"}  # the sources read it as they read plain text


def _folder(m) -> str:
    return f"{checkpoint_dir(m.spark).rstrip('/')}/files-{uuid.uuid4().hex[:12]}"


def _sensor_csv(m, folder: str) -> str:
    """The sensor feed as CSV with display headers; every reading of code E101 above 60 is not a number."""
    s = m.bronze.fact_sensor
    bad = (F.col("Error_Code") == "E101") & (F.col("Temperature") > 60)
    text = F.when(bad, F.lit("n/a")).otherwise(F.col("Temperature").cast("string"))
    named = {"Timestamp": F.col("Timestamp").cast("string"), "Temperature": text,
             "Running Status": F.col("Running_Status"), "Error Code": F.col("Error_Code")}
    path = f"{folder}/fact_sensor.csv"
    s.select(*[named.get(c, F.col(c)).alias(c) for c in _COLUMNS]).write.options(**_CSV).csv(path)
    return path


_BAD = "Error_Code = 'E101' AND Temperature > 60"


@register("csv_reload", f"""
SELECT "Timestamp", Factory, Machine, Temperature, Vibration, RPM, Running_Status, Error_Code
FROM fact_sensor WHERE NOT ({_BAD})""", "S1 S3 S6: good lines of a CSV with display headers, by name")
def _csv_reload(m):
    good, _ = S.csv_scan_tolerant(m.spark, _sensor_csv(m, _folder(m)), "fact_sensor")
    return good.select("Timestamp", "Factory", "Machine", "Temperature", "Vibration", "RPM", "Running_Status", "Error_Code")


@register("csv_quarantine", f"""
SELECT 'bad Temperature' AS Reason, count(*) AS Lines FROM fact_sensor WHERE {_BAD} HAVING count(*) > 0""", "S3")
def _csv_quarantine(m):
    _, bad = S.csv_scan_tolerant(m.spark, _sensor_csv(m, _folder(m)), "fact_sensor")
    return bad.groupBy(F.col("reason").alias("Reason")).agg(F.count(F.lit(1)).alias("Lines"))


_ROUTED = list(FILE_ROUTES.values())


def _bulk_sql() -> str:
    """Rows loaded and skipped, and the cells with a value, of every routed table."""
    def one(t: str) -> str:
        bad = _BAD if t == "fact_sensor" else "false"
        columns = [c.replace(" ", "_") for c in _COLUMNS] if t == "fact_sensor" else [f.name for f in SCHEMAS[t].fields]
        cells = " + ".join(f'count("{c}")' for c in columns)
        return (f"SELECT '{t}' AS Table_Name, (SELECT count(*) FROM {t} WHERE NOT ({bad})) AS Loaded, "
                f"(SELECT count(*) FROM {t} WHERE {bad}) AS Skipped, (SELECT {cells} FROM {t} WHERE NOT ({bad})) AS Filled")
    return INVENTORY_CTE + "\n" + "\nUNION ALL ".join(one(t) for t in _ROUTED)


@register("csv_bulk_load", _bulk_sql(), "S4 S5: all sixteen files routed by name, bad lines skipped and reported")
def _bulk(m):
    folder = _folder(m)
    load = _load(m)
    _sensor_csv(m, folder)
    for name, table in FILE_ROUTES.items():
        if table != "fact_sensor":
            df = load(table)
            df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.options(**_CSV).csv(f"{folder}/{name}")
    S.bulk_load(m.spark, folder, f"{folder}/bronze")
    out: DataFrame | None = None
    for table in _ROUTED:
        good = m.spark.read.parquet(f"{folder}/bronze/{table}")
        bad = m.spark.read.parquet(f"{folder}/bronze/_quarantine/{table}").agg(F.count(F.lit(1)).alias("Skipped"))
        filled = sum((F.count(c) for c in good.columns), F.lit(0))
        counts = good.agg(F.count(F.lit(1)).alias("Loaded"), filled.cast("long").alias("Filled"))
        row = counts.select(F.lit(table).alias("Table_Name"), "Loaded", bad.scalar().alias("Skipped"), "Filled")
        out = row if out is None else out.unionByName(row)
    return out


@register("csv_preview", """
SELECT Machine, "Timestamp", Temperature FROM fact_sensor
ORDER BY "Timestamp", Machine, Temperature LIMIT 5""", "S2: the first lines of a preview")
def _preview(m):
    path = f"{_folder(m)}/fact_sensor.csv"
    text = [F.col(c).cast("string").alias(c) for c in ("Machine", "Timestamp", "Temperature")]
    m.bronze.fact_sensor.select(*text).write.option("header", True).csv(path)
    df = S.csv_scan(m.spark, path, "fact_sensor").select("Machine", "Timestamp", "Temperature")
    return S.csv_preview(df, 5, ["Timestamp", "Machine", "Temperature"])


@register("rules_file", "SELECT machine, sensor, \"min\", \"max\" FROM maint_rules", "S8: written as JSON lines, read back")
def _rules_file(m):
    path = f"{_folder(m)}/rules.jsonl"
    _rules(m).select(F.to_json(F.struct("machine", "sensor", "min", "max"))).write.text(path)
    return R.read_rules_lines(m.spark, path)[0]


@register("baselines_file", "SELECT machine, sensor, value FROM machine_baselines", "S9: written as JSON lines, read back")
def _baselines_file(m):
    path = f"{_folder(m)}/baselines.jsonl"
    per = _baselines(m).groupBy("machine").agg(  # a machine has at most its ten sensors
        F.map_from_entries(F.collect_list(F.struct("sensor", F.col("value").cast("string")))).alias("v"))
    per.select(F.to_json(F.map_from_arrays(F.array("machine"), F.array("v")))).write.text(path)
    return R.read_baselines_lines(m.spark, path)
