"""Registered queries: star joins, lookups, key checks, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, quality
from millrace.operators.operations import energy_daily
from millrace.plans.oracle import FRAGMENTS, hash_unit
from millrace.plans.registry import register
from millrace.schemas import DOCUMENTED_KEYS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS

FRAGMENTS["fact_energy"] = """
SELECT Event_Date AS "Date", Machine_ID AS Machine,
       floor(CAST(sum(Power_kW) AS DOUBLE) * 1.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS Energy,
       floor(CAST(sum(Power_kW) AS DOUBLE) * 1.0::DOUBLE * 0.15::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE)
         / 100.0::DOUBLE AS Cost,
       floor(CAST(sum(Power_kW) AS DOUBLE) * 1.0::DOUBLE * 0.4::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE)
         / 100.0::DOUBLE AS Carbon_Emission,
       floor(CAST(max(Power_kW) AS DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS Peak_Usage
FROM silver_sensor GROUP BY Event_Date, Machine_ID"""

# Bronze tables with plain adapters; fact_inventory is the stock ledger's output
# and has its own star join and key check below (its oracle needs the ledger CTE).
CHECKED = [t for t in SCHEMAS if t != "fact_inventory"]
COLUMNS = {t: [f.name for f in SCHEMAS[t].fields] for t in SCHEMAS}


def _load(m):
    def load(t):
        if t == "fact_energy":
            return energy_daily(m.silver_sensor, 1.0)
        if t == "fact_inventory":
            from millrace.plans.q_timeseries import fact_inventory
            return fact_inventory(m)
        return m.bronze.table(t)
    return load


def _star(table: str, doc: str):
    register(f"star_{table}", joins.star_join_sql(table, COLUMNS), doc)(
        lambda m, _t=table: joins.star_join(_t, _load(m)))


for _t, _doc in [("fact_sensor", "J4 sensor->factory/line/machine"),
                 ("fact_erp_production", "J4 production->product/employee"),
                 ("fact_maintenance", "J4 maintenance->machine/employee"),
                 ("fact_quality", "J4 quality->product/employee"),
                 ("fact_shipments", "J4 shipments->production/customer/product"),
                 ("fact_energy", "J4 energy->machine"),
                 ("dim_machine", "J4 machine->line/factory"),
                 ("dim_production_line", "J4 line->factory"),
                 ("dim_employee", "J4 employee->factory"),
                 ("dim_warehouse", "J4 warehouse->factory"),
                 ("dim_part", "J4 part->supplier")]:
    _star(_t, _doc)


@register("factory_products", """
SELECT f.Factory, p.Product, p.Factory_Type AS Product_Type
FROM dim_factory f JOIN dim_product p ON f.Type = p.Factory_Type""", "J7")
def _factory_products(m):
    return joins.factory_products(m.bronze.dim_factory, m.bronze.dim_product)


@register("technician_assignment", f"""
WITH staff AS (SELECT Employee, Factory FROM dim_employee WHERE Role IN ('Technician')),
pools AS (SELECT Employee, Factory, Factory AS pool FROM staff UNION ALL SELECT Employee, Factory, '*' AS pool FROM staff),
numbered AS (SELECT Employee, pool, row_number() OVER (PARTITION BY pool ORDER BY Factory, Employee) - 1 AS slot
             FROM pools),
sizes AS (SELECT pool, count(*) AS k FROM pools GROUP BY pool),
mm AS (SELECT Machine, Factory, COALESCE(Factory, '*') AS pool FROM dim_machine)
SELECT mm.Machine, mm.Factory, COALESCE(n.Employee, 'Unknown') AS Assigned_Employee
FROM mm LEFT JOIN sizes s ON mm.pool = s.pool
LEFT JOIN numbered n ON n.pool = mm.pool AND n.slot = floor({hash_unit('mm.Machine')} * s.k)""", "J8")
def _technicians(m):
    return joins.staff_lookup(m.bronze.dim_machine.select("Machine", "Factory"),
                              m.bronze.dim_employee, ["Technician"])


_DOCUMENTED = [(c, pt, pc) for t, c, pt, pc in DOCUMENTED_KEYS if t == "fact_erp_production"]
register("star_production_factory", joins.star_join_sql("fact_erp_production", COLUMNS, _DOCUMENTED), "J4 production->factory")(
    lambda m: joins.star_join("fact_erp_production", _load(m), _DOCUMENTED))


@register("machine_failure_membership", """
SELECT dm.Machine, dm.Factory,
       EXISTS (SELECT 1 FROM fact_maintenance f WHERE f.Machine = dm.Machine) AS Had_Failure
FROM dim_machine dm""", "J9")
def _membership(m):
    return joins.membership(m.bronze.dim_machine.select("Machine", "Factory"),
                            m.bronze.fact_maintenance.select("Machine"), ["Machine"], "Had_Failure")


def _pk_sql() -> str:
    parts = []
    for t, pk in PRIMARY_KEYS.items():
        parts.append(f"""SELECT '{t}' AS Table_Name, CAST("{pk}" AS VARCHAR) AS Key_Value,
       count(*) AS Row_Count,
       CASE WHEN "{pk}" IS NULL THEN 'null' ELSE 'duplicate' END AS Violation
FROM {t} GROUP BY "{pk}" HAVING "{pk}" IS NULL OR count(*) > 1""")
    return "\nUNION ALL\n".join(parts)


@register("pk_violations", _pk_sql(), "Q1")
def _pk(m):
    return quality.pk_violations(_load(m))


FK_CHECKED = [fk for fk in FOREIGN_KEYS if fk[0] in CHECKED and fk[2] in CHECKED]


def _fk_sql() -> str:
    parts = []
    for child, col, parent, pcol in FK_CHECKED:
        parts.append(f"""SELECT '{child}' AS Child_Table, '{col}' AS Child_Column, '{parent}' AS Parent_Table,
       CAST(c."{col}" AS VARCHAR) AS Key_Value, count(*) AS Orphan_Rows
FROM {child} c WHERE c."{col}" IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p."{pcol}" = c."{col}")
GROUP BY c."{col}\"""")
    return "\nUNION ALL\n".join(parts)


@register("fk_orphans", _fk_sql(), "Q2")
def _fk(m):
    return quality.fk_orphans(_load(m), FK_CHECKED)


@register("machine_event_log", """
SELECT Machine, "Date", 'maintenance' AS Event_Kind, Failure AS Detail FROM fact_maintenance
UNION ALL
SELECT Machine, CAST("Timestamp" AS DATE) AS "Date", 'warning' AS Event_Kind, Error_Code AS Detail
FROM fact_sensor WHERE Running_Status = 'Warning'""", "U1")
def _union(m):
    a = m.bronze.fact_maintenance.select("Machine", "Date", F.lit("maintenance").alias("Event_Kind"),
                                         F.col("Failure").alias("Detail"))
    b = (m.bronze.fact_sensor.where(F.col("Running_Status") == "Warning")
         .select("Machine", F.to_date("Timestamp").alias("Date"), F.lit("warning").alias("Event_Kind"),
                 F.col("Error_Code").alias("Detail")))
    return a.unionByName(b)


# fact_inventory comes from the stock ledger, whose oracle is a recursive CTE;
# its star join and key checks carry that CTE.
def _inventory_sql(body: str) -> str:
    from millrace.plans.q_timeseries import INVENTORY_CTE
    return INVENTORY_CTE + "\n" + body


register("star_fact_inventory", _inventory_sql(joins.star_join_sql("fact_inventory", COLUMNS)),
         "J4 inventory->part/warehouse/supplier")(lambda m: joins.star_join("fact_inventory", _load(m)))

FK_INVENTORY = [fk for fk in FOREIGN_KEYS if fk[0] == "fact_inventory"]


def _fk_inventory_sql() -> str:
    parts = []
    for child, col, parent, pcol in FK_INVENTORY:
        parts.append(f"""SELECT '{child}' AS Child_Table, '{col}' AS Child_Column, '{parent}' AS Parent_Table,
       CAST(c."{col}" AS VARCHAR) AS Key_Value, count(*) AS Orphan_Rows
FROM {child} c WHERE c."{col}" IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p."{pcol}" = c."{col}")
GROUP BY c."{col}\"""")
    return _inventory_sql("\nUNION ALL\n".join(parts))


@register("fk_orphans_inventory", _fk_inventory_sql(), "Q2 (inventory keys)")
def _fk_inventory(m):
    return quality.fk_orphans(_load(m), FK_INVENTORY)
