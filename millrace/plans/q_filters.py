"""Registered queries: filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import filters as P
from millrace.plans.registry import register


@register("warning_rows", """
SELECT "Timestamp", Machine, Mode, Temperature, Vibration, Running_Status, Error_Code
FROM fact_sensor WHERE Running_Status = 'Warning'""", "P9 P13")
def _warnings(m):
    return P.display_columns(P.status_rows(m.bronze.fact_sensor),
                             ["Timestamp", "Machine", *P.DISPLAY_COLUMNS[1:]])


@register("factory_machine_listing", "SELECT Factory, Production_Line, Machine FROM dim_machine", "P8")
def _listing(m):
    return P.factory_machines(m.bronze.dim_machine)


@register("operators_per_factory", """
SELECT Factory, Role, count(*) AS Staff FROM dim_employee
WHERE Role IN ('Operator', 'Senior Operator') GROUP BY Factory, Role""", "P10")
def _operators(m):
    return (P.staff_with_roles(m.bronze.dim_employee)
            .groupBy("Factory", "Role").agg(F.count(F.lit(1)).alias("Staff")))


@register("raw_material_warehouses", """
SELECT Warehouse, Factory FROM dim_warehouse WHERE Type = 'Raw Material'""", "P12")
def _warehouses(m):
    return P.warehouses_of_type(m.bronze.dim_warehouse).select("Warehouse", "Factory")


@register("orders_with_output", """
SELECT Production_Order, Product, Quantity_Produced, Scrap FROM fact_erp_production
WHERE Quantity_Produced + Scrap > 0""", "P11")
def _with_output(m):
    return P.positive_output(m.bronze.fact_erp_production, include_scrap=True).select(
        "Production_Order", "Product", "Quantity_Produced", "Scrap")
