"""Bronze table registry: typed schemas, primary keys, foreign keys.

The bronze DDL is the authority for column names and types (when other
documents disagree, the DDL wins). Every loader maps columns by normalised
name onto these schemas, so files with fewer/more columns still load
(absent columns become typed NULLs).
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
D = T.DoubleType()
TS = T.TimestampNTZType()
DT = T.DateType()
B = T.BooleanType()

# The ten sensor channels, in bronze column order.
SENSOR_COLUMNS = [
    "Temperature", "Vibration", "Voltage", "Current", "Power_Consumption",
    "Pressure", "RPM", "Oil_Level", "Humidity", "Noise",
]

_COLUMNS: dict[str, list[tuple[str, T.DataType]]] = {
    "dim_factory": [("Factory", S), ("Type", S), ("Location", S)],
    "dim_production_line": [("Production_Line", S), ("Factory", S)],
    "dim_machine": [
        ("Machine", S), ("Production_Line", S), ("Factory", S), ("Type", S),
        ("normal_temp", D), ("max_rpm", D), ("power_kw", D),
        ("vibration_base", D), ("reliability", D),
    ],
    "dim_product": [("Product", S), ("Factory_Type", S)],
    "dim_employee": [("Employee", S), ("Department", S), ("Role", S), ("Factory", S)],
    "dim_supplier": [("Supplier", S), ("Delivery_Time", I), ("Quality_Score", D)],
    "dim_customer": [("Customer", S), ("Type", S)],
    "dim_warehouse": [("Warehouse", S), ("Factory", S), ("Type", S)],
    "dim_part": [("Part", S), ("Supplier", S), ("Cost", D), ("Lead_Time", I),
                 ("Safety_Stock", I)],
    "fact_sensor": [("Timestamp", TS), ("Factory", S), ("Production_Line", S),
                    ("Machine", S)]
    + [(c, D) for c in SENSOR_COLUMNS]
    + [("Running_Status", S), ("Error_Code", S), ("Mode", S)],
    "fact_erp_production": [
        ("Production_Order", S), ("Product", S), ("Quantity_Planned", I),
        ("Quantity_Produced", I), ("Scrap", I), ("Operator", S), ("Shift", S),
        ("Start_Time", TS), ("End_Time", TS), ("__factory", S), ("__product_type", S),
    ],
    "fact_maintenance": [
        ("Date", DT), ("Machine", S), ("Failure", S), ("Root_Cause", S),
        ("Severity", S), ("Technician", S), ("Downtime", D), ("Repair_Time", D),
        ("Cost", D),
    ],
    "fact_quality": [
        ("Inspection_ID", S), ("Date", DT), ("Product", S), ("Inspection", S),
        ("Defect_Type", S), ("Pass", I), ("Fail", I), ("Inspector", S),
    ],
    "fact_inventory": [
        ("Date", DT), ("Part", S), ("Stock", I), ("Safety_Stock", I),
        ("Warehouse", S), ("Supplier", S), ("Cost", D), ("Lead_Time", I),
    ],
    "fact_energy": [("Date", DT), ("Machine", S), ("Energy", D), ("Cost", D),
                    ("Carbon_Emission", D), ("Peak_Usage", D)],
    "fact_shipments": [
        ("Shipment_ID", S), ("Production_Order", S), ("Customer", S), ("Product", S),
        ("Quantity", I), ("Dispatch_Date", DT), ("Expected_Delivery_Date", DT),
        ("Delayed", B), ("Delay_Reason", S),
    ],
}

SCHEMAS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c, t, True) for c, t in cols])
    for name, cols in _COLUMNS.items()
}

TABLE_NAMES = list(SCHEMAS)

# Declared primary keys (12 tables).
PRIMARY_KEYS: dict[str, str] = {
    "dim_factory": "Factory",
    "dim_production_line": "Production_Line",
    "dim_machine": "Machine",
    "dim_product": "Product",
    "dim_employee": "Employee",
    "dim_supplier": "Supplier",
    "dim_customer": "Customer",
    "dim_warehouse": "Warehouse",
    "dim_part": "Part",
    "fact_erp_production": "Production_Order",
    "fact_quality": "Inspection_ID",
    "fact_shipments": "Shipment_ID",
}

# Declared foreign keys (child table, column, parent table, column).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("dim_production_line", "Factory", "dim_factory", "Factory"),
    ("dim_machine", "Production_Line", "dim_production_line", "Production_Line"),
    ("dim_machine", "Factory", "dim_factory", "Factory"),
    ("dim_employee", "Factory", "dim_factory", "Factory"),
    ("dim_warehouse", "Factory", "dim_factory", "Factory"),
    ("dim_part", "Supplier", "dim_supplier", "Supplier"),
    ("fact_sensor", "Factory", "dim_factory", "Factory"),
    ("fact_sensor", "Production_Line", "dim_production_line", "Production_Line"),
    ("fact_sensor", "Machine", "dim_machine", "Machine"),
    ("fact_erp_production", "Product", "dim_product", "Product"),
    ("fact_erp_production", "Operator", "dim_employee", "Employee"),
    ("fact_maintenance", "Machine", "dim_machine", "Machine"),
    ("fact_maintenance", "Technician", "dim_employee", "Employee"),
    ("fact_quality", "Product", "dim_product", "Product"),
    ("fact_quality", "Inspector", "dim_employee", "Employee"),
    ("fact_inventory", "Part", "dim_part", "Part"),
    ("fact_inventory", "Warehouse", "dim_warehouse", "Warehouse"),
    ("fact_inventory", "Supplier", "dim_supplier", "Supplier"),
    ("fact_energy", "Machine", "dim_machine", "Machine"),
    ("fact_shipments", "Production_Order", "fact_erp_production", "Production_Order"),
    ("fact_shipments", "Customer", "dim_customer", "Customer"),
    ("fact_shipments", "Product", "dim_product", "Product"),
]

# Joins that the model documents without declaring a key (child table, column, parent table, column).
DOCUMENTED_KEYS: list[tuple[str, str, str, str]] = [
    ("fact_erp_production", "__factory", "dim_factory", "Factory"),
]

# File name -> bronze table routing ("live" files are excluded).
FILE_ROUTES: dict[str, str] = {
    "dim_factory.csv": "dim_factory",
    "dim_machine.csv": "dim_machine",
    "dim_product.csv": "dim_product",
    "dim_production_line.csv": "dim_production_line",
    "dim_employee.csv": "dim_employee",
    "dim_supplier.csv": "dim_supplier",
    "dim_customer.csv": "dim_customer",
    "dim_warehouse.csv": "dim_warehouse",
    "dim_part.csv": "dim_part",
    "fact_sensor.csv": "fact_sensor",
    "fact_erp_production.csv": "fact_erp_production",
    "fact_maintenance.csv": "fact_maintenance",
    "fact_quality.csv": "fact_quality",
    "fact_inventory.csv": "fact_inventory",
    "fact_energy.csv": "fact_energy",
    "fact_shipments.csv": "fact_shipments",
}


def normalize_name(name: str) -> str:
    """Header normalisation used for by-name loading: upper-case, space -> '_'."""
    return name.strip().upper().replace(" ", "_")
