"""Row filters and projections used by the dashboards.

All are plain predicates / projections, so Catalyst pushes them into the
parquet scan (``PushedFilters``) and prunes the read schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The live table's display columns, and the operator roles.
DISPLAY_COLUMNS = ["Timestamp", "Mode", "Temperature", "Vibration", "Running_Status", "Error_Code"]
OPERATOR_ROLES = ["Operator", "Senior Operator"]


def machine_rows(df: DataFrame, machine: str, col: str = "Machine") -> DataFrame:
    """Rows of one machine."""
    return df.where(F.col(col) == machine)


def factory_machines(dim_machine: DataFrame, factory: str | None = None) -> DataFrame:
    """Machines of a factory (all factories when None)."""
    out = dim_machine.select("Factory", "Production_Line", "Machine")
    return out if factory is None else out.where(F.col("Factory") == factory)


def status_rows(df: DataFrame, status: str = "Warning") -> DataFrame:
    """Rows in a given running status."""
    return df.where(F.col("Running_Status") == status)


def staff_with_roles(employees: DataFrame, roles: list[str] = OPERATOR_ROLES) -> DataFrame:
    """Employees whose role is one of ``roles`` (P10)."""
    return employees.where(F.col("Role").isin(roles))


def positive_output(prod: DataFrame, include_scrap: bool = False) -> DataFrame:
    """Orders with output: produced > 0, or produced + scrap > 0."""
    q = F.col("Quantity_Produced") + (F.col("Scrap") if include_scrap else F.lit(0))
    return prod.where(q > 0)


def warehouses_of_type(warehouses: DataFrame, kind: str = "Raw Material") -> DataFrame:
    """Warehouses of one type."""
    return warehouses.where(F.col("Type") == kind)


def display_columns(df: DataFrame, cols: list[str] = DISPLAY_COLUMNS) -> DataFrame:
    """Column subset shown in the live table."""
    return df.select(*cols)
