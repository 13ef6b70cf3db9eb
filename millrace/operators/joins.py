"""Star joins and lookups over the bronze schema.

Join strategy is left to Catalyst and AQE: a dimension is broadcast when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (or AQE sees
it is small at runtime); no table is broadcast by a hint. Fact-to-fact joins
(shipments -> production orders) are shuffle joins.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import hash_unit
from millrace.schemas import FOREIGN_KEYS
from millrace.session import store

FEW_KEYS = {"dim_factory", "dim_production_line"}  # derived tables whose keys each stand in a large share of the facts


def foreign_keys_of(table: str) -> list[tuple[str, str, str]]:
    """(column, parent table, parent column) for each declared FK of ``table``."""
    return [(c, pt, pc) for t, c, pt, pc in FOREIGN_KEYS if t == table]


def star_join(table: str, load: Callable[[str], DataFrame], keys: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """LEFT-join a table to every parent named by its foreign keys (or by ``keys``).

    Parent attributes come out as ``<fk column>__<parent column>``. Duplicate
    parent keys fan out exactly like the SQL LEFT JOIN would. Parents of few keys
    (``FEW_KEYS``) are stored first, so the planner knows their size; without it
    every row of the table is dealt by a key of a handful of values.
    """
    out = load(table)
    for col, parent, pcol in keys or foreign_keys_of(table):
        p = load(parent)
        if parent in FEW_KEYS:
            p = store(p, parent)
        attrs = [c for c in p.columns if c != pcol]
        p = p.select(F.col(pcol).alias(f"_{col}_key"), *[F.col(a).alias(f"{col}__{a}") for a in attrs])
        out = out.join(p, out[col] == p[f"_{col}_key"], "left").drop(f"_{col}_key")
    return out


def star_join_sql(table: str, columns: dict[str, list[str]], keys: list[tuple[str, str, str]] | None = None) -> str:
    """The same star join as SQL text (for the oracle); ``columns`` maps table -> columns."""
    sel = [f't0."{c}"' for c in columns[table]]
    joins = []
    for i, (col, parent, pcol) in enumerate(keys or foreign_keys_of(table), start=1):
        sel += [f't{i}."{a}" AS "{col}__{a}"' for a in columns[parent] if a != pcol]
        joins.append(f'LEFT JOIN {parent} t{i} ON t0."{col}" = t{i}."{pcol}"')
    return f"SELECT {', '.join(sel)}\nFROM {table} t0\n" + "\n".join(joins)


def factory_products(dim_factory: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Products a factory can make: product category equals the factory type."""
    f = dim_factory.select("Factory", F.col("Type").alias("_ftype"))
    return (f.join(dim_product, f["_ftype"] == dim_product["Factory_Type"], "inner")
             .select("Factory", "Product", F.col("Factory_Type").alias("Product_Type")))


def staff_lookup(machines: DataFrame, employees: DataFrame, roles: list[str],
                 slot_key: str = "Machine", out_col: str = "Assigned_Employee") -> DataFrame:
    """Assign each machine one employee of ``roles`` from its factory.

    Staff of the machine's factory are numbered 0..k-1; the machine takes slot
    ``floor(u * k)`` with ``u`` a hash-uniform of the machine id -- an equi-join
    on (factory, slot), so no machine x staff pairs are formed. A machine
    without a factory draws from all staff (pool '*'), ordered by factory and
    name: its slot is a place in the running total of the factories' staff, so
    no task numbers all staff. No staff -> 'Unknown'.
    """
    staff = employees.where(F.col("Role").isin(roles)).select("Employee", F.col("Factory").alias("_pool"))
    own = staff.withColumn("_slot", F.row_number().over(Window.partitionBy("_pool").orderBy("Employee")) - 1)
    per = staff.groupBy("_pool").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_pool").rowsBetween(Window.unboundedPreceding, -1)  # one row per factory
    offsets = per.select(F.col("_pool").alias("_of"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    everyone = own.join(offsets, F.col("_pool").eqNullSafe(F.col("_of"))).select("Employee", F.lit("*").alias("_pool"), (F.col("_slot") + F.col("_before")).alias("_slot"))
    numbered = own.select("Employee", "_pool", F.col("_slot").cast("bigint")).unionByName(everyone)
    sizes = per.unionByName(per.agg(F.lit("*").alias("_pool"), F.sum("_k").alias("_k")).select("_pool", "_k"))
    m = machines.withColumn("_pool", F.coalesce(F.col("Factory"), F.lit("*")))
    m = m.join(sizes, "_pool", "left").withColumn(
        "_slot", F.floor(hash_unit(slot_key) * F.col("_k")).cast("int"))
    out = m.join(numbered, ["_pool", "_slot"], "left")
    return (out.withColumn(out_col, F.coalesce(F.col("Employee"), F.lit("Unknown")))
               .drop("_pool", "_slot", "_k", "Employee"))


def membership(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Mark rows of ``left`` that have a match in ``right`` (J9); each side is read once."""
    keys = right.select(*on).distinct().withColumn(flag, F.lit(True))
    return left.join(keys, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
