"""Data-quality checks implied by the declared constraints (Q1-Q3).

The warehouse records primary and foreign keys without enforcing them, so the
checks are real work. Each check pre-aggregates keys (one row per distinct key)
before any join, so the shuffle carries distinct keys with counts, not rows.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, normalize_name


def pk_violations(load: Callable[[str], DataFrame], tables: list[str] | None = None) -> DataFrame:
    """Duplicate or NULL primary-key values per table.

    Output: Table_Name, Key_Value, Row_Count, Violation ('duplicate' | 'null').
    """
    parts = []
    for table in tables or list(PRIMARY_KEYS):
        pk = PRIMARY_KEYS[table]
        counts = load(table).groupBy(F.col(pk).alias("Key_Value")).agg(F.count(F.lit(1)).alias("Row_Count"))
        bad = counts.where(F.col("Key_Value").isNull() | (F.col("Row_Count") > 1))
        parts.append(bad.select(
            F.lit(table).alias("Table_Name"), F.col("Key_Value").cast("string").alias("Key_Value"),
            "Row_Count",
            F.when(F.col("Key_Value").isNull(), "null").otherwise("duplicate").alias("Violation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_orphans(load: Callable[[str], DataFrame],
               fks: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Foreign-key values with no parent row (NULL FKs are not orphans).

    Each child table is read once: its FK columns are unpivoted into
    (fk, key) pairs and counted per distinct key (partial aggregation); each
    parent table is read once for its distinct keys; one anti-join on
    (parent, key) finds the orphans.

    Output: Child_Table, Child_Column, Parent_Table, Key_Value, Orphan_Rows.
    """
    fks = fks or FOREIGN_KEYS
    by_child: dict[str, list[tuple[str, str, str]]] = {}
    for child, col, parent, pcol in fks:
        by_child.setdefault(child, []).append((col, parent, pcol))
    child_keys = None
    for child, refs in by_child.items():
        pairs = load(child).select(F.inline(F.array(*[
            F.struct(F.lit(col).alias("Child_Column"), F.lit(parent).alias("Parent_Table"),
                     F.col(col).cast("string").alias("Key_Value"))
            for col, parent, _ in refs])))
        counted = (pairs.where(F.col("Key_Value").isNotNull())
                   .groupBy("Child_Column", "Parent_Table", "Key_Value")
                   .agg(F.count(F.lit(1)).alias("Orphan_Rows"))
                   .withColumn("Child_Table", F.lit(child)))
        child_keys = counted if child_keys is None else child_keys.unionByName(counted)
    parents = {(parent, pcol) for _, _, parent, pcol in fks}
    parent_keys = None
    for parent, pcol in sorted(parents):
        keys = load(parent).select(F.lit(parent).alias("Parent_Table"),
                                   F.col(pcol).cast("string").alias("Key_Value")).distinct()
        parent_keys = keys if parent_keys is None else parent_keys.unionByName(keys)
    # A left-anti join would be pushed into every branch of the child union
    # (duplicating the parent side per branch); an outer join + NULL test is not.
    hit = parent_keys.withColumn("_hit", F.lit(True))
    orphans = (child_keys.join(hit, ["Parent_Table", "Key_Value"], "left")
               .where(F.col("_hit").isNull()))
    return orphans.select("Child_Table", "Child_Column", "Parent_Table", "Key_Value", "Orphan_Rows")


def schema_report(df: DataFrame, table: str) -> list[tuple[str, str]]:
    """Columns missing from / extra to the registry schema (by normalised name).

    Returns (column, 'missing' | 'extra'); works on the DataFrame's schema only.
    """
    want = {normalize_name(f.name): f.name for f in SCHEMAS[table].fields}
    have = {normalize_name(c): c for c in df.columns}
    out = [(want[k], "missing") for k in want if k not in have]
    out += [(have[k], "extra") for k in have if k not in want]
    return out


def conform_by_name(df: DataFrame, table: str) -> DataFrame:
    """Load-by-name: map columns onto the registry schema after normalising
    header names (upper case, space -> '_'); absent columns become typed NULLs,
    extra columns are dropped. ``Inspection_ID`` defaults to ``Inspection``."""
    have = {normalize_name(c): c for c in df.columns}
    cols = []
    for f in SCHEMAS[table].fields:
        src = have.get(normalize_name(f.name))
        if src is not None:
            c = F.col(f"`{src}`")
        elif table == "fact_quality" and f.name == "Inspection_ID" and "INSPECTION" in have:
            c = F.col(f"`{have['INSPECTION']}`")
        else:
            c = F.lit(None)
        cols.append(_typed(c, f.dataType).alias(f.name))
    return df.select(*cols)


def _typed(c, t: T.DataType):
    if isinstance(t, (T.TimestampNTZType, T.DateType, T.BooleanType, T.IntegerType, T.DoubleType)):
        return c.try_cast(t)
    return c.cast(t)
