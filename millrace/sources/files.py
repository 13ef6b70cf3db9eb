"""File and table sources / sinks.

* CSV is read as text columns named by the header and then conformed to the
  registry schema *by normalised name* (``Production Line`` ->
  ``PRODUCTION_LINE`` -> ``Production_Line``), never positionally, so files
  with missing or extra columns load correctly.
* Writes are idempotent: full refreshes overwrite, appends are keyed by a batch
  id partition, and publishing goes to a new version directory and one entry of
  the table's commit log, so readers never see a partial result and a replayed
  batch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.quality import conform_by_name
from millrace.schemas import FILE_ROUTES, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, normalize_name
from millrace.session import store

# ---------------------------------------------------------------- helpers


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """File names directly under ``folder`` (a directory listing, not data)."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


# ------------------------------------------------------------ S1 / S3 / S6


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV (gzip transparent, quoted fields) as all-text columns."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))


def csv_scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Full read of a headered CSV, conformed by name to ``table``."""
    return conform_by_name(read_csv_text(spark, path), table)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Upper-case column names, spaces -> underscores."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def csv_preview(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """First ``n`` rows in a stated order (file order is not defined)."""
    return df.orderBy(*order_cols).limit(n)


def csv_scan_tolerant(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Split a CSV into (good rows conformed to ``table``, quarantine) (S3).

    A line is quarantined when the parser flags it as malformed (wrong field
    count) or when a non-empty field fails its type conversion.
    """
    flagged = csv_scan_flagged(spark, path, table)
    good = flagged.where(~F.col("_bad")).drop("_bad", "_reason", "_line")
    quarantine = flagged.where(F.col("_bad")).select(F.col("_reason").alias("reason"),
                                                      F.col("_line").alias("line"))
    return good, quarantine


def csv_scan_flagged(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every line of a CSV conformed to ``table``, with _bad, _reason and _line."""
    header = read_csv_text(spark, path).columns
    text_schema = T.StructType([T.StructField(c, T.StringType()) for c in header]
                               + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .schema(text_schema).csv(path))
    return conform_with_flags(raw, table, header)


def conform_with_flags(raw: DataFrame, table: str, header: list[str]) -> DataFrame:
    """Typed columns plus a malformed flag and reason per line."""
    have = {normalize_name(c): c for c in header}
    typed_cols, checks = [], []
    for f in SCHEMAS[table].fields:
        src = have.get(normalize_name(f.name))
        if src is None:
            typed_cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        txt = F.col(f"`{src}`")
        val = txt.cast(f.dataType) if isinstance(f.dataType, T.StringType) else txt.try_cast(f.dataType)
        typed_cols.append(val.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            checks.append(F.when(txt.isNotNull() & (F.trim(txt) != "") & val.isNull(),
                                 F.lit(f"bad {f.name}")))
    reasons = F.concat_ws("; ", F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed line")), *checks)
    line = F.coalesce(F.col("_corrupt_record"), F.concat_ws(",", *[F.col(f"`{c}`") for c in header]))
    return raw.select(*typed_cols, (reasons != "").alias("_bad"), reasons.alias("_reason"),
                      line.alias("_line"))


# ------------------------------------------------------------- S4 / S5 / S7


def route_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Known file names present in ``folder`` -> bronze table.

    'live' files are excluded; absent files are skipped.
    """
    present = set(list_names(spark, folder))
    out = {}
    for name, table in FILE_ROUTES.items():
        if "live" in name:
            continue
        for cand in (name, name + ".gz"):
            if cand in present:
                out[f"{folder.rstrip('/')}/{cand}"] = table
                break
    return out


def bulk_load(spark: SparkSession, folder: str, target: str, at_once: int = 4) -> dict[str, int]:
    """Load every routed CSV into ``target/<table>`` as parquet (S4 + S7).

    Each table is a full refresh (overwrite). Lines that do not parse are
    skipped and go, with the reason, to ``target/_quarantine/<table>``. They are
    counted while the good lines are written, and a file that has some is read a
    second time for them; nothing is staged. ``at_once`` tables are loaded side
    by side. Returns table -> rows loaded.
    """
    base = target.rstrip("/")

    def load(route: tuple[str, str]) -> tuple[str, int]:
        path, table = route
        flagged, seen = csv_scan_flagged(spark, path, table), Observation()
        good = flagged.observe(seen, F.count_if("_bad").alias("bad")).where("not _bad").drop("_bad", "_reason", "_line")
        replace_table(good, f"{base}/{table}")
        bad = flagged.where("_bad" if seen.get["bad"] else "false")
        replace_table(bad.select(F.col("_line").alias("line"), F.col("_reason").alias("reason")), f"{base}/_quarantine/{table}")
        return table, spark.read.parquet(f"{base}/{table}").count()

    with ThreadPoolExecutor(at_once) as pool:
        return dict(pool.map(load, route_files(spark, folder).items()))


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Full refresh: overwrite the table's contents."""
    df.write.mode("overwrite").format(fmt).save(path)


FILE_BYTES = 256 << 20  # uncompressed bytes that one task writes into a partition folder


def write_chunks(chunks: list[DataFrame], path: str, partition_col: str | None = None,
                 files_per_value: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """First chunk overwrites, later chunks append (S11), optionally partitioned."""
    for i, c in enumerate(chunks):
        write_partitioned(c, path, partition_col, "overwrite" if i == 0 else "append", files_per_value, file_bytes)


def row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row's values: text and binary as they are, other types at their fixed width (8 where it varies)."""
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    width = sum(fixed.get(type(f.dataType), 8) for f in schema if not isinstance(f.dataType, (T.StringType, T.BinaryType)))
    out = F.lit(width).cast("long")
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(f.name), F.lit(0))
    return out


def write_partitioned(df: DataFrame, path: str, partition_col: str | None, mode: str = "overwrite",
                      files_per_value: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write each value's folder with as many tasks, and so files, as its bytes ask for.

    The bytes of every value are measured first, by one aggregate; a value gets
    one task per ``file_bytes``, so a date with a third of all rows is written
    by many tasks and a small one by one. Rows are dealt by (value, salt): without
    that every task writes a file of its own into every folder.
    ``files_per_value`` sets the number instead, the same for all values.
    """
    if partition_col is None:
        df.write.mode(mode).parquet(path)
        return
    hashed = F.xxhash64(*df.columns)  # of the row, so a retried task deals alike
    if files_per_value is not None:
        salted = df.withColumn("_salt", F.pmod(hashed, F.lit(files_per_value)))
        tasks = None
    else:
        sizes = df.groupBy(F.col(partition_col).alias("_value")).agg(
            F.greatest(F.lit(1), F.ceil(F.sum(row_bytes(df.schema)) / F.lit(file_bytes))).cast("long").alias("_files"))
        sizes = store(sizes, "value-sizes")  # one row a value
        tasks = sizes.agg(F.sum("_files")).first()[0] or 1
        salted = df.join(sizes, df[partition_col].eqNullSafe(sizes["_value"])).withColumn(
            "_salt", F.pmod(hashed, F.col("_files"))).drop("_value", "_files")
    by = [partition_col, "_salt"]
    dealt = salted.repartition(*by) if tasks is None else salted.repartition(max(tasks, 1), *by)
    dealt.drop("_salt").write.mode(mode).partitionBy(partition_col).parquet(path)


# ------------------------------------------------------------------ S12


class PublishConflict(RuntimeError):
    """Another writer committed first, or the table is not at the version the writer started from."""


@dataclass(frozen=True)
class Commit:
    """One entry of a published table's log."""

    number: int
    version: str
    parent: str | None      # the version before it
    folder: str
    given: bool             # the version was named by the caller; such versions ascend


ANY_PARENT = object()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, by one rename; False if there is one already.

    The rename does not overwrite, so of several writers exactly one succeeds
    (on file systems whose rename is atomic).
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    _, tmp = _fs(spark, f"{path.rsplit('/', 1)[0]}/_tmp-{uuid.uuid4().hex}")
    _put(fs, tmp, text)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    try:
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
        fc.rename(tmp, target, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError:
        fs.delete(tmp, False)
        if fs.exists(target):
            return False
        raise


def _put(fs, path, text: str) -> None:
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    """A small text file's contents."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commits(spark: SparkSession, base: str) -> list[Commit]:
    """The log of a published table, oldest first (the kept versions only)."""
    base = base.rstrip("/")
    out = []
    for name in list_names(spark, f"{base}/_log"):
        if name.isdigit():
            out.append(Commit(int(name), **json.loads(read_small(spark, f"{base}/_log/{name}"))))
    return out


def publish_version(df: DataFrame, base: str, version: str | None = None, keep: int = 3,
                    parent: str | None | object = ANY_PARENT) -> str:
    """Write ``df`` as a new version of a table and commit it to the table's log.

    The log has one small file per version, named by its number; the data lie in
    a folder of their own and are never written again. A commit is one rename
    that fails if the number is taken, so readers see whole versions only and of
    two writers one gets ``PublishConflict``; so does a writer whose ``parent``
    is no longer the newest version.

    A named version must come after the named ones before it (as text). One that
    does not is a replay: it is in the log or was replaced by what came after,
    and nothing is written, however often it happens. The ``keep`` newest
    versions stay, so a reader that resolved one before can finish, and the
    folders of attempts that were never committed go with their version.
    Returns the version.
    """
    spark, base = df.sparkSession, base.rstrip("/")
    log = commits(spark, base)
    named = [c.version for c in log if c.given]
    if version is not None and named and version <= max(named):
        return version
    newest = log[-1].version if log else None
    if parent is not ANY_PARENT and parent != newest:
        raise PublishConflict(f"{base} is at {newest}, not at {parent}")
    given, version = version is not None, version or uuid.uuid4().hex[:12]
    folder = f"v={version}.{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{base}/{folder}")
    entry = Commit(log[-1].number + 1 if log else 0, version, newest, folder, given)
    body = json.dumps({"version": version, "parent": newest, "folder": folder, "given": given})
    if not put_once(spark, f"{base}/_log/{entry.number:020d}", body):
        fs, mine = _fs(spark, f"{base}/{folder}")
        fs.delete(mine, True)
        raise PublishConflict(f"{base}: another writer has committed number {entry.number}")
    _clean(spark, base, [*log, entry], keep)
    return version


def _clean(spark: SparkSession, base: str, log: list[Commit], keep: int) -> None:
    """Remove versions before the ``keep`` newest, and attempts of logged versions that are not the logged one."""
    old = log[: max(0, len(log) - keep)]
    for c in old:  # the data first: an entry without data is only ever one that nobody needs
        fs, p = _fs(spark, f"{base}/{c.folder}")
        fs.delete(p, True)
        fs.delete(_fs(spark, f"{base}/_log/{c.number:020d}")[1], False)
    folders, versions = {c.folder for c in log}, {c.version for c in log}
    for name in list_names(spark, base):
        if name.startswith("v=") and name not in folders and name[2:].rsplit(".", 1)[0] in versions:
            fs, p = _fs(spark, f"{base}/{name}")
            fs.delete(p, True)


def published_versions(spark: SparkSession, base: str) -> list[str]:
    """The kept versions, oldest first."""
    return [c.version for c in commits(spark, base)]


def current_version(spark: SparkSession, base: str) -> str | None:
    log = commits(spark, base)
    return log[-1].version if log else None


def _read_commit(spark: SparkSession, base: str, c: Commit | None, schema: T.StructType | None) -> DataFrame | None:
    if c is None:
        return None
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(f"{base.rstrip('/')}/{c.folder}")


def read_published(spark: SparkSession, base: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest version; None before the first."""
    return _read_commit(spark, base, (commits(spark, base) or [None])[-1], schema)


def read_published_before(spark: SparkSession, base: str, version: str,
                          schema: T.StructType | None = None) -> DataFrame | None:
    """The newest named version before ``version``; for replays of ``version``."""
    older = [c for c in commits(spark, base) if c.given and c.version < version]
    return _read_commit(spark, base, (older or [None])[-1], schema)


# ------------------------------------------------------------- S13 / S14


def insert_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append one batch, idempotent per ``batch_id``.

    The batch lands in its own ``batch_id=`` partition, replaced on replay
    (dynamic partition overwrite), so re-running a batch cannot duplicate rows.
    """
    (df.withColumn("batch_id", F.lit(int(batch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id").parquet(path))


def jdbc_replace(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Replace a relational table's contents, keeping its definition.

    ``truncate=true`` makes Spark TRUNCATE instead of DROP/CREATE on overwrite;
    rows are inserted in JDBC batches of ``batchsize`` per task connection.
    """
    props = {"truncate": "true", "batchsize": "10000", **(properties or {})}
    df.write.mode("overwrite").jdbc(url, table, properties=props)


# ------------------------------------------------------------- S15 - S17


def create_namespaces(spark: SparkSession, names=("bronze", "silver", "gold")) -> None:
    """CREATE DATABASE IF NOT EXISTS for each layer."""
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")


def catalog_table(spark: SparkSession) -> DataFrame:
    """Schema catalogue: table, kind, column, type, key role, reference."""
    refs = {(t, c): f"{pt}.{pc}" for t, c, pt, pc in FOREIGN_KEYS}
    rows = []
    for t, st in SCHEMAS.items():
        kind = "dimension" if t.startswith("dim_") else "fact"
        for i, f in enumerate(st.fields):
            key = "PK" if PRIMARY_KEYS.get(t) == f.name else ("FK" if (t, f.name) in refs else None)
            rows.append((t, kind, i + 1, f.name, f.dataType.simpleString(), key, refs.get((t, f.name))))
    schema = ("Table_Name string, Kind string, Position int, Column_Name string, Data_Type string, "
              "Key_Role string, References string")
    return spark.createDataFrame(rows, schema)
