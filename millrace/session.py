"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (a
# sort-merge join whose side turns out small becomes a broadcast join, skewed
# shuffle partitions are split), and the session time zone is pinned so that
# date/time functions behave the same on every executor.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoints cut lineage for the EMA and the distributed rank; remove the
    # files once the checkpointed DataFrame is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: float, executor_cores: int = 4, executors: int = 1000,
                 target_partition_bytes: int = 256 << 20,
                 max_partitions: int = 100_000) -> dict[str, str]:
    """Settings sized for a large input (e.g. 100 TB on 1,000 executors).

    * Shuffle partitions: about input / 256 MB (the largest stage shuffles at
      most the scanned bytes after pruning), at least 3 waves of the cores and
      at most ``max_partitions`` -- the shuffle keeps maps x reducers blocks,
      so beyond ~100k reducers metadata and small random reads dominate; a
      full 100 TB shuffle then has ~1 GB per reducer, which sort-based shuffle
      spills safely. AQE coalesces small partitions and splits skewed ones.
    * Input splits of 256 MB; AQE advisory size equal to the target.
    * Skew: a partition counts as skewed at 5x the median and > 1 GB.
    """
    cores = executor_cores * executors
    partitions = min(max_partitions, max(3 * cores, int(input_bytes // target_partition_bytes) + 1))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def get_spark(app: str = "millrace", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); AQE coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/ABFS) folder and
    is used as is. Only when nothing is configured on a local master (tests, a
    laptop) is a fresh local folder created; on a cluster that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) session: the server owns the folder
        return conf_dir or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="millrace-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts lineage and survives lost executors.

    The tables of an application lie in one folder; ``clear_scratch`` removes
    it once their results have been read.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application has stored on the way to its results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (like ``--py-files``).

    Grouped pandas functions reference this package's code; executors that do
    not have it installed receive a zip of it once per SparkContext. The zip
    is built in memory and written into the shared checkpoint folder, so no
    machine-local folder is involved.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) session: install the package server-side
        return
    if getattr(sc, "_millrace_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in sorted(os.walk(pkg_dir)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    data = buf.getvalue()
    target = os.path.join(checkpoint_dir(spark), "pyfiles",
                          f"millrace-{hashlib.sha1(data).hexdigest()[:12]}.zip")
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(target)
    sc._millrace_shipped = True
