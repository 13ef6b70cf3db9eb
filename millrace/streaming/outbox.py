"""Delivery of micro-batches to several sinks, each at its own pace.

A batch is stored once, in ``<folder>/batch=<number>``, by one rename. Every sink
has a record of the last batch that it took, ``<folder>/_delivered/<sink>``, and
gets the batches after it in order. A sink that fails stops there and goes on
from that batch when it is next called; the others and the stream go on without
it. A sink may get the batch that it was working on a second time (after a crash
between its write and its record), never an earlier one, so its writes must
depend on the batch and its number alone. Batches that every sink has taken are
removed, but for the newest ones.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources.files import _fs, list_names, put_once, read_small

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame, int], None]


class SinkError(RuntimeError):
    """A batch could not be stored, or some sinks are behind when they must not be."""


class Outbox:
    def __init__(self, folder: str, schema: T.StructType, sinks: Mapping[str, Sink], keep: int = 3, at_once: int = 100):
        """``at_once``: batches that a sink may catch up on in one call, so that a long outage does not hold the stream."""
        self.folder = folder.rstrip("/")
        self.schema = schema
        self.sinks = dict(sinks)
        self.keep = keep
        self.at_once = at_once
        self.failures: list[tuple[int, str, str]] = []

    # -------------------------------------------------------------- records

    def stored(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches in the folder, ascending."""
        return sorted(int(n[6:]) for n in list_names(spark, self.folder) if n.startswith("batch="))

    def delivered(self, spark: SparkSession, sink: str) -> int:
        """The last batch that a sink has taken; -1 before the first."""
        done = [int(n) for n in list_names(spark, f"{self.folder}/_delivered/{sink}") if n.isdigit()]
        return max(done, default=-1)

    def behind(self, spark: SparkSession) -> dict[str, int]:
        """How many stored batches each sink has still to take (only sinks that have any)."""
        stored = self.stored(spark)
        left = {name: sum(b > self.delivered(spark, name) for b in stored) for name in self.sinks}
        return {name: n for name, n in left.items() if n}

    def _record(self, spark: SparkSession, sink: str, batch_id: int) -> None:
        folder = f"{self.folder}/_delivered/{sink}"
        put_once(spark, f"{folder}/{batch_id:020d}", "")
        for name in list_names(spark, folder):
            if name.isdigit() and int(name) < batch_id:
                fs, p = _fs(spark, f"{folder}/{name}")
                fs.delete(p, False)

    # ------------------------------------------------------------- the work

    def store(self, batch: DataFrame, batch_id: int, owner: str | None = None) -> bool:
        """Keep a batch; False if it is a replay of one that is or was here.

        ``owner`` names the query that numbers the batches: the numbers of
        another query (a new checkpoint) mean other rows, which is an error.
        """
        spark = batch.sparkSession
        if owner:
            path = f"{self.folder}/_owner"
            if not put_once(spark, path, owner) and read_small(spark, path) != owner:
                raise SinkError(f"{self.folder} belongs to the query {read_small(spark, path)}; a new checkpoint needs a new folder")
        stored = self.stored(spark)
        if stored and batch_id <= stored[-1]:
            return False
        staged = f"{self.folder}/_staging/batch={batch_id}"
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(staged)
        fs, target = _fs(spark, f"{self.folder}/batch={batch_id}")
        if not fs.rename(_fs(spark, staged)[1], target):
            raise SinkError(f"cannot store {target}")
        return True

    def deliver(self, spark: SparkSession) -> dict[str, int]:
        """Give every sink the batches it has not taken; returns ``behind``."""
        stored = self.stored(spark)
        for name, sink in self.sinks.items():
            last = self.delivered(spark, name)
            for batch_id in [b for b in stored if b > last][: self.at_once]:
                try:
                    sink(spark.read.schema(self.schema).parquet(f"{self.folder}/batch={batch_id}"), batch_id)
                except Exception as e:  # noqa: BLE001 - reported; the sink goes on from here when it is next called
                    self.failures.append((batch_id, name, repr(e)[:500]))
                    log.error("sink %s failed for batch %s: %s", name, batch_id, e)
                    break
                self._record(spark, name, batch_id)
        self._clean(spark, stored)
        return self.behind(spark)

    def _clean(self, spark: SparkSession, stored: list[int]) -> None:
        taken = min((self.delivered(spark, name) for name in self.sinks), default=-1)
        for batch_id in stored[: max(0, len(stored) - self.keep)]:
            if batch_id <= taken:
                fs, p = _fs(spark, f"{self.folder}/batch={batch_id}")
                fs.delete(p, True)
