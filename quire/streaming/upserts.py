"""Structured Streaming: a stream of record changes folded into a stored table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import store
from quire.sources.adapters import _hadoop

#: What tells the changes of one batch from another's: the start of the query that wrote them, its id, the batch.
PARTS = ("started", "query", "batch_no")


def read_changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _identity(spark: SparkSession, checkpoint: str) -> tuple[int, str]:
    """When the query of a checkpoint was first started, and its id: the same after every restart from it."""
    place, system = _hadoop(spark, f"{checkpoint}/metadata")
    said = json.loads(spark.read.text(str(place)).first()[0])
    return system.getFileStatus(place).getModificationTime(), said["id"]


def upsert_stream(changes: DataFrame, table: str, checkpoint: str, keys: list[str], seq: str = "updated_at") -> StreamingQuery:
    """Fold micro-batches into a table of changes: `table`/started=/query=/batch_no=, the last change of each key per batch.

    A batch writes what it changes and nothing else. One that is run again writes its own folder again, so the
    result is exactly once; a query with a fresh checkpoint has an id of its own and leaves older folders alone.
    read_latest folds the batches, compact writes them as one.
    """

    def fold(batch: DataFrame, number: int) -> None:
        started, query = _identity(batch.sparkSession, checkpoint)
        last = store.fold_changes(batch, keys, [seq], "created_at")
        last.write.mode("overwrite").parquet(f"{table}/started={started}/query={query}/batch_no={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, keys: list[str], seq: str = "updated_at") -> DataFrame:
    """The state of a folded table: of each key the change that came last, with the first value of created_at."""
    parts = spark.read.option("basePath", table).parquet(table)
    order = ["started", "batch_no", seq]
    return store.fold_changes(parts, keys, order, "created_at").drop(*PARTS)


def compact(spark: SparkSession, table: str, target: str, keys: list[str], seq: str = "updated_at") -> None:
    """Write the state of a folded table as a single batch of a new one, to which streams may go on."""
    read_latest(spark, table, keys, seq).write.parquet(f"{target}/started=0/query=compacted/batch_no=0")


def window_counts(events: DataFrame, at: str, kind: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), kind, "n")
