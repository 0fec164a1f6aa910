"""Incremental ingest: transcripts that grow by a stream of their new lines, sessions by a ledger, drops by a file stream.

Spark's file stream never reads an appended file again, so it is for immutable drops only; what
transcripts gain comes through sources.growing, whose position is a byte in each file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.streaming import StreamingQuery

from sessionlake.operators import ledger
from sessionlake.sources import growing
from sessionlake.sources.sinks import replace_partitions


def process_once(extracted: DataFrame, captured: DataFrame, sink: Callable[[DataFrame], None], commit: Callable[[DataFrame], None], today: Column) -> None:
    """Writes the extract, and only then marks its sessions; those of today stay open.

    A failure before the commit leaves the ledger as it was, so the next run repeats the
    sink's work, which has to be idempotent by session.
    """
    sink(extracted)
    done = ledger.final_ids(extracted.select("session_id").distinct(), extracted.select("session_id", "date"), today)
    commit(ledger.add(captured, done))


def reopen(captured: DataFrame, session_id: str, spark: SparkSession) -> DataFrame:
    """The ledger without a session that was resumed."""
    return ledger.remove(captured, spark.createDataFrame([(session_id,)], "session_id string"))


def stream_drops(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes all Parquet files dropped so far, each once, and stops (trigger: available now)."""
    return transform(spark.readStream.schema(schema).parquet(path)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lines(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options: str | int) -> StreamingQuery:
    """Gives the sink the whole lines (path, start, line) that files below the folder gained since the checkpoint, and stops."""
    growing.register(spark)
    lines = spark.readStream.format("growing_lines").options(path=folder, **options).load()
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_lines(spark: SparkSession, folder: str, table: str, checkpoint: str, **options: str | int) -> DataFrame:
    """Adds the lines that files gained to a table, and gives the whole table: (path, start, line, batch).

    A batch has a partition of its own, so one that is repeated after a failure replaces itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), table, ["batch"])

    stream_lines(spark, folder, sink, checkpoint, **options).awaitTermination()
    return spark.read.schema(f"{growing.SCHEMA}, batch bigint").parquet(table)


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, events) as a watermarked stream or batch: work days as they close."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy("user_id", day.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.to_date("w.start").alias("day"), "events")
