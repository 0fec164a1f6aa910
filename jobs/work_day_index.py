"""Keeps each project's work days, folders and activity by month, from session events that keep arriving.

Reads event files (Parquet) as a stream that takes what its checkpoint hasn't seen, and stops. A
batch's counts go to a partition of its own; the months it touches are then made anew from all
batches of those months and replace their partitions, so late events re-open only their month, and
a batch that is repeated after a failure writes the same again.

    python jobs/work_day_index.py jobs/work_day_index.json
"""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sessionlake.operators import workdays  # noqa: E402
from sessionlake.session import get_spark  # noqa: E402
from sessionlake.sources.sinks import dynamic_overwrite  # noqa: E402

log = logging.getLogger("work_day_index")

ACTIVITY = "project string, folder string, days bigint, events bigint, last_ts timestamp, month string, batch bigint"
INDEX = "project string, n_days int, work_days string, events bigint, folders string, last_ts timestamp, month string"


def activity(events: DataFrame) -> DataFrame:
    """(month, project, folder, days, events, last_ts) of a batch; days is the month's bitmap. Events without a time or project are left out."""
    day = F.to_date("ts")
    usable = events.where("ts is not null and user_id is not null")
    named = usable.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("project"), F.coalesce("event_type", F.lit("")).alias("folder"), workdays.month_of(day).alias("month"), workdays.day_bit(day).cast("bigint").alias("bit"), "ts")
    return named.groupBy("month", "project", "folder").agg(F.bit_or("bit").alias("days"), F.count("*").alias("events"), F.max("ts").alias("last_ts"))


def month_index(parts: DataFrame) -> DataFrame:
    """One row for each project and month, from the parts of all batches."""
    rows = parts.groupBy("month", "project").agg(F.bit_or("days").alias("days"), F.sum("events").alias("events"), F.array_join(F.array_sort(F.collect_set("folder")), ",").alias("folders"), F.max("last_ts").alias("last_ts"))
    listed = F.array_join(workdays.day_list(F.col("month"), F.col("days")), ",")
    return rows.select("project", F.bit_count("days").cast("int").alias("n_days"), listed.alias("work_days"), "events", "folders", "last_ts", "month")


def run(spark: SparkSession, events: str, output: str, checkpoint: str, files_per_batch: int | None = None) -> dict[str, int]:
    """Takes what is new under events (a folder or a pattern of files), and updates output/activity and output/index; counts of what was read and written."""
    parts_at, index_at = f"{output}/activity", f"{output}/index"
    done = {"batches": 0, "events": 0, "months": 0, "rows": 0}

    def take(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        with dynamic_overwrite(own):
            made = activity(batch).withColumn("batch", F.lit(batch_id).cast("bigint"))
            made.write.mode("overwrite").partitionBy("month", "batch").parquet(parts_at)
            parts = own.read.schema(ACTIVITY).parquet(parts_at)
            new = parts.where(F.col("batch") == batch_id)
            touched = [r["month"] for r in new.select("month").distinct().orderBy("month").collect()]  # months: some hundreds at most
            if touched:
                month_index(parts.where(F.col("month").isin(touched))).write.mode("overwrite").partitionBy("month").parquet(index_at)
            n_events = new.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
            n_rows = own.read.schema(INDEX).parquet(index_at).where(F.col("month").isin(touched)).count() if touched else 0
        done.update(batches=done["batches"] + 1, events=done["events"] + n_events, months=done["months"] + len(touched), rows=done["rows"] + n_rows)
        log.info("batch %d: %d events read, months %s made anew, %d rows written to %s", batch_id, n_events, ",".join(touched), n_rows, index_at)

    source = spark.readStream.schema(spark.read.parquet(events).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.parquet(events).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%s: %d batches, %d events new", events, done["batches"], done["events"])
    return done


def read_index(spark: SparkSession, output: str) -> DataFrame:
    """The index as it stands."""
    return spark.read.schema(INDEX).parquet(f"{output}/index")


def main(config: str) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = json.loads(Path(config).read_text())
    spark = get_spark("work_day_index")
    try:
        run(spark, settings["events"], settings["output"], settings["checkpoint"], settings.get("files_per_batch"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
