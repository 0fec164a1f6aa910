"""Plans what every project's next session loads: its newest notes within a token budget, without those that repeat long-term memory.

Reads notes (doc_id, source, text; the source is the project, a greater id is newer) and long-term
notes (item_id, text). A note whose keywords overlap with a long-term one is left out, as that is
loaded anyway; of the others the newest are loaded as long as their running sum of tokens is within
the budget. Writes every note's decision, partitioned by project, in place of what was there.

    python jobs/context_plan.py jobs/context_plan.json
"""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sessionlake.functions import text as x  # noqa: E402
from sessionlake.operators import dedup, scan  # noqa: E402
from sessionlake.scratch import Scratch  # noqa: E402
from sessionlake.session import get_spark  # noqa: E402

log = logging.getLogger("context_plan")

#: Text in a file of the output, about; a project of more has more files.
FILE_BYTES = 256 << 20
PLAN = "doc_id bigint, status string, tokens bigint, place bigint, running_tokens bigint, repeats bigint, text string, project string"


def plan(notes: DataFrame, long_term: DataFrame, budget: int, threshold: float) -> DataFrame:
    """(doc_id, project, status, tokens, place, running_tokens, repeats, text) of notes (doc_id, project, text).

    status: empty (no token), routed (overlaps with repeats long-term notes), load, or over (beyond the
    budget). place and running_tokens count the newer notes of the project that are neither empty nor
    routed, and the note itself; text is there if it is loaded.
    """
    words = notes.select(F.col("doc_id").alias("id"), x.keywords("text").alias("words"))
    known = long_term.select(F.col("item_id").alias("id"), x.keywords("text").alias("words"))
    routed = dedup.matches(words, known, threshold).groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("repeats"))
    routed = Scratch(notes.sparkSession).save(routed, "routed")  # it is read once for the carries and once for the rows
    rows = notes.withColumn("tokens", x.estimate_tokens("text")).join(routed, "doc_id", "left").withColumn("newest", -F.col("doc_id"))
    counts = (F.col("tokens") > 0) & F.col("repeats").isNull()
    rows = scan.running(rows, "project", "newest", sums={"running_tokens": F.when(counts, F.col("tokens")), "place": F.when(counts, F.lit(1).cast("bigint"))}, totals={"bytes": F.octet_length("text").cast("bigint")})
    status = F.when(F.col("tokens") == 0, "empty").when(F.col("repeats").isNotNull(), "routed").when(F.col("running_tokens") <= budget, "load").otherwise("over")
    rows = rows.withColumn("status", status)
    live = F.col("status").isin("load", "over")
    return rows.select(
        "doc_id", "status", "tokens", F.when(live, F.col("place")).alias("place"), F.when(live, F.col("running_tokens")).alias("running_tokens"),
        F.coalesce("repeats", F.lit(0).cast("bigint")).alias("repeats"), F.when(F.col("status") == "load", F.col("text")).alias("text"), "project", "bytes",
    )


def run(spark: SparkSession, notes: str, long_term: str, output: str, budget: int = 16_750, threshold: float = 0.5) -> dict[str, int]:
    """Writes the plan of all notes to output; how many notes have which status.

    Notes without an id are left out, null texts are empty, notes without a source are of project none.
    """
    read = spark.read.parquet(notes)
    project = F.coalesce(F.nullif("source", F.lit("")), F.lit("none"))
    some = read.where("doc_id is not null").select("doc_id", project.alias("project"), F.coalesce("text", F.lit("")).alias("text"))
    known = spark.read.parquet(long_term).where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    log.info("%s: %d notes read, %d of them without id; %s: %d long-term notes", notes, read.count(), read.where("doc_id is null").count(), long_term, known.count())
    made = plan(some, known, budget, threshold)
    part = F.pmod(F.xxhash64("doc_id"), F.ceil((F.col("bytes") + 1) / FILE_BYTES))
    made.repartition(F.col("project"), part).drop("bytes").write.mode("overwrite").partitionBy("project").parquet(output)
    held = {r["status"]: r["count"] for r in read_plan(spark, output).groupBy("status").count().collect()}
    log.info("%s: %s", output, ", ".join(f"{n} {s}" for s, n in sorted(held.items())) or "no notes written")
    return held


def read_plan(spark: SparkSession, output: str) -> DataFrame:
    """The plan as it stands."""
    return spark.read.schema(PLAN).parquet(output)


def main(config: str) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = json.loads(Path(config).read_text())
    spark = get_spark("context_plan")
    try:
        run(spark, settings["notes"], settings["long_term"], settings["output"], settings["budget"], settings["threshold"])
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
