"""Recall by an index: which lines hold a term, without reading all lines.

An index is three tables below a folder: tokens, postings of tokens by bucket of the token, and lines by bucket of
their key. A term's longest run of letters and digits lies within one token of any line that holds the term, so
the tokens that contain it are looked up first, then only their postings' buckets are read, and then only
the buckets of the keys found; each candidate line is checked against the whole term. The lines found are those
of a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Buckets of either table, and tasks that share a bucket's rows, so that no token or key is written by one.
BUCKETS, SHARES = 64, 8
#: Tokens, or keys, up to which their buckets are picked; of more the whole table is read and joined.
MOST = 2_000
_TOKEN = r"[\p{L}\p{N}_]+"


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BUCKETS)).cast("int")


def build(lines: DataFrame, folder: str, key: str = "day") -> None:
    """Writes the index of (key, line_no, line), in place of what is there.

    line_no counts a key's lines without gaps. Null lines are lines without tokens; null keys are one key.
    """
    share = F.pmod(F.xxhash64("line_no"), F.lit(SHARES))
    own = lines.select(F.col(key).alias("key"), F.col("line_no").cast("bigint").alias("line_no"), "line").withColumn("bucket", _bucket("key"))
    own.repartition(F.col("bucket"), share).sortWithinPartitions("bucket", "key", "line_no").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lines")
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(f"({_TOKEN})"), F.lit(1)))
    postings = own.select("key", "line_no", F.explode(words).alias("token")).withColumn("bucket", _bucket("token"))
    postings.repartition(F.col("bucket"), share).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    held = lines.sparkSession.read.schema("token string, bucket int").parquet(f"{folder}/postings")
    held.groupBy("token").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/tokens")


def _picked(rows: DataFrame, by: DataFrame, column: str) -> DataFrame:
    """rows of the values that by has, by reading their buckets only where the values are few."""
    values = by.select(column).distinct()
    few = values.withColumn("bucket", _bucket(column)).limit(MOST + 1).collect()  # bounded
    if len(few) > MOST:
        return rows.join(values.select(F.col(column).alias("__v")), F.col(column).eqNullSafe(F.col("__v")), "left_semi")
    named = [r[column] for r in few if r[column] is not None]
    there = F.col(column).isin(named) if len(named) == len(few) else F.col(column).isin(named) | F.col(column).isNull()
    return rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in few}))).where(there)


def search(spark: SparkSession, folder: str, term: str, around: int = 2, key: str = "day", key_type: str = "string") -> DataFrame:
    """(key, line_no, line, hit), the key being of a type: lines that hold the term, in any case, and those up to around lines from them.

    A term without an ASCII letter or digit can't be looked up and is searched in all lines.
    """
    low = term.lower()
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    lines = read("lines", f"key {key_type}, line_no bigint, line string, bucket int")
    runs = re.findall(r"[a-z0-9]+", low)
    some = lines
    if runs:
        tokens = read("tokens", "token string, n bigint").where(F.col("token").contains(max(runs, key=len)))
        found = _picked(read("postings", f"key {key_type}, line_no bigint, token string, bucket int"), tokens, "token").select("key", "line_no").distinct()
        some = _picked(lines, found, "key").join(found.select(F.col("key").alias("k"), F.col("line_no").alias("l")), F.col("key").eqNullSafe(F.col("k")) & (F.col("line_no") == F.col("l")), "left_semi")
    hits = some.where(F.lower("line").contains(low)).select("key", "line_no")
    near = hits.select(F.col("key").alias("k"), F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("l"), F.col("line_no").alias("at")).groupBy("k", "l").agg(F.max(F.col("l") == F.col("at")).alias("hit"))
    wide = _picked(lines, hits, "key") if runs else lines
    return wide.join(near, F.col("key").eqNullSafe(F.col("k")) & (F.col("line_no") == F.col("l"))).select(F.col("key").alias(key), "line_no", "line", "hit")
