"""The longest of many keys that a string begins with, by one sorted sweep.

Strings and keys are sorted together, by range, and each partition is swept with a stack of the keys
that are open: in order, the strings that begin with a key follow it without a gap. So the keys of earlier
partitions that are still open are those that the partition's first string begins with, and only
strings without a key of their own partition need them: its first strings, a few for each partition,
are cut at every length and joined to the keys by equality. The work doesn't depend on how many lengths the keys
have, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _swept(strings: DataFrame, keys: DataFrame, partitions: int | None) -> DataFrame:
    """(s, key, first): the longest key of the partition that s begins with, or null and the partition's first string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, open_keys = None, []
        for batch in batches:
            found, hits, firsts = [], [], []
            for s, is_key in zip(batch.column("s").to_pylist(), batch.column("is_key").to_pylist(), strict=True):
                first = s if first is None else first
                while open_keys and not s.startswith(open_keys[-1]):
                    open_keys.pop()
                if is_key:
                    if not open_keys or open_keys[-1] != s:
                        open_keys.append(s)
                else:
                    found.append(s)
                    hits.append(open_keys[-1] if open_keys else None)
                    firsts.append(None if open_keys else first)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(hits, pa.string()), pa.array(firsts, pa.string())], names=["s", "key", "first"])

    both = keys.select(F.col("key").alias("s"), F.lit(True).alias("is_key")).unionByName(strings.select("s", F.lit(False).alias("is_key")))
    ranged = both.repartitionByRange(partitions, "s") if partitions else both.repartitionByRange("s")
    return ranged.sortWithinPartitions("s", F.desc("is_key")).mapInArrow(run, "s string, key string, first string")


def longest_prefix(strings: DataFrame, keys: DataFrame, partitions: int | None = None) -> DataFrame:
    """(s, key): each string with the longest key that it begins with or equals, for those that have one.

    strings: (s), keys: (key). Both are taken once each; nulls match nothing, the empty key everything. Case counts.
    """
    strings, keys = strings.where("s is not null").select("s").distinct(), keys.where("key is not null").select("key").distinct()
    swept = _swept(strings, keys, partitions)
    own = swept.where("key is not null").select("s", "key")
    rest = swept.where("key is null")
    cut = rest.select("first").distinct().select("first", F.explode(F.transform(F.sequence(F.lit(0), F.length("first")), lambda n: F.substring("first", F.lit(1), n))).alias("key"))
    open_before = keys.join(F.broadcast(cut), "key").groupBy("first").agg(F.collect_list("key").alias("keys"))  # the prefixes of a string for each partition
    carried = rest.drop("key").join(open_before, "first").select("s", F.filter("keys", lambda k: F.startswith("s", k)).alias("keys")).where(F.size("keys") > 0)
    longest = F.array_max(F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    return own.unionByName(carried.select("s", longest.alias("key")))
