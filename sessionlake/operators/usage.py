"""Token usage of the memory components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as x

COMPONENTS = ("global_long_term", "global_short_term", "project_long_term", "project_short_term")


def component_tokens(parts: DataFrame) -> DataFrame:
    """(component, bytes, days, tokens) from (component, text), rows without text counting 0."""
    sizes = parts.groupBy("component").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"), F.count(F.when(F.col("text") != "", True)).alias("days"))
    return sizes.withColumn("tokens", x.usage_tokens("bytes"))


def report(parts: DataFrame, settings: dict, project: str | None) -> DataFrame:
    """(ord, metric, value): the thirteen usage figures; the total adds up rounded-down parts."""
    sizes = component_tokens(parts)
    row = sizes.agg(*[F.coalesce(F.max(F.when(F.col("component") == c, F.col(k))), F.lit(0)).alias(f"{c}_{k}") for c in COMPONENTS for k in ("tokens", "days")])
    limits = {"global_long": "globalLongTerm", "global_short": "globalShortTerm", "project_long": "projectLongTerm", "project_short": "projectShortTerm"}
    out = [("project_name", F.lit(project or "none"))]
    for side in ("global", "project"):
        for span in ("long", "short"):
            out.append((f"{side}_{span}_term_tokens", F.col(f"{side}_{span}_term_tokens")))
            out.append((f"{side}_{span}_limit", F.lit(settings[limits[f"{side}_{span}"]]["tokenLimit"])))
        out.append((f"{side}_short_days_actual", F.col(f"{side}_short_term_days")))
    out.append(("total_tokens", sum((F.col(f"{c}_tokens") for c in COMPONENTS), F.lit(0))))
    out.append(("total_budget", F.lit(settings["totalTokenBudget"])))
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), v.cast("string").alias("value")) for k, (m, v) in enumerate(out)])
    return row.select(F.explode(rows).alias("r")).select("r.*")
