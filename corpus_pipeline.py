"""A training-data pipeline over documents: five stages, each on what the last one kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a frame.
All but the last return the columns of documents. Every stage's result is written as
Parquet to the shared folder and reread, so a lost executor costs a reread at most.
Rules learned from labels can't be stated in SQL, so ORACLE_SQL is None; the tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm import decontam, packing, pii, resemblance, rules
from sessionlake.llm.common import Scratch, row_key, within
from sessionlake.llm.queries import tokenizer_files


def _rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``doc``, all of a row's columns as one struct, beside the keys, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(k) for k, c in keys.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null, empty and short texts go by the base rules. Repeated rows, ties and rows with a null
    id are judged by their text alone; very long texts are judged whole. Without usable
    labels the base rules decide. An empty table stays empty; other columns pass through.
    """
    judged = rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: of the smallest doc_id, the least text.

    Texts link at a Jaccard similarity of 0.8 or more of their five-word shingles, or by
    fingerprint as in operator 2; null counts as the empty text, and texts without words link.
    Rows are told apart by doc_id and text, so a doc_id that repeats or is null loses only the
    rows whose own texts are in a component with a row that stays. Null ids come last. Equal
    rows are brought down to one. Texts are compared whole, however long. An empty table
    stays empty; other columns pass through.
    """
    roots, scratch = resemblance.classes(docs).withColumnRenamed("node", "n"), Scratch(spark)
    rows = _rows(docs, d=F.col("doc_id"), n=resemblance.node(F.col("text")))
    known = rows.select("d", "n").join(roots, "n", "left").select("d", "n", F.coalesce("root", "n").alias("root"))
    known = scratch.save(known.groupBy("root", "d", "n").agg(F.count("*").alias("times")), "rows")
    names = known.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("last"), "d")).alias("first"), F.sum("times").alias("size")).where("size > 1")
    named = scratch.save(known.join(names, "root").select("root", "d", "n", "times", F.col("d").eqNullSafe(F.col("first.d")).alias("stays")), "named")
    same = F.col("d").eqNullSafe(F.col("other_d")) & (F.col("n") == F.col("other_n"))
    mine = [F.col(c).alias(f"other_{c}") for c in ("root", "d", "n")]
    kept = rows.join(within(named.where("not stays").select(*mine)), same, "left_anti")
    again = named.where("stays").groupBy("root").agg(F.sum("times").alias("size")).where("size > 1")
    again = scratch.save(named.where("stays").join(again, "root").select(*mine), "again")
    if again.isEmpty():
        return kept.select("doc.*")
    again = within(again)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(*[F.col(f"doc.`{c}`") for c in ("text", "doc_id", *rest)])
    one = kept.join(again, same).groupBy("other_root").agg(F.min(F.struct(order.alias("o"), "doc")).alias("least"))
    return kept.join(again, same, "left_anti").select("doc").unionByName(one.select("least.doc")).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and wordless texts match nothing and stay. Rows that share a doc_id are judged
    apart, by their own text; equal rows go or stay together. Texts are searched whole. An empty
    table stays empty, and with an empty benchmark everything stays; other columns pass through.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("other_d"), F.col("rk").alias("other_r")).distinct()
    rows = _rows(docs, d=F.col("doc_id"), r=row_key(F.col("doc_id"), F.col("text")))
    found = within(Scratch(spark).save(found, "found"))
    return rows.join(found, F.col("d").eqNullSafe(F.col("other_d")) & (F.col("r") == F.col("other_r")), "left_anti").select("doc.*")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and n_chars as the text is then.

    Null texts stay null. Repeated rows are masked alike; overlapping spans are replaced as one.
    Texts are masked whole. An empty table stays empty; other columns pass through.
    """
    found = pii.find(docs, keep=tuple(docs.columns))
    changed = {"text": F.when(F.col("doc.text").isNotNull(), F.col("masked")), "n_chars": F.when(F.col("doc.text").isNotNull(), F.length("masked").cast("bigint")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one token, their end. Repeated rows, and rows with a null id, are
    packed as often as they come; a long text is cut into as many pieces as it needs. An empty
    table gives no pieces; other columns are ignored.
    """
    packed = packing.pack(docs, **tokenizer_files())
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", mask_pii),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
