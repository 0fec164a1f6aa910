"""Queries over tables and files that the job itself keeps: growing transcripts, the ledger as a table, work-day bitmaps.

What is kept is written by the executors from the driver's tables into a new folder, in two steps where growth
matters, and read back. The DuckDB SQL knows the driver's tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.catalogue import ORACLE_SQL, QUERIES, query, table
from sessionlake.functions import text as x
from sessionlake.operators import daily, nested, recall, scan, workdays
from sessionlake.plans import report
from sessionlake.plans.rewrite import rewrite_files
from sessionlake.queries import NOTE_LINE, note_lines
from sessionlake.scratch import Scratch
from sessionlake.sources import growing, ledger_table, sinks
from sessionlake.sources import text as files
from sessionlake.streaming import ingest

__all__ = ["ORACLE_SQL", "QUERIES"]

_TALK = "select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations"


def _write_transcripts(rows: DataFrame, folder: str) -> None:
    """One file of JSON lines for each conversation, in order of turn."""
    lines = rows.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    lines.select("conv_id", "value").write.mode("append").partitionBy("conv_id").text(folder)


def _conversation() -> F.Column:
    return F.regexp_extract("path", r"conv_id=(-?\d+)/", 1).cast("bigint").alias("conv_id")


@query(f"with t as ({_TALK}) select conv_id, count(*) as n_lines, sha256(string_agg(role || chr(10) || text, chr(10) order by turn)) as sha, cast(case when max(case when role = 'assistant' then 1 else 0 end) = 1 then 0 else 1 end as bigint) as batch from t where conv_id is not null group by conv_id")
def growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts taken by the stream in two runs: those with an assistant's turn first, then the others, each line once and in order."""
    folder, talk = Scratch(spark).root, table(spark, sf_dir, "conversations").where("conv_id is not null")
    answered = talk.where("role = 'assistant'").select("conv_id").distinct()
    for part in (talk.join(answered, "conv_id", "left_semi"), talk.join(answered, "conv_id", "left_anti")):
        _write_transcripts(part, f"{folder}/talk")
        lines = ingest.keep_lines(spark, f"{folder}/talk", f"{folder}/lines", f"{folder}/mark", suffix=".txt")
    said = lines.select(_conversation(), "start", "batch", F.from_json("line", "role string, text string").alias("m"))
    text = F.concat(F.coalesce("m.role", F.lit("")), F.lit("\n"), F.coalesce("m.text", F.lit("")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", text.alias("t")))), lambda z: z["t"]), "\n")
    return said.groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.sha2(whole, 256).alias("sha"), F.max("batch").alias("batch"))


@query(f"with t as ({_TALK}) select conv_id, turn, role from t where conv_id is not null qualify row_number() over (partition by conv_id order by turn) = 1")
def first_line_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every transcript, of which no more than a block is read."""
    folder = Scratch(spark).root
    _write_transcripts(table(spark, sf_dir, "conversations").where("conv_id is not null"), folder)
    growing.register(spark)
    lines = spark.read.format("growing_lines").option("path", folder).option("suffix", ".txt").option("first", True).load()
    return lines.select(_conversation(), F.from_json("line", "turn bigint, role string").alias("m")).select("conv_id", "m.turn", F.coalesce("m.role", F.lit("")).alias("role"))


_LEDGER = "with e as (select cast(event_id as varchar) as session_id, cast(cast(ts as date) as varchar) as day, event_type, value from events)"


@query(_LEDGER + " select session_id, day from e where event_type < 'm' and value < 50 or event_type >= 'm' and value >= 100")
def ledger_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger table after sessions were added, some of them twice, and others taken out."""
    path = f"{Scratch(spark).root}/ledger"
    ids = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("session_id"), F.to_date("ts").cast("string").alias("day"), "event_type", "value")
    ledger_table.add(spark, path, ids.where("event_type < 'm'"))
    ledger_table.add(spark, path, ids.where("value >= 100"))
    ledger_table.remove(spark, path, ids.where("event_type < 'm' and value >= 50"))
    return ledger_table.held(spark, path)


@query(
    """with d as (select distinct user_id, cast(ts as date) as day from events), e as (select distinct user_id, cast(ts as date) - cast(event_id % 40 as integer) + 20 as entry_day from events)
 select e.user_id, entry_day, count(d.day) as days_after from e left join d on d.user_id is not distinct from e.user_id and d.day > e.entry_day group by all"""
)
def work_days_after_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work days after an entry's, by bitmaps of months that are united from two halves of the events."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    old, new = (workdays.months(events.where(w), "user_id") for w in ("event_type < 'm'", "event_type >= 'm'"))
    entries = events.select("user_id", F.expr("date_add(day, cast(20 - event_id % 40 as int))").alias("entry_day")).distinct()
    return workdays.days_after(entries, workdays.unite(old, new, key="user_id"), "user_id", "entry_day")


@query("select event_id, sum(value) over (order by event_id rows unbounded preceding) > 1000 as over, count(*) filter (event_type = 'click') over (order by event_id rows unbounded preceding) as clicks, last_value(case when event_type = 'error' then event_id end ignore nulls) over (order by event_id rows unbounded preceding) as last_error, count(*) over () as n from (select event_id, event_type, round(value) as value from events)")
def running_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum, count and last value over all events as one key, cut into chunks of 500."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value").alias("value"), F.lit("all").alias("key"))
    one = F.lit(1).cast("bigint")
    got = scan.running(rows, "key", "event_id", {"total": F.col("value"), "clicks": F.when(F.col("event_type") == "click", one)}, {"last_error": F.when(F.col("event_type") == "error", F.col("event_id"))}, {"n": one}, width=500)
    return got.select("event_id", (F.col("total") > 1000).alias("over"), "clicks", "last_error", "n")


@query(
    f"""with n as (select 'u' || cast(user_id as varchar) as file, event_id as line_no, {NOTE_LINE} as line from events),
 s as (select *, coalesce(last_value(case when starts_with(line, '## ') then trim(line) end ignore nulls) over (partition by file order by line_no), '') as section from n)
 select file, line_no, section, section = '## Pinned' as protected, section in ('## Key Learnings', '## Key Decisions') as eligible from s"""
)
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the section of each line of the notes is protected from decay, or subject to it."""
    rows = daily.with_section(note_lines(spark, sf_dir), "file")
    return rows.select("file", "line_no", "section", x.is_protected("section").alias("protected"), x.is_decay_eligible("section").alias("eligible"))


@query("select 'page-' || cast(page_id as varchar) || '.html' as name, case when length(url) % 5 = 0 then 'missing' when length(url) % 5 = 1 then 'different' else 'same' end as status from pages where page_id is not null")
def folder_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a file to two folders, to the second not or changed where its address says so; what the comparison finds."""
    root, pages = Scratch(spark).root, table(spark, sf_dir, "pages").where("page_id is not null")
    text, rest, when = F.coalesce("html", F.lit("")), F.length("url") % 5, F.lit(None).cast("bigint").alias("mtime")
    at = lambda folder: F.concat(F.lit(f"{root}/{folder}/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path")
    sinks.write_files(pages.select(at("source"), text.alias("text"), when))
    sinks.write_files(pages.where(F.coalesce(rest, F.lit(2)) != 0).select(at("installed"), F.when(rest == 1, F.concat(text, F.lit("changed"))).otherwise(text).alias("text"), when))
    return report.compare_folders(spark, f"{root}/source", f"{root}/installed", "*.html")


@query("select page_id, replace(coalesce(html, ''), 'the', 'a the') as html, cast((length(coalesce(html, '')) - length(replace(coalesce(html, ''), 'the', ''))) // 3 as bigint) as n from pages where page_id is not null")
def rewritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file, rewritten in place by ranges of 100 bytes; the texts as they are then and the replacements counted."""
    root, pages = Scratch(spark).root, table(spark, sf_dir, "pages").where("page_id is not null")
    path = F.concat(F.lit(f"{root}/"), F.col("page_id").cast("string"), F.lit(".html"))
    sinks.write_files(pages.select(path.alias("path"), F.coalesce("html", F.lit("")).alias("text"), F.lit(None).cast("bigint").alias("mtime")))
    found = rewrite_files(spark, root, ".html", "the", "a the", split=100)
    counts = spark.createDataFrame([(int(p.removesuffix(".html")), n) for p, n in found.items()], "page_id bigint, n bigint")
    held = files.read_whole(spark, f"{root}/*.html").select(F.col("stem").cast("bigint").alias("page_id"), F.col("value").alias("html"))
    return held.join(counts, "page_id", "left").fillna(0, ["n"]).select("page_id", "html", "n")


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, cast(unnest(range(len(string_split(text, chr(10))))) as bigint) as line_no from documents),
 h as (select *, contains(lower(line), 'version 2') as hit from l)
 select doc_id, line_no, line, hit from (select *, bool_or(hit) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as near from h) where near"""
)
def recall_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term of two words, with the lines around it, by an index of the lines of all documents."""
    folder = Scratch(spark).root
    recall.build(table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), folder, "doc_id")
    return recall.search(spark, folder, "Version 2", key="doc_id", key_type="bigint")


_DOCS = """with e as (select user_id, cast(cast(ts as date) as varchar) as day, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events),
b as (select user_id, day, count(*) as n, max(k) as k from e where value < 50 group by all), o as (select user_id, day, count(*) as n from e where value >= 20 group by all),
d as (select user_id, count(*) as n_days, cast(sum(coalesce(o.n, b.n)) as bigint) as n, cast(sum(b.k) as bigint) as k from b full join o using (user_id, day) group by user_id),
t as (select user_id, event_type, day, min(case when value < 50 then 0 else 1 end) as side from e where value is not null group by all)"""


def _user_documents(events: DataFrame, *of_day: F.Column, **own: str) -> DataFrame:
    """(id, text): a JSON document for each user, with figures by day and what kinds of events each day had."""
    days = events.groupBy("user_id", "day").agg(*of_day).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", F.struct(*("n", "k")[: len(of_day)])))).alias("days"))
    entry = F.struct(F.col("event_type").alias("kind"), F.array(F.struct(F.col("day").alias("at"))).alias("seen"))
    kinds = events.select("user_id", "event_type", "day").distinct().groupBy("user_id").agg(F.struct(F.array_sort(F.collect_list(entry)).alias("entries")).alias("log"))
    return days.join(kinds, "user_id").select(F.col("user_id").alias("id"), F.to_json(F.struct("days", "log", F.struct(*[F.lit(v).alias(k) for k, v in own.items()]).alias("marks"))).alias("text"))


#: Events of one task: partitions grow with the table, and hold every user's whole.
_TASK_EVENTS = 100_000


def _merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    parts = max(spark.sparkContext.defaultParallelism, events.count() // _TASK_EVENTS)
    events, n = events.repartition(parts, "user_id"), F.count("*").alias("n")
    base, new = _user_documents(events.where("value < 50"), n, F.max("k").alias("k"), a="base", b="base"), _user_documents(events.where("value >= 20"), n, b="new")
    return nested.merge_documents(base, new, [("log", "entries")])


def _entries() -> F.Column:
    return F.array_join(F.transform("d.log.entries", lambda e: F.concat(e["kind"], F.lit(":"), e["seen"][0]["at"])), ",")


_DOC = "days map<string,struct<n:bigint,k:bigint>>, log struct<entries:array<struct<kind:string,seen:array<struct<at:string>>>>>, marks struct<a:string,b:string>"


@query(
    _DOCS + """ select d.user_id, n_days, n, k, x.entries, case when b.user_id is not null then 'base' end as a, case when o.user_id is not null then 'new' else 'base' end as b from d
join (select user_id, string_agg(event_type || ':' || day, ',' order by side, event_type, day) as entries from t group by user_id) x on x.user_id = d.user_id
left join (select distinct user_id from b) b on b.user_id = d.user_id left join (select distinct user_id from o) o on o.user_id = d.user_id"""
)
def documents_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' documents of some events over those of others, merged by key, and lists within them by element."""
    read = _merged_documents(spark, sf_dir).select("id", F.from_json("text", _DOC).alias("d"))
    total = lambda c: F.aggregate(F.filter(F.transform(F.map_values("d.days"), lambda x: x[c]), F.isnotnull), F.lit(0).cast("bigint"), lambda s, x: s + x)
    sums = [total("n").alias("n"), F.when(F.exists(F.map_values("d.days"), lambda x: x["k"].isNotNull()), total("k")).alias("k")]
    return read.select(F.col("id").alias("user_id"), F.size("d.days").cast("bigint").alias("n_days"), *sums, _entries().alias("entries"), "d.marks.a", "d.marks.b")


@query(
    _DOCS + """ select user_id, count(*) filter (where gone) as n_removed, count(*) filter (where not gone) > 0 as has_log, string_agg(event_type || ':' || day, ',' order by side, event_type, day) filter (where not gone) as entries
from (select *, contains(day, '-01-1') or contains(day, '-01-3') as gone from t) group by user_id"""
)
def documents_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged documents without the elements that saw certain days."""
    seen = lambda e: F.transform(F.try_variant_get(e, "$.seen", "array<variant>"), lambda s: F.try_variant_get(s, "$.at", "string"))
    left = nested.remove_elements(_merged_documents(spark, sf_dir), [("log", "entries")], seen, ["-01-1", "-01-3"]).select("id", "n_removed", F.from_json("text", _DOC).alias("d"))
    return left.select(F.col("id").alias("user_id"), "n_removed", F.col("d.log").isNotNull().alias("has_log"), _entries().alias("entries"))
