"""The jobs as queries: each runs twice into a new folder of the cluster's and gives its output as it stands then."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from jobs import context_plan, work_day_index
from sessionlake.queries import KEYWORDS_SQL
from sessionlake.scratch import shared_dir


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{job}-{uuid4().hex}"


def _pattern(sf_dir: str, table: str) -> str:
    """A table's path as a pattern: a file stream takes a single file only by one, and a folder too."""
    return f"{sf_dir}/[{table[0]}]{table[1:]}.parquet"


def job1_work_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work days of every project by month, from all events."""
    folder = _folder(spark, "work-day-index")
    for _ in range(2):
        work_day_index.run(spark, _pattern(sf_dir, "events"), folder, f"{folder}/checkpoint")
    return work_day_index.read_index(spark, folder)


JOB1_SQL = """
with e as (select 'user' || cast(user_id as varchar) as project, coalesce(event_type, '') as folder, ts, cast(cast(ts as date) as varchar) as day, substr(cast(cast(ts as date) as varchar), 1, 7) as month from events where ts is not null and user_id is not null)
select project, cast(count(distinct day) as integer) as n_days, string_agg(distinct day, ',' order by day) as work_days, count(*) as events, string_agg(distinct folder, ',' order by folder) as folders, max(ts) as last_ts, month from e group by project, month
"""


def job2_context_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every project loads, of all documents, beside all benchmark texts as long-term notes."""
    folder = _folder(spark, "context-plan")
    for _ in range(2):
        context_plan.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return context_plan.read_plan(spark, folder)


JOB2_SQL = f"""
with a as (select doc_id, coalesce(nullif(source, ''), 'none') as project, coalesce(text, '') as text, length(coalesce(text, '')) // 4 as tokens, {KEYWORDS_SQL.format("coalesce(text, '')")} as w from documents where doc_id is not null),
 b as (select item_id, {KEYWORDS_SQL.format("coalesce(text, '')")} as w from benchmark where item_id is not null),
 o as (select doc_id, item_id, count(*) as n from (select doc_id, unnest(w) as k from a) join (select item_id, unnest(w) as k from b) using (k) group by all),
 r as (select o.doc_id, count(*) as repeats from o join a using (doc_id) join b using (item_id) where n >= 0.5 * least(len(a.w), len(b.w)) group by o.doc_id),
 s as (select a.*, coalesce(repeats, 0) as repeats, tokens > 0 and repeats is null as live from a left join r using (doc_id)),
 t as (select *, sum(case when live then tokens else 0 end) over (partition by project order by doc_id desc rows unbounded preceding) as running, count(*) filter (live) over (partition by project order by doc_id desc rows unbounded preceding) as place from s),
 u as (select *, case when tokens = 0 then 'empty' when repeats > 0 then 'routed' when running <= 16750 then 'load' else 'over' end as status from t)
select doc_id, status, cast(tokens as bigint) as tokens, case when live then place end as place, cast(case when live then running end as bigint) as running_tokens, repeats, case when status = 'load' then text end as text, project from u
"""

QUERIES = {"job1_work_day_index": job1_work_day_index, "job2_context_plan": job2_context_plan}
ORACLE_SQL = {"job1_work_day_index": JOB1_SQL, "job2_context_plan": JOB2_SQL}
