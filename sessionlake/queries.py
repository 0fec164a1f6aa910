"""Queries over the driver's tables, one or more for each operator, with DuckDB oracles.

The tables hold no memory tree, so each operator runs on an analog: sessions are
conversations, projects are users, work days are days with events, the ledger is the label
table, notes are documents or markdown lines made from events. Every clock is a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.catalogue import ORACLE_SQL, QUERIES, query, table
from sessionlake.functions import text as x
from sessionlake.operators import daily, decay, dedup, index, ledger, merge, pending, usage

# Analog inputs, the same text in both dialects.
DAILY_LINE = """CASE event_id % 12
 WHEN 0 THEN '# ' || CAST(CAST(ts AS DATE) AS STRING) WHEN 1 THEN '## Learnings'
 WHEN 2 THEN '- [global/pattern] ' || event_type || ' pattern number' || CAST(event_id % 50 AS STRING)
 WHEN 3 THEN '- [User' || CAST(user_id % 5 AS STRING) || '/gotcha] ' || event_type || ' gotcha' WHEN 4 THEN '- [routed][global/pattern] known'
 WHEN 5 THEN '' WHEN 6 THEN 'plain paragraph ' || event_type WHEN 7 THEN '- untagged item' WHEN 8 THEN '## Actions'
 WHEN 9 THEN '  - [Global] nested ' || event_type WHEN 10 THEN '<!-- comment -->' ELSE '- (2024-01-05) [pattern] dated' END"""
NOTE_LINE = """CASE event_id % 8
 WHEN 0 THEN '## Key Learnings' WHEN 1 THEN '## Pinned' WHEN 2 THEN '## Key Decisions ' WHEN 3 THEN '<!-- comment -->'
 WHEN 7 THEN '- undated note' ELSE '- (' || CAST(CAST(ts AS DATE) AS STRING) || ') [pattern] note ' || CAST(event_id AS STRING) END"""
MARKED = """CASE (conv_id + turn) % 7
 WHEN 0 THEN 'Base directory for this skill: x' || text WHEN 1 THEN 'run <command-name>go</command-name> ' || text
 WHEN 2 THEN text || '<system-reminder>' WHEN 3 THEN '  [Request interrupted by user] ' WHEN 4 THEN repeat('x', 195) || '<command-name>' ELSE text END"""
DAILY_SQL = f"md as (select cast(cast(ts as date) as varchar) as day, event_id as line_no, {DAILY_LINE} as line from events)"
NOISE_SQL = "(starts_with(t, 'Base directory for this skill:') or contains(substr(t, 1, 200), '<command-name>') or contains(t, '<system-reminder>') or trim(t) = '[Request interrupted by user]')"
KEYWORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda t: len(t) > 2 and not list_contains([" + ", ".join(f"'{w}'" for w in x.STOPWORDS) + "], t)))"


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("CAST(CAST(ts AS DATE) AS STRING)").alias("day"), F.col("event_id").alias("line_no"), F.expr(DAILY_LINE).alias("line"))


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("'u' || CAST(user_id AS STRING)").alias("file"), F.col("event_id").alias("line_no"), F.expr(NOTE_LINE).alias("line"))


def work_day_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()


@query("select conv_id, count(*) as n_messages, cast(sum(strlen(text)) as bigint) as n_bytes, cast(sum(length(text) // 4) as bigint) as n_tokens, sha256(string_agg(role || chr(10) || text, chr(10) order by turn)) as messages_sha256 from conversations where role <> 'user' and text <> '' and not " + NOISE_SQL.replace("(t,", "(text,").replace("(t)", "(text)") + " group by conv_id")
def session_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's extract, its messages in order as a digest."""
    talk = table(spark, sf_dir, "conversations").select(F.lit("p").alias("project_hash"), F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), "role", F.col("text").alias("content"))
    said = talk.where((F.col("role") != "user") & (F.col("content") != "") & ~x.is_noise("content"))
    found = pending.extract(talk.select("project_hash", "session_id").distinct(), said)
    total = lambda f: F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + f(m["content"]))
    order = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n")
    return found.select(F.col("session_id").alias("conv_id"), F.col("message_count").alias("n_messages"), total(lambda c: F.octet_length(c).cast("bigint")).alias("n_bytes"), total(x.estimate_tokens).alias("n_tokens"), F.sha2(order, 256).alias("messages_sha256"))


@query(f"with c as (select conv_id, turn, {MARKED} as t from conversations) select conv_id, turn, {NOISE_SQL} as noise from c")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.is_noise(F.expr(MARKED)).alias("noise"))


@query("select conv_id, turn, case conv_id % 4 when 0 then text when 1 then text || chr(10) || role when 2 then '' else '[1]' end as content from conversations")
def flatten_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant contents: a string, a list with other parts, a number, a string that looks like a list."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    listed = F.to_json(F.array(part("text", F.col("text")), part("image", F.lit("no")), part("text", F.col("role"))))
    plain = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)
    raw = F.when(F.col("conv_id") % 4 == 0, plain(F.col("text"))).when(F.col("conv_id") % 4 == 1, listed).when(F.col("conv_id") % 4 == 2, F.lit("17")).otherwise(F.lit('"[1]"'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.flatten_content(F.try_parse_json(raw)).alias("content"))


@query(
    """with s as (select conv_id, sum(strlen(text)) as size, bool_or(role = 'assistant') as a from conversations group by conv_id)
 select cast(conv_id as varchar) as session_id, cast(size as bigint) as file_size from s where size >= 1000 and a and conv_id <> 3 and conv_id not in (select doc_id from labels where doc_id is not null)"""
)
def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.lit("p").alias("project_hash"), F.col("conv_id").cast("string").alias("session_id"), "role", "text")
    sessions = talk.groupBy("project_hash", "session_id").agg(F.sum(F.octet_length("text")).cast("bigint").alias("file_size"))
    said = talk.where("role = 'assistant'").select("project_hash", "session_id").distinct()
    captured = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("session_id"))
    return pending.pending_sessions(sessions, captured, exclude="3", assistant=said).select("session_id", "file_size")


@query("select distinct cast(cast(ts as date) as varchar) as date from events where not (day(ts) % 2 = 0 or event_type < 'm')")
def pending_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sessions = events.select(F.col("event_id").alias("session_id"), F.lit(1000).alias("file_size"), F.to_date("ts").cast("string").alias("date"))
    captured = events.where("day(ts) % 2 = 0 or event_type < 'm'").select(F.col("event_id").alias("session_id"))
    return pending.pending_days(pending.pending_sessions(sessions, captured))


@query(
    """with m as (select cast(conv_id % 9 as varchar) as date, conv_id, count(*) as n from conversations where role <> 'user' and text <> '' group by conv_id)
 select date, count(*) as sessions, cast(sum(n) as bigint) as messages from m group by date"""
)
def day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.lit("p").alias("project_hash"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line_no"), "role", F.col("text").alias("content"), (F.col("conv_id") % 9).cast("string").alias("date"))
    said = talk.where("role <> 'user' and content <> '' ").drop("date")
    return pending.day_totals(pending.extract(talk.select("project_hash", "session_id", "date").distinct(), said))


@query(
    """with f as (select '-u' || user_id || '-' || event_type as h, (case when event_type < 'm' then '/Home/U' else '/home/u' end) || user_id || '/Proj.x' as p, cast(cast(ts as date) as varchar) as day from events)
 select lower(p) as canonical_path, arg_min(regexp_extract(p, '[^/]+$'), h) as name, string_agg(distinct h, ',' order by h) as encoded_paths, string_agg(distinct day, ',' order by day) as work_days, count(distinct p) > 1 as varied from f group by lower(p)"""
)
def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "events").select(
        F.expr("'-u' || user_id || '-' || event_type").alias("project_hash"), F.expr("(CASE WHEN event_type < 'm' THEN '/Home/U' ELSE '/home/u' END) || user_id || '/Proj.x'").alias("original_path"), F.to_date("ts").cast("string").alias("day")
    )
    built = index.build_projects(folders)
    return built.select("canonical_path", "name", F.array_join("encoded_paths", ",").alias("encoded_paths"), F.array_join("work_days", ",").alias("work_days"), F.col("variations").isNotNull().alias("varied"))


@query("with d as (select distinct user_id, cast(ts as date) as day from events), e as (select distinct user_id, cast(ts as date) + cast(user_id % 3 as integer) as entry_day from events) select e.user_id, entry_day, count(d.day) as days_after from e left join d on d.user_id = e.user_id and d.day > e.entry_day group by all")
def working_day_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("user_id", F.date_add(F.to_date("ts"), (F.col("user_id") % 3).cast("int")).alias("entry_day")).distinct()
    return decay.work_days_after(entries, work_day_table(spark, sf_dir), "user_id", "entry_day", "day")


@query("select o_orderkey, cast(o_orderdate as date) < date '1998-08-02' - 30 as decays from orders")
def calendar_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", x.should_decay(F.to_date("o_orderdate"), F.to_date(F.lit("1998-08-02")), 30).alias("decays"))


@query(
    f"""with n as (select 'u' || cast(user_id as varchar) as file, event_id as line_no, {NOTE_LINE} as line from events),
 s as (select *, coalesce(last_value(case when starts_with(line, '## ') then trim(line) end ignore nulls) over (partition by file order by line_no), '') as section from n),
 i as (select *, section in ('## Key Learnings', '## Key Decisions') and starts_with(line, '- ') as item, try_cast(nullif(regexp_extract(line, '\\((\\d{{4}}-\\d{{2}}-\\d{{2}})\\)', 1), '') as date) as d from s),
 w as (select distinct 'u' || cast(user_id as varchar) as file, cast(ts as date) as day from events where event_type < 'm'),
 a as (select i.file, line_no, count(w.day) as after from i left join w on w.file = i.file and w.day > i.d group by all)
 select i.file, i.line_no, i.section, case when item and d is not null and (case when exists (select 1 from w where w.file = i.file) then after >= 8 else d < date '2024-01-25' - 10 end) then 'archive' else 'keep' end as action
 from i join a on a.file = i.file and a.line_no = i.line_no"""
)
def decay_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where("event_type < 'm'").select(F.expr("'u' || CAST(user_id AS STRING)").alias("file"), F.to_date("ts").alias("day")).distinct()
    rows = decay.classify(note_lines(spark, sf_dir), F.to_date(F.lit("2024-01-25")), 10, days, 8)
    return rows.select("file", "line_no", "section", "action")


@query("select cast(date_trunc('month', o_orderdate) as date) as archived_on, count(*) as entries from orders where date_trunc('month', o_orderdate) >= date '2001-08-01' - 365 group by all")
def archive_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("archived_on"))
    return decay.purge(archive, F.to_date(F.lit("2001-08-01"))).groupBy("archived_on").agg(F.count("*").alias("entries"))


def _scope_sql(scope: str) -> str:
    """Lines that a scope lets through, as CTEs ending in ``kept``."""
    para = "true" if scope == "global" else "false"
    return f"""{DAILY_SQL},
 p as (select *, count(*) filter (starts_with(line, '# ') or starts_with(line, '## ')) over (partition by day order by line_no) as part,
   coalesce(last_value(case when starts_with(line, '# ') then false when starts_with(line, '## ') then true end ignore nulls) over (partition by day order by line_no), false) as open from md),
 q as (select *, case when not open or starts_with(line, '## ') or regexp_matches(line, '^\\s*-\\s*\\[routed\\]') then false
   when regexp_matches(line, '^\\s*-\\s*\\[[^\\]/]+(/[^\\]]+)?\\]') then lower(regexp_extract(line, '^\\s*-\\s*\\[([^\\]/]+)', 1)) = '{scope}'
   when trim(line) = '' or starts_with(trim(line), '-') then false else {para} end as content from p),
 kept as (select day, line_no, line from (select *, bool_or(content) over (partition by day, part) as hit from q)
   where starts_with(line, '# ') or (open and hit and (starts_with(line, '## ') or content or trim(line) = '')))"""


def _text_sql(scope: str) -> str:
    return _scope_sql(scope) + ", t as (select day, regexp_replace(string_agg(line, chr(10) order by line_no), '\\s+$', '') as text from kept group by day), full_days as (select * from t where text <> '' and not regexp_matches(text, '^#\\s+\\d{4}-\\d{2}-\\d{2}\\s*$'))"


@query(f"with {_scope_sql('global')} select * from kept")
def section_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.scope_lines(daily_lines(spark, sf_dir), "global")


@query(f"with {_text_sql('user3')} select * from full_days")
def scope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.scope_text(daily_lines(spark, sf_dir), "User3")


@query(f"with {_text_sql('global')} select * from full_days where day in (select distinct day from md order by day desc limit 2)")
def global_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.global_recent(daily_lines(spark, sf_dir), 2)


@query(f"with {_text_sql('user1')} select * from full_days order by day desc limit 7")
def project_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.project_recent(daily_lines(spark, sf_dir), 7, "user1")


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents),
 r as (select *, count(*) over (partition by doc_id) as n, line_no + 1 as rn, greatest(30000 // (select count(distinct doc_id) from l), 15) as cap from l)
 select doc_id, cast(line_no as integer) as line_no, line, cast(case when n > cap and rn = n - (cap - cap // 3) + 1 then n - cap else 0 end as bigint) as cut from r where n <= cap or rn <= cap // 3 or rn > n - (cap - cap // 3)"""
)
def head_tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return pending.budget_lines(lines, "doc_id", "line_no", 30000)


@query(
    f"""with a as (select doc_id, {KEYWORDS_SQL.format("text")} as w from documents), b as (select item_id, {KEYWORDS_SQL.format("text")} as w from benchmark),
 o as (select doc_id, item_id, count(*) as n from (select doc_id, unnest(w) as k from a) join (select item_id, unnest(w) as k from b) using (k) group by all)
 select o.doc_id, o.item_id from o join a using (doc_id) join b using (item_id) where n >= 0.5 * least(len(a.w), len(b.w))"""
)
def routed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), x.keywords("text").alias("words"))
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), x.keywords("text").alias("words"))
    return dedup.matches(left, right).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"))


@query(
    f"""with {DAILY_SQL}, s as (select *, coalesce(last_value(case when starts_with(line, '## ') then trim(line) end ignore nulls) over (partition by day order by line_no), '') as section from md),
 e as (select day, line_no, {KEYWORDS_SQL.format("regexp_replace(line, '^\\s*-\\s*(\\[[^\\]]+\\])?\\s*', '')")} as w from s where section = '## Learnings' and regexp_matches(line, '^\\s*-\\s*\\[') and not regexp_matches(line, '^\\s*-\\s*\\[routed')),
 n as (select distinct line as l, {KEYWORDS_SQL.format("regexp_replace(line, '^- \\(\\d{4}-\\d{2}-\\d{2}\\) (\\[[^\\]]+\\])?\\s*', '')")} as w from (select '- (2024-01-02) [pattern] ' || event_type || ' pattern number' || (event_id % 50) as line from events where event_type < 'm')),
 hit as (select distinct e.day, e.line_no from e join n on len(e.w) > 0 and len(n.w) > 0 and len(list_intersect(e.w, n.w)) >= 0.7 * least(len(e.w), len(n.w)))
 select s.day, s.line_no, s.section, hit.day is not null as marked, case when hit.day is not null then regexp_replace(line, '^(\\s*-\\s*)', '\\1[routed]') else line end as line from s left join hit on hit.day = s.day and hit.line_no = s.line_no"""
)
def mark_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = daily.with_section(daily_lines(spark, sf_dir), "day").drop("sec_no")
    notes = table(spark, sf_dir, "events").where("event_type < 'm'").select(F.expr("'- (2024-01-02) [pattern] ' || event_type || ' pattern number' || (event_id % 50)").alias("line"))
    return dedup.mark_routed(lines, notes, 0.7)


@query(
    """with s as (select user_id as k, case when event_id % 3 = 0 then cast(ts as varchar) end as modified, cast(ts as varchar) as created, event_id, event_type < 'm' as src from events),
 r as (select *, coalesce(modified, created) as t from s),
 one as (select *, row_number() over (partition by k, src order by case when src then t end desc nulls last, case when src then -event_id else event_id end desc) as rn from r)
 select 's' || k as session_id, t as ts, src as from_source from (select *, row_number() over (partition by k order by t desc, src) as best from one where rn = 1) where best = 1"""
)
def newest_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.expr("CAST(ts AS STRING)")
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.expr("'s' || user_id").alias("sessionId"), F.lit(None).cast("string").alias("id"), F.when(F.col("event_id") % 3 == 0, stamp).alias("modified"), F.lit(None).cast("string").alias("lastActive"), stamp.alias("created"), F.col("event_id").alias("pos")
    )
    merged = merge.merge_newest(rows.where("event_type < 'm'"), rows.where("event_type >= 'm'"))
    return merged.select(F.col("sessionId").alias("session_id"), merge.entry_time().alias("ts"), "from_source")


@query("select event_id as id, user_id from events where event_type < 'm' union all select event_id, user_id + 1000 from events where event_type >= 'm'")
def missing_only_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), "user_id")
    return merge.append_missing(rows.join(events.where("event_type < 'm'").select(F.col("event_id").alias("id")), "id", "left_semi"), rows.withColumn("user_id", F.col("user_id") + 1000), "id")


@query(
    """with k as (select distinct lower(substr(url, 1, cast(18 + page_id % 9 as integer))) as key from pages)
 select url, max_by(key, length(key)) as canonical_path from (select distinct url from pages) join k on starts_with(lower(url), key) group by url"""
)
def prefix_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(F.lower(F.expr("substr(url, 1, cast(18 + page_id % 9 as int))")).alias("canonical_path")).distinct()
    return index.match_project(pages.select("url").distinct(), keys, "url").select("url", "canonical_path")


@query("select page_id, translate(url, '/.', '--') as encoded, translate(translate(url, '/.', '--'), '-', '/') as decoded, regexp_extract(rtrim(url, '/'), '[^/]*$') as name from pages")
def encode_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", x.encode_path("url").alias("encoded"), x.decode_path(x.encode_path("url")).alias("decoded"), x.basename("url").alias("name"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name), ' ', '-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') || '-long-term-memory.md' as file from part")
def kebab_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", x.memory_filename("p_name").alias("file"))


@query("select doc_id, length(text) // 4 as by_chars, strlen(text) // 4 as by_bytes from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", x.estimate_tokens("text").alias("by_chars"), x.usage_tokens(F.octet_length("text")).alias("by_bytes"))


@query(
    """with p as (select case when source < 'src14' then 'global_long_term' when source < 'src2' then 'global_short_term' when source < 'src5' then 'project_long_term' else 'project_short_term' end as component, text from documents)
 select component, cast(sum(strlen(text)) as bigint) as bytes, count(*) filter (text <> '') as days, cast(sum(strlen(text)) // 4 as bigint) as tokens from p group by component"""
)
def usage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.expr("CASE WHEN source < 'src14' THEN 'global_long_term' WHEN source < 'src2' THEN 'global_short_term' WHEN source < 'src5' THEN 'project_long_term' ELSE 'project_short_term' END")
    return usage.component_tokens(table(spark, sf_dir, "documents").select(part.alias("component"), "text"))


@query(f"select doc_id, cast(len({KEYWORDS_SQL.format('text')}) as bigint) as n, array_to_string(list_sort({KEYWORDS_SQL.format('text')}), ' ') as words from documents")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", x.keywords("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, cast(unnest(range(len(string_split(text, chr(10))))) as integer) as line_no from documents),
 h as (select *, contains(lower(line), 'license') as hit from l)
 select doc_id, line_no, line, hit from (select *, bool_or(hit) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as near from h) where near"""
)
def recall_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return daily.recall(lines, "License", key="doc_id")


@query(
    f"""with {DAILY_SQL}, t as (select *, lower(regexp_extract(line, '^\\s*-\\s*\\[([^\\]/]+)(/[^\\]]+)?\\]', 1)) as scope from md where not regexp_matches(line, '^\\s*-\\s*\\[routed\\]'))
 select day, line_no, line, case scope when 'global' then 'global' else 'User' || right(scope, 1) end as target, regexp_replace(line, '^(\\s*-\\s*)', '\\1[routed]') as routed from t where scope in ('global', 'user1', 'user2')"""
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("User1",), ("User2",)], "name string")
    return daily.route(daily_lines(spark, sf_dir), names)


@query(
    """select '-c' || c_custkey as project_hash, c_name as original_path, cast(count(o_orderkey) as integer) as file_count, cast(coalesce(sum(o_orderkey), 0) as bigint) as bytes
 from customer left join orders on o_custkey = c_custkey where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and c_acctbal >= 0 group by all"""
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "customer").select(F.expr("'-c' || c_custkey").alias("project_hash"), F.col("c_name").alias("original_path"), "c_acctbal")
    projects = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.array(F.expr("'-c' || o_custkey")).alias("encoded_paths"))
    existing = folders.where("c_acctbal < 0").select(F.col("original_path").alias("path"))
    files = table(spark, sf_dir, "orders").select(F.expr("'-c' || o_custkey").alias("project_hash"), F.col("o_orderkey").cast("bigint").alias("size"))
    found = index.orphans(folders.drop("c_acctbal"), projects, existing, files)
    return found.select("project_hash", "original_path", F.col("file_count").cast("int").alias("file_count"), "bytes")


@query("select p_name as name, not exists (select 1 from supplier where s_suppkey = p_partkey) as missing from part")
def stale_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("original_path"))
    existing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"))
    listed = index.statuses(projects, existing, projects.limit(0).select(F.col("name").alias("file")))
    return listed.select("name", (F.size("issues") > 0).alias("missing"))


@query("select cast(p_partkey as varchar) as original_path from part where p_partkey not in (select s_suppkey from supplier)")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("original_path"))
    return index.stale(projects, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path")))


_LEDGER_SESSIONS = "with s as (select event_id, cast(cast(ts as date) as varchar) as date from events where value >= 10) "


@query(_LEDGER_SESSIONS + "select event_id as session_id from events where value > 100 union select e.event_id from events e left join s on s.event_id = e.event_id where e.event_type < 'm' and (s.date is null or s.date <> '2024-01-15')")
def ledger_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), F.to_date("ts").cast("string").alias("date"), "event_type", "value")
    done = ledger.final_ids(events.where("event_type < 'm'").select("session_id"), events.where("value >= 10"), F.lit("2024-01-15"))
    return ledger.add(events.where("value > 100"), done)


@query(_LEDGER_SESSIONS + "select event_id as session_id from events where event_type < 'm' and event_id not in (select event_id from s where date in ('2024-01-03', '2024-01-04'))")
def uncapture_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), F.to_date("ts").cast("string").alias("date"), "event_type", "value")
    held = events.where("event_type < 'm'").select("session_id")
    return ledger.remove(held, ledger.of_dates(held, events.where("value >= 10"), ["2024-01-03", "2024-01-04"]))


_EVENT = """'{"tool_name":"' || (CASE turn % 3 WHEN 0 THEN 'Skill' WHEN 1 THEN 'Task' ELSE 'Bash' END) || '","x":"' || (CASE conv_id % 6 WHEN 0 THEN '.assistant/memory/a' WHEN 1 THEN '.assistant/scripts/b' WHEN 2 THEN '/tmp/c' WHEN 3 THEN 'a TRANSCRIPT' ELSE 'none' END) || '",' || (CASE WHEN conv_id % 4 = 0 THEN '"skill" : "recall"' ELSE '"skill":"projects"' END) || '}'"""


@query(f"with e as (select conv_id, turn, {_EVENT} as e from conversations) select conv_id, turn, (contains(e, '.assistant/memory') or contains(e, '.assistant/scripts') or contains(e, '/tmp/') or (contains(e, '\"Skill\"') and contains(e, 'recall')) or (contains(e, '\"Task\"') and regexp_matches(lower(e), 'synthesize|memory|transcript'))) as allowed from e")
def permission_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.is_allowed(F.expr(_EVENT)).alias("allowed"))


@query("select user_id, max(ts) is null or cast(max(ts) as date) < date '2024-01-30' or epoch(timestamp '2024-01-30 18:00:00') - epoch(max(ts)) > 7200 as due from (select user_id, ts from events where cast(ts as date) <= date '2024-01-30' and ts <= timestamp '2024-01-30 18:00:00') group by user_id")
def schedule_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 18:00:00").cast("timestamp")
    last = table(spark, sf_dir, "events").where(F.col("ts").cast("timestamp") <= now).groupBy("user_id").agg(F.max("ts").cast("string").alias("stamp"))
    return last.select("user_id", x.should_synthesize("stamp", now, 2).alias("due"))


@query("select page_id, replace(url, '/the', '/a') as url, (length(url) - length(replace(url, '/the', ''))) // 4 as n_replaced from pages")
def path_rewrite_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.rewrite_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "/the", "/a")


@query("select event_id, case when event_id % 3 = 0 then substr(cast(ts as varchar), 1, 10) when event_id % 3 = 1 then '2024-02-03' else cast(cast(ts as date) as varchar) end as date from events")
def session_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created with Z, with an offset whose own day counts, or invalid."""
    created = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.lit("2024-02-03T23:30:00-05:00")).otherwise(F.lit("not a time"))
    return table(spark, sf_dir, "events").select("event_id", x.session_date(created, "ts").alias("date"))


_DATED = "'- (' || (CASE o_orderkey % 4 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-1-3' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END) || ') [x] (1999-01-01)'"


@query("select o_orderkey, case o_orderkey % 4 when 0 then null when 1 then date '1999-01-01' else cast(o_orderdate as date) end as entry_date from orders")
def entry_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", x.entry_date(F.expr(_DATED)).alias("entry_date"))


@query(
    """with d as (select distinct user_id, cast(cast(ts as date) as varchar) as day, event_type < 'm' as old from events)
 select user_id, string_agg(distinct day, ',' order by day) as days, coalesce((select string_agg(distinct e.day, ',' order by e.day) from d e where e.user_id = d.user_id and e.old and e.day not in (select f.day from d f where f.user_id = e.user_id and not f.old)), '') as added from d group by user_id"""
)
def work_day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), (F.col("event_type") < "m").alias("old"))
    sides = days.groupBy("user_id").agg(F.collect_set(F.when(F.col("old"), F.col("day"))).alias("a"), F.collect_set(F.when(~F.col("old"), F.col("day"))).alias("b"))
    return sides.select("user_id", F.array_join(merge.union_days(F.col("a"), F.col("b")), ",").alias("days"), F.array_join(merge.new_days(F.col("a"), F.col("b")), ",").alias("added"))
