"""Scalar expressions: Column in, Column out, built-in functions only."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Markers of messages that carry no information of their own.
SKILL_PREFIX = "Base directory for this skill:"
COMMAND_MARK = "<command-name>"
REMINDER_MARK = "<system-reminder>"
INTERRUPTED = "[Request interrupted by user]"

# Words that don't count as keywords.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "that", "this", "these", "those", "not",
    "no", "nor", "or", "and", "but", "if", "so", "than", "too", "very", "just", "about", "up", "it", "its", "use", "when",
)

# Long-term sections that never decay, and those that do.
PROTECTED_SECTIONS = ("## About Me", "## Current Projects", "## Technical Environment", "## Patterns & Preferences", "## Pinned")
DECAY_SECTIONS = ("## Key Actions", "## Key Decisions", "## Key Learnings", "## Key Lessons")

# Entry types by section of a daily note.
TAG_TYPES = {
    "Actions": ("implement", "improve", "document", "analyze"),
    "Decisions": ("design", "tradeoff", "scope"),
    "Learnings": ("gotcha", "pitfall", "pattern"),
    "Lessons": ("insight", "tip", "workaround"),
}

# The forms of an entry line (tag, mark of a routed one, what precedes its text).
TAGGED = r"(?U)^\s*-\s*\[([^\]/]+)(?:/[^\]]+)?\]"
ROUTED = r"(?U)^\s*-\s*\[routed\]"
PREFIX = r"(?U)^\s*-\s*(?:\[routed\])?\s*(?:\[[^\]]+\])?\s*(?:\(\d{4}-\d{2}-\d{2}\))?\s*(?:\[[^\]]+\])?\s*"
BLANK = r"(?U)^\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_noise(text: Column | str) -> Column:
    """Messages to skip: injected instructions, commands, reminders, interruptions."""
    t = col(text)
    return t.startswith(SKILL_PREFIX) | F.substring(t, 1, 200).contains(COMMAND_MARK) | t.contains(REMINDER_MARK) | (stripped(t) == INTERRUPTED)


def flatten_content(value: Column | str) -> Column:
    """Text of a message's content (variant): a string itself, a list's text parts by line."""
    v = col(value)
    kind = F.schema_of_variant(v)
    parts = F.try_variant_get(v, "$", "array<variant>")
    is_text = lambda p: F.try_variant_get(p, "$.type", "string") == "text"
    texts = F.transform(F.filter(parts, is_text), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(texts, "\n")).otherwise(F.lit(""))


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(col(text)) / 4).cast("bigint")


def usage_tokens(n_bytes: Column | str) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(col(n_bytes) / 4).cast("bigint")


def index_datetime(text: Column | str) -> Column:
    """An ISO time with Z or an offset; null if invalid."""
    return F.try_to_timestamp(F.regexp_replace(col(text), "Z$", "+00:00"))


def session_date(created: Column | str, mtime: Column | str) -> Column:
    """The day of creation in its own offset, else the UTC day of modification."""
    c = col(created)
    return F.coalesce(F.when(index_datetime(c).isNotNull(), F.substring(c, 1, 10)), F.date_format(col(mtime), "yyyy-MM-dd"))


def entry_date(line: Column | str) -> Column:
    """The first (YYYY-MM-DD) in a line; null if there is none or it is no calendar date."""
    found = F.nullif(F.regexp_extract(col(line), r"\((\d{4}-\d{2}-\d{2})\)", 1), F.lit(""))
    return F.try_to_date(found, "yyyy-MM-dd")


def keywords(line: Column | str) -> Column:
    """Distinct words of an entry that mean something: no prefix, stopword or short word."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(col(line), PREFIX, "")), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)), F.array(*map(F.lit, STOPWORDS)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared keywords over the smaller set's size; null if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller)


def is_routed_match(a: Column | str, b: Column | str, threshold: float = 0.5) -> Column:
    """Whether two entry lines say the same, by overlap of keywords."""
    return F.coalesce(overlap_coefficient(keywords(a), keywords(b)) >= threshold, F.lit(False))


def encode_path(path: Column | str) -> Column:
    return F.translate(col(path), "/.", "--")


def decode_path(encoded: Column | str) -> Column:
    """For display only: encoding loses which characters were dots or dashes."""
    return F.translate(col(encoded), "-", "/")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(col(path), F.lit("/")), "/"), -1)


def kebab(name: Column | str) -> Column:
    kept = F.regexp_replace(F.replace(F.lower(col(name)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", "")
    return F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))


def memory_filename(name: Column | str) -> Column:
    return F.concat(kebab(name), F.lit("-long-term-memory.md"))


def entry_scope(line: Column | str) -> Column:
    """The lower-cased scope of a tagged entry, or null."""
    return F.nullif(F.lower(F.regexp_extract(col(line), TAGGED, 1)), F.lit(""))


def is_protected(header: Column | str) -> Column:
    return col(header).isin(*PROTECTED_SECTIONS)


def is_decay_eligible(header: Column | str) -> Column:
    return col(header).isin(*DECAY_SECTIONS)


def should_decay(day: Column | str, as_of: Column, age_days: int, work_days_after: Column | None = None, threshold: int | None = None) -> Column:
    """By working days where their count is known, else strictly older than age_days."""
    old = col(day) < F.date_sub(as_of, age_days)
    if work_days_after is None or threshold is None:
        return old
    return F.when(work_days_after.isNotNull(), work_days_after >= threshold).otherwise(old)


def should_synthesize(stamp: Column | str, now: Column, interval_hours: float) -> Column:
    """No valid stamp, a stamp of an earlier UTC day, or one more than the interval ago."""
    last = F.try_to_timestamp(stripped(stamp))
    hours = (F.unix_micros(now) - F.unix_micros(last)) / 3_600_000_000
    return last.isNull() | (F.to_date(last) < F.to_date(now)) | (hours > interval_hours)


def is_allowed(event: Column | str, root_name: str = r"\.assistant") -> Column:
    """Whether a tool call (raw JSON) is one of the memory tree's own operations.

    root_name is the pattern of the tree's root folder.
    """
    e = col(event)
    tool = F.regexp_extract(e, '"tool_name":"([^"]*)"', 1)
    return (
        e.rlike(f"{root_name}/memory")
        | ((tool == "Skill") & e.rlike(r'"skill"\s*:\s*"(synthesize|remember|recall|settings)"'))
        | ((tool == "Task") & e.rlike("(?i)(synthesize|memory|transcript)"))
        | e.rlike(f"{root_name}/scripts")
        | e.rlike(r'(/tmp/|"/tmp)')
    )


def count_literal(text: Column | str, old: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(old), F.lit("")))) / len(old)).cast("bigint")


def register_sql(spark: SparkSession) -> None:
    """The same as SQL functions of the session."""
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    prefix = PREFIX.replace("\\", "\\\\")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(x STRING) RETURNS BIGINT RETURN length(x) DIV 4")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION entry_keywords(x STRING) RETURNS ARRAY<STRING> RETURN array_except(array_distinct(filter(regexp_extract_all(lower(regexp_replace(x, '{prefix}', '')), '([a-z0-9_]+)', 1), t -> length(t) > 2)), array({words}))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlap_coefficient(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN least(size(a), size(b)) > 0 THEN size(array_intersect(a, b)) / least(size(a), size(b)) END")
