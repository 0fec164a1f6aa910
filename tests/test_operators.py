"""Operators on small frames: the rules that the catalogue's data do not reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import daily, decay, dedup, index, ledger, merge, pending, usage
from sessionlake.functions import settings

NOTE = """# 2026-02-01
lost
## Actions
<!-- template -->
- [global/implement] Set up
- [MyProject/implement] Feature

## Learnings
- [routed][global/pattern] known
- untagged
### sub
- [global] bare tag
## Lessons
- [routed][myproject/tip] only routed

"""


def lines(spark, text, key="day", name="2026-02-01"):
    return spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"))], f"{key} string, line_no int, line string")


@pytest.mark.parametrize(
    ("scope", "want"),
    [
        ("global", "# 2026-02-01\n## Actions\n<!-- template -->\n- [global/implement] Set up\n\n## Learnings\n### sub\n- [global] bare tag"),
        ("myproject", "# 2026-02-01\n## Actions\n- [MyProject/implement] Feature"),
        ("other", None),
    ],
)
def test_scope(spark, scope, want):
    row = daily.scope_text(lines(spark, NOTE), scope).first()
    assert (row and row.text) == want


def test_scope_titles(spark):
    assert daily.scope_text(lines(spark, "# 2026-02-01\n## A\n- [x] y"), "global").count() == 0
    assert daily.scope_text(lines(spark, "# other title"), "global").first().text == "# other title"


def test_recent(spark):
    notes = None
    for day, tag in (("2026-02-01", "p"), ("2026-02-02", "q"), ("2026-02-03", "p"), ("2026-02-04", "q"), ("2026-02-05", "p")):
        some = lines(spark, f"# {day}\n## A\n- [{tag}/x] y", name=day)
        notes = some if notes is None else notes.unionByName(some)
    assert [r.day for r in daily.global_recent(notes, 2, "p").collect()] == ["2026-02-05"]
    assert [r.day for r in daily.project_recent(notes, 2, "p").collect()] == ["2026-02-03", "2026-02-05"]
    assert daily.project_recent(notes, 2, None).count() == 0


TODAY = dt.date(2026, 2, 12)


@pytest.mark.parametrize(
    ("day", "after", "threshold", "want"),
    [("2026-01-01", None, 20, True), ("2026-02-01", None, 20, False), ("2026-01-13", None, 20, False), ("2026-01-12", None, 20, True), ("2026-01-01", 25, 20, True), ("2026-01-01", 5, 20, False), ("2025-06-01", 3, 20, False), ("2026-01-01", 20, 20, True), ("2026-01-15", 1, 2, False)],
)
def test_decay_rule(spark, day, after, threshold, want):
    from sessionlake.functions.text import should_decay

    row = spark.createDataFrame([(dt.date.fromisoformat(day), after)], "d date, n bigint").select(should_decay("d", F.lit(TODAY), 30, F.col("n"), threshold).alias("r")).first()
    assert row.r is want


LTM = """# Memory
## Pinned
- (2020-01-01) stays
## Key Learnings
<!-- decays -->
text
- (2026-01-01) [pattern] old
- undated
- (2026-02-10) new
## Key Decisions
<!-- c -->
- (2025-01-01) gone
## Other
- (2020-01-01) not eligible
"""


def test_decay_file(spark):
    rows = decay.classify(lines(spark, LTM, "file", "a.md"), F.lit(TODAY), compat=True)
    assert decay.render(rows).first().text == "# Memory\n## Pinned\n- (2020-01-01) stays\n## Key Learnings\n- undated\n- (2026-02-10) new\n## Key Decisions\n<!-- c -->\n## Other\n- (2020-01-01) not eligible\n"
    gone = decay.archived(rows, F.lit(TODAY)).orderBy("seq").collect()
    assert [g.entry for g in gone] == ["- (2026-01-01) [pattern] old\n  - *Source: a.md*", "- (2025-01-01) gone\n  - *Source: a.md*"]
    kept = decay.render(decay.classify(lines(spark, LTM, "file", "a.md"), F.lit(TODAY))).first().text
    assert "<!-- decays -->\ntext\n- undated" in kept
    archive = decay.append_archive(decay.archived(rows, F.lit(TODAY)), spark.createDataFrame([(dt.date(2024, 1, 1), "x", "f", 1)], "archived_on date, entry string, source_file string, seq int"))
    assert decay.purge(archive, F.lit(TODAY)).count() == 2
    assert decay.purged_sections(archive, F.lit(TODAY)).count() == 1
    assert decay.render_archive(archive).first().text.startswith("## Archived 2026-02-12\n- (2026-01-01)")
    parsed = decay.parse_archive(lines(spark, "# Decay Archive\n## Archived 2026-01-01\n- a\n## Archived 2026-13-01\n- b", "file", "x"))
    assert [str(r.archived_on) for r in parsed.orderBy("line_no").collect()] == ["None", "2026-01-01", "2026-01-01", "2026-01-01", "2026-01-01"]


def test_work_days_after(spark):
    entries = spark.createDataFrame([("p", dt.date(2026, 1, 2)), ("p", dt.date(2026, 1, 9)), ("q", dt.date(2026, 1, 1))], "k string, e date")
    days = spark.createDataFrame([("p", dt.date(2026, 1, d)) for d in (1, 2, 3, 3, 8)], "k string, d date")
    got = {(r.k, r.e.day): r.days_after for r in decay.work_days_after(entries, days, "k", "e", "d").collect()}
    assert got == {("p", 2): 3, ("p", 9): 0, ("q", 1): None}


def test_budget(spark):
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(40)] + [("b", 0, "x")], "s string, n int, line string")
    kept = pending.budget_lines(rows, "s", "n", 30).orderBy("s", "n").collect()
    assert [r.n for r in kept if r.s == "a"] == [*range(5), *range(30, 40)]
    assert [r.cut for r in kept if r.cut] == [25]
    assert sum(r.s == "b" for r in kept) == 1


def test_format(spark):
    said = [(0, "assistant", "one\ntwo"), (1, "assistant", "three")]
    rows = spark.createDataFrame([("2026-02-01", "h", "s1", dt.datetime(2026, 2, 1), 2, said)], "date string, project_hash string, session_id string, file_mtime timestamp, message_count bigint, messages array<struct<line_no:int,role:string,content:string>>")
    text = "\n".join(r.text for r in pending.format_extract(rows, 500).collect())
    assert "DAY: 2026-02-01 (1 sessions, 2 messages)" in text and "\n[ASSISTANT]\none\ntwo\n\n[ASSISTANT]\nthree" in text


def test_ledger(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "session_id string")
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(ledger.add(ids("a"), ids("a", "b"))) == ["a", "b"]
    assert got(ledger.remove(ids("a", "b"), ids("b", "c"))) == ["a"]
    assert got(ledger.removed(ids("a", "b"), ids("b", "c"))) == ["b"]
    sessions = spark.createDataFrame([("a", "2026-02-12"), ("b", "2026-02-11")], "session_id string, date string")
    assert got(ledger.final_ids(ids("a", "b", "z"), sessions, F.lit("2026-02-12"))) == ["b", "z"]
    assert got(ledger.of_dates(ids("a", "b"), sessions, ["2026-02-11"])) == ["b"]


ENTRY = "sessionId string, id string, modified string, lastActive string, created string, pos int"


def test_merge(spark):
    source = spark.createDataFrame([("a", None, "2026-02-02", None, "2026-01-01", 0), ("b", None, None, "2026-01-05", None, 1), ("c", None, "2026-01-01", None, None, 2), (None, None, None, None, None, 3)], ENTRY)
    dest = spark.createDataFrame([(None, "a", "2026-02-01", None, None, 0), ("b", None, None, "2026-01-05", None, 1)], ENTRY)
    got = [(r.sessionId or r.id, r.from_source) for r in merge.merge_newest(source, dest).collect()]
    assert got == [("a", True), ("b", False), ("c", True)]
    assert merge.append_missing(dest, source).count() == 2 + 3  # a, c and the row without an id


def test_prefix(spark):
    projects = spark.createDataFrame([("/a/pro", "p"), ("/a/project", "q")], "canonical_path string, name string")
    paths = spark.createDataFrame([("/A/project2/x",), ("/a/prx",), ("/a/pro",)], "path string")
    got = {r.path: r.name for r in index.match_project(paths, projects).collect()}
    assert got == {"/A/project2/x": "q", "/a/pro": "p"}
    assert [r.path for r in index.match_project(paths, projects, include_subdirs=False).collect()] == ["/a/pro"]
    assert index.match_project(paths, projects.limit(0)).count() == 0


def test_build_projects(spark):
    rows = [("-h-P", "/h/P", "2026-01-02"), ("-h-p", "/h/p", "2026-01-01"), ("-x", "", "2026-01-01"), ("-y", "/y", None)]
    got = index.build_projects(spark.createDataFrame(rows, "project_hash string, original_path string, day string")).collect()
    assert [(r.canonical_path, r.name, r.encoded_paths, r.work_days, r.variations) for r in got] == [("/h/p", "P", ["-h-P", "-h-p"], ["2026-01-01", "2026-01-02"], ["/h/P", "/h/p"])]


def test_matches_against_brute_force(spark):
    import random

    rng = random.Random(5)
    side = lambda n: [(i, rng.sample("abcdefghijkl", rng.randint(0, 6))) for i in range(n)]
    a, b = side(60), side(40)
    frame = lambda rows: spark.createDataFrame(rows, "id int, words array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {(i, j) for i, x in a for j, y in b if x and y and len({*x} & {*y}) / min(len(x), len(y)) >= t}
        assert {tuple(r) for r in dedup.matches(frame(a), frame(b), t).collect()} == want


def test_usage(spark):
    parts = spark.createDataFrame([("global_long_term", "x" * 7), ("global_short_term", "é" * 3), ("global_short_term", "y" * 3)], "component string, text string")
    got = {r.metric: r.value for r in usage.report(parts, settings.parse_settings(None), None).collect()}
    assert len(got) == 13
    assert (got["project_name"], got["global_long_term_tokens"], got["global_short_term_tokens"], got["total_tokens"], got["total_budget"]) == ("none", "1", "2", "3", "16750")


def test_remember_and_route(spark):
    notes = lines(spark, "## Pinned\n- a\n\n## Other\n- b", "file", "f")
    got = [r.line for r in daily.remember(notes, F.lit("- (2026-02-12) [tip] new")).orderBy("line_no").collect()]
    assert got == ["## Pinned", "- a", "- (2026-02-12) [tip] new", "", "## Other", "- b"]
    names = spark.createDataFrame([("MyProject",)], "name string")
    routed = {(r.target, r.routed) for r in daily.route(lines(spark, NOTE), names).collect()}
    assert ("MyProject", "- [routed][MyProject/implement] Feature") in routed and len(routed) == 3


def test_upsert(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, c string, v int")
    out = merge.upsert(rows(("a", "x", 1), (None, "x", 2), ("b", "y", 3)), rows(("a", "x", 9), (None, "x", 8)), ["k", "c"])
    assert sorted((r.k or "", r.v) for r in out.collect()) == [("", 8), ("a", 9), ("b", 3)]
    assert sorted(r.v for r in merge.remove_containing(rows(("a", "x/y", 1), ("b", None, 2)), "c", "/").collect()) == [2]


def test_project_names(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("",)], "name string")
    assert [r.name for r in index.project_names(rows).collect()] == ["a", "b"]


def test_a_common_word_forms_no_pairs(spark):
    """Candidates grow with the entries that match, not with the square of those that share a word."""
    found = []
    for n in (100, 400):
        rows = lambda side, n=n: spark.createDataFrame([(i, ["common", *(f"{side}{i}-{k}" for k in range(4))]) for i in range(n)] + [(n, [f"x{n}", "y", "common", "z"])], "id int, words array<string>")
        a, b = rows("a"), rows("b")
        words = dedup.shared_words(a, b).cache()
        left, right = (dedup.encoded(side.select(F.col("id").alias(k), "words"), k, words) for side, k in ((a, "a"), (b, "b")))
        found.append(dedup.candidates(left, right, 0.5).count())
        assert [tuple(r) for r in dedup.matches(a, b).collect()] == [(n, n)]
    assert found == [1, 1]
