from __future__ import annotations

import textwrap

import duckdb
from helpers import docs, empty
from oracle import connect, same

from sessionlake.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    same(queries.op7_license_scan(spark, SF), connect(SF), queries.ORACLE_SQL["op7_license_scan"])


def test_scan(spark):
    known = dict(licenses.KNOWN)
    mit = "The MIT text follows\n"
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + known["MIT"].upper()), (2, known["Zlib"].replace("acknowledgment", "Acknowledgement").replace(".", " . ")), (3, mit + known["MIT"]), (4, None), (5, ""),
        (6, "(C) me\nAll rights reserved.\n" + known["ISC"].replace(", ", ",\n")), (7, known["MIT"].replace("sublicense", "sub-licence").replace("THE SOFTWARE", "the  software")), (8, "..."), (None, known["0BSD"]), (1, known["BSD-3-Clause"]), (9, known["BSD-2-Clause"]),
    ]
    got = sorted(((r.doc_id, r.license_id) for r in licenses.scan(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "MIT"), (2, "Zlib"), (3, None), (4, None), (5, None), (6, "ISC"), (7, "MIT"), (8, None), (None, "0BSD"), (1, "BSD-3-Clause"), (9, "BSD-2-Clause")], key=repr)
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs(spark, rows), licenses.known_digests(spark, (("X", "y"),))).where("license_id is not null").count() == 0


def test_files_as_they_come(spark):
    """Titled and wrapped texts, a body line that starts with the word copyright, and long licences."""
    known, full = dict(licenses.KNOWN), {f.stem: f.read_text(encoding="utf-8") for f in licenses.FULL_TEXTS.glob("*.txt")}
    wrapped = known["ISC"].replace("that the above copyright", "that the above\ncopyright")
    assert "\ncopyright notice" in wrapped
    rows = [(0, f"Copyright 2020 Someone\n\n{wrapped}", "ISC"), (1, f"ISC License\n\nCopyright © 2020 Someone\n\n{wrapped}", "ISC")]
    rows += [(10 + k, f"{title}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{textwrap.fill(known[i], 70)}\n", i) for k, (i, titles) in enumerate(licenses.TITLES.items()) for title in titles]
    for k, (i, text) in enumerate(sorted(full.items())):
        rows.append((20 + k, text, i))
    terms = full["Apache-2.0"].partition("   APPENDIX")[0]
    rows += [(40, terms, "Apache-2.0"), (42, "\n\n".join(textwrap.fill(p, 90) for p in terms.split("\n\n")), "Apache-2.0")]
    rows.append((41, "copyright is what this line is about\n" + known["MIT"], None))
    got = licenses.scan(docs(spark, [r[:2] for r in rows])).select("doc_id", "license_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(d, i) for d, _, i in rows], key=repr)
    assert len(full) == 6


def test_oracle_meets_licences(spark, tmp_path):
    """Query and SQL over a table that holds licences, whole, titled, respelt and changed."""
    rows = [(i, text) for i, (_, text) in enumerate(licenses.known_texts())]
    rows += [(1000 + i, text.replace("license", "licence").replace("acknowledgment", "acknowledgement").upper()) for i, (_, text) in enumerate(licenses.known_texts())]
    rows += [(1999, "a licence of its own " * 100_000), (2000, None), (2001, ""), (2002, "© me\n(c) you must stay\n(c) 2020\ncopyright holders stay"), (2003, "wilful willful whilst non-commercial")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op7_license_scan(spark, str(tmp_path))
    same(found, con, queries.ORACLE_SQL["op7_license_scan"])
    held = {r.doc_id for r in found.where("license_id is not null").collect()}
    assert held >= set(range(len(licenses.known_texts()))) and len(held) > 1.4 * len(licenses.known_texts()) and max(held) < 1999


def test_phrases_side_by_side(spark):
    """Equal texts have equal digests also where equivalent phrases follow one another, in the query and in its SQL."""
    pairs = [("per cent per cent", "percent percent"), ("sub-licence sub-license sub license", "sublicense sublicense sublicense"), ("copyright owner copyright owner non-commercial", "copyright holder copyright holder noncommercial"), ("per", "per"), ("sub sub license", "sub sublicense")]
    rows = [(2 * k + j, f"x {text}" if k % 2 else text) for k, pair in enumerate(pairs) for j, text in enumerate(pair)]
    got = {r.doc_id: r.digest for r in licenses.scan(docs(spark, rows)).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(len(pairs))) and len(set(got.values())) == len(pairs)
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {d: h for d, h, _ in con.sql("select doc_id, digest, license_id from (" + licenses.sql() + ")").fetchall()} == got
