"""The library's own operators on small literals, and every query with SQL against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tenure.functions import dates, rules, words
from tenure.operators import catalog, chunking, discovery, intervals, review, text, vectors
from tenure.plans import registry

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.mark.parametrize(
    ("spans", "months"),
    [
        ([(D(2020, 1, 1), D(2022, 12, 31)), (D(2021, 1, 1), D(2023, 12, 31))], 48),
        ([(D(2018, 1, 1), D(2019, 12, 31)), (D(2020, 1, 1), D(2021, 12, 31))], 48),
        ([(D(2018, 1, 1), D(2018, 12, 31)), (D(2020, 1, 1), D(2020, 12, 31))], 24),
    ],
)
def test_union_months(spark, spans, months):
    df = spark.createDataFrame([(1, *s) for s in spans], "k int, start date, end date")
    assert intervals.union_months(df, "k").first()["total_months"] == months


def test_dates(spark):
    cases = [("Jan 2020", D(2020, 1, 1)), ("January 2020", D(2020, 1, 1)), ("01/2020", D(2020, 1, 1)), ("2020", D(2020, 1, 1)), ("junk", None), ("Room 12 Jan 2020", D(2020, 1, 1)), ("13/2020", D(2020, 1, 1))]
    rows = spark.createDataFrame(cases, "t string, d date").select("t", "d", dates.parse_date(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == dict(cases)
    today = D(2026, 8, 17)
    spans = {"June’19 - Till date": (D(2019, 6, 1), today, True), "June’18 - Jan’19": (D(2018, 6, 1), D(2019, 1, 31), False), "Jan 2020 - Present": (D(2020, 1, 1), today, True), "": (None, None, False)}
    rows = spark.createDataFrame([(t,) for t in spans], "t string").select("t", dates.parse_range(F.col("t"), today).alias("r")).collect()
    assert {r.t: (r.r.start, r.r.end, r.r.is_current) for r in rows} == spans
    labels = {0: "0 months", 1: "1 month", 12: "1 year", 13: "1 year 1 month", 25: "2 years 1 month"}
    rows = spark.createDataFrame([(n,) for n in labels], "n int").select("n", dates.month_label(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == labels


def test_rules(spark):
    heads = {"Educational Qualification": "EDUCATION", "Internal Platform Tool": None, "Technologies": "SKILLS", "Projects": "PROJECTS", "Work History": "EXPERIENCE", "- Skills": None}
    rows = spark.createDataFrame([(t,) for t in heads], "t string").select("t", rules.canonical_section(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == heads
    titles = {"Project Head": None, "Head of Data": "Head", "Vice President": "C-Level", "Senior Manager": "Senior Manager", "Developer": "Mid-Level", "": "Mid-Level"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", rules.seniority(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == titles


def test_hyphens_and_sections(spark):
    rows = spark.createDataFrame([(1, 0, "well-"), (1, 1, "known and-"), (1, 2, "tried"), (1, 3, "Next--"), (1, 4, "line")], "doc_id int, line_no int, text string")
    assert [r.text for r in text.merge_hyphens(rows).orderBy("line_no").collect()] == ["well-known and-tried", "Next--", "line"]
    rows = spark.createDataFrame([(1, 0, "Ann"), (1, 1, "Skills"), (1, 2, "SQL")], "resume_id int, line_no int, text string")
    assert [(r.section, r.text, r.confidence) for r in text.sections(rows).orderBy("place").collect()] == [("CONTACT", "Ann", 0.5), ("SKILLS", "SQL", 0.95)]


def test_chunks(spark):
    lines = ["Ann Lee", "Experience", "stray line", "Client: Acme - Jan 2020 - Present", "Role: Developer", "Location: Rome", "- built a tool", "Title: kept as bullet", "Environment: Go, SQL and R", "Projects", "- loose start.", "Site", "It works."]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "Work History"), (2, 1, "- did things"), (2, 2, " "), (3, 0, None)], "resume_id int, line_no int, text string")
    got = chunking.chunks(rows, D(2026, 8, 17)).orderBy("resume_id", "sequence").collect()
    assert [(r.chunk_type, r.parent_sequence, r.text) for r in got if r.resume_id == 1] == [
        ("CONTACT", None, "Ann Lee"), ("EXPERIENCE_ROLE", None, "Client: Acme - Jan 2020 - Present\nRole: Developer"), ("EXPERIENCE_RESPONSIBILITY", 1, "built a tool"),
        ("EXPERIENCE_RESPONSIBILITY", 1, "Title: kept as bullet"), ("EXPERIENCE_TECHNOLOGY", 1, "Go, SQL and R"), ("PROJECT", None, "loose start."), ("PROJECT", None, "Site\nIt works."),
    ]
    assert [(r.company, r.role, r.start_date, r.is_current) for r in got if r.chunk_type == "EXPERIENCE_TECHNOLOGY"] == [("Acme", "Developer", D(2020, 1, 1), True)]
    assert [(r.chunk_type, r.text) for r in got if r.resume_id == 2] == [("EXPERIENCE_ROLE", "(Undated experience entries)"), ("EXPERIENCE_RESPONSIBILITY", "did things")]
    roles = chunking.role_rows(chunking.chunks(rows, D(2026, 8, 17))).collect()
    assert [(r.resume_id, r.place, r.company, r.technologies) for r in roles] == [(1, 1, "Acme", ["Go", "SQL", "R"])]


def test_skill_mentions(spark):
    texts = {"Apache Kafka": True, "framework": False, "Team Player": False, "London": False, "2019": False, "May 2019": False, "C (lang": False, "State University": False, "WORK TOOLS": False, "a b c d e f g": False, "x": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.is_plausible_skill(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == texts
    chunk = [(1, 0, "SKILL_SECTION", None, "Spark-SQL; London"), (1, 1, "EXPERIENCE_RESPONSIBILITY", "A", "used spark sql and Spark, go"), (1, 2, "EXPERIENCE_RESPONSIBILITY", None, "C++ for spark"), (2, 0, "OTHER", None, "spark")]
    chunked = spark.createDataFrame(chunk, "resume_id int, sequence long, chunk_type string, company string, text string")
    names = spark.createDataFrame([("Spark",), ("Spark SQL",), ("C++",), ("Go",)], "skill string")
    skills = discovery.discover(chunked, names)
    assert {(r.skill, r.text, r.confidence, tuple(r.chunks)) for r in skills.collect()} == {("Spark SQL", "Spark-SQL", 1.0, (0, 1)), ("Spark", "Spark", 0.85, (1, 2)), ("C++", "C++", 0.85, (2,))}
    assert {(r.skill, r.sources, r.strength, tuple(r.evidence)) for r in discovery.grade_skills(skills, chunked).collect()} == {("Spark SQL", 1, "MODERATE", (1,)), ("Spark", 2, "STRONG", (1, 2)), ("C++", 1, "MODERATE", (2,))}


def test_fuzzy_join_is_lossless(spark):
    import random

    rng = random.Random(3)
    pool = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(60)]
    texts = [p[:k] + rng.choice("abcd") + p[k + rng.randint(0, 1) :] for p in pool for k in (rng.randint(0, len(p)),)]
    a, b = spark.createDataFrame([(t,) for t in set(texts)], "key string"), spark.createDataFrame([(p, p) for p in set(pool)], "key string, entity string")
    got = {(r.key, r.entity) for r in catalog.fuzzy_candidates(a, b, 0.8).collect()}
    want = {(r.key, r.entity) for r in a.crossJoin(b.select("entity")).where(catalog.ratio(F.col("key"), F.col("entity")) >= 0.8).collect()}
    assert got == want and want


def test_vectors_and_answers(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalized(F.col("v")).alias("v")).collect()
    assert [r.v for r in v] == [[0.6, 0.8], [0.0, 0.0]]
    raw = {'{"a": 1}': '{"a": 1}', 'so {"a": 1} it is': '{"a": 1}', "x [1] y": "[1]", "{broken": None, "": None}
    rows = spark.createDataFrame([(t,) for t in raw], "t string").select("t", review.salvage(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == raw


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    a, b = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(a).equals(key(b))


def test_chunks_sort_lines_once_and_keep_awkward_groups(spark):
    import datetime as dt

    from tenure.operators import chunking

    texts = ["Jane", "Work History", "stray", "Firm Jan 2001 - Mar 2003", "Role: Dev", "- did", "plain", "Environment: b", "Education", "- ", "MIT", "Work Experience", "no anchor here", "Role: none"]
    rows = chunking.chunks(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "resume_id long, line_no long, text string"), dt.date(2004, 12, 31))
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1  # sections were found twice, for roles and for the others
    got = [(r.sequence, r.parent_sequence, r.chunk_type, r.text) for r in rows.orderBy("sequence").collect()]
    assert got == [
        (0, None, "CONTACT", "Jane"), (1, None, "EXPERIENCE_ROLE", "Firm Jan 2001 - Mar 2003\nRole: Dev"), (2, 1, "EXPERIENCE_RESPONSIBILITY", "did"), (3, 1, "EXPERIENCE_RESPONSIBILITY", "plain"),
        (4, 1, "EXPERIENCE_TECHNOLOGY", "b"), (5, None, "EDUCATION", "MIT"), (6, None, "EXPERIENCE_ROLE", "(Undated experience entries)"), (7, 6, "EXPERIENCE_RESPONSIBILITY", "no anchor here"), (8, 6, "EXPERIENCE_RESPONSIBILITY", "Role: none"),
    ]
