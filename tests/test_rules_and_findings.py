"""Literal values of the fixed rules, and the operators on verdicts, verification, evidence, retrieval and narratives."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tenure.functions import dates, rules
from tenure.operators import catalog, discovery, intake, narrative, review, scoring, text, vectors, verdicts

D = dt.date


def mapped(spark, values, column):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, t string").select("n", column(F.col("t")).alias("x")).orderBy("n").collect()
    return {v: r.x for v, r in zip(values, rows, strict=True)}


def test_seniority(spark):
    want = {
        "Software Intern": "Intern", "Graduate Trainee": "Trainee", "Junior Developer": "Junior", "Jr Developer": "Mid-Level", "Associate Engineer": "Associate", "Software Engineer": "Mid-Level",
        "Senior Engineer": "Senior", "Sr. Engineer": "Senior", "Lead Engineer": "Lead", "scrummaster": "Lead", "Productowner": "Lead", "Principal Engineer": "Principal", "Staff Engineer": "Staff",
        "Solution Architect": "Architect", "Engineering Manager": "Manager", "Senior  Manager": "Senior Manager", "Sr. Manager": "Senior Manager", "SrManager": "Senior Manager", "Director of Data": "Director",
        "Head  of Data": "Head", "VP Sales": "VP", "Vice-President": "C-Level", "CTO": "C-Level", "Project Head": None, "Founder": None, "Co-Founder": None, "Owner": None, "": "Mid-Level", " ": "Mid-Level",
    }
    assert mapped(spark, want, rules.seniority) == want
    confidence = {"Sr. Manager": 0.9, "Engineer": 0.7, "Founder": 0.3, "": 0.4}
    assert mapped(spark, confidence, rules.seniority_confidence) == confidence
    assert mapped(spark, ["Intern", "Senior Manager", "C-Level", "King"], rules.ladder_place) == {"Intern": 1, "Senior Manager": 12, "C-Level": 16, "King": None}


def test_responsibility(spark):
    want = {
        "Developed reports": "TASK_EXECUTION", "Owned the billing service": "OWNERSHIP", "Architected the platform": "ARCHITECTURE", "Mentored two juniors": "MENTORING_LEADERSHIP", "Managed team": "MENTORING_LEADERSHIP",
        "Managed  a  team": "MENTORING_LEADERSHIP", "Designed solution": "ARCHITECTURE", "Designed forms": "TASK_EXECUTION", "Attended meetings": "OTHER",
    }
    assert mapped(spark, want, rules.bullet_level) == want
    ranks = spark.createDataFrame([(r,) for r in (4, 3, 2, 1, 0, None)], "r int").select(rules.role_level(F.col("r")).alias("l")).collect()
    assert [r.l for r in ranks] == ["MENTORING_LEADERSHIP", "ARCHITECTURE", "OWNERSHIP", "TASK_EXECUTION", "TASK_EXECUTION", "TASK_EXECUTION"]


def test_date_forms(spark):
    want = {"Mar, 2020": D(2020, 1, 1), "Mar 2020": D(2020, 3, 1), "Sept. ’19": D(2019, 9, 1), "2020/05": D(2020, 5, 1), "5.2020": D(2020, 5, 1)}
    assert mapped(spark, want, dates.parse_date) == want
    open_ = {"Present": True, "till date": True, "tilldate": True, "to date": False, "till noon": False, "Now": True, "Jan 2020": False}
    assert mapped(spark, open_, dates.is_open_ended) == open_


def test_headings(spark):
    heads = {"Educational Qualification": "EDUCATION", "Key Projects": "PROJECTS", "Project": None, "Contact Info": "CONTACT", "WORK  HISTORY": None, " Skills": None, "o Skills": None, "Owner skills": "SKILLS"}
    assert mapped(spark, heads, rules.canonical_section) == heads
    shaped = {"Core Strengths": True, "CORE": True, "Core strengths": False, "Driver's License": False, "Born 1990": False, "A B C D E F": False, "Rome,": False, "Skills": False, "a@b": False, "": False}
    assert mapped(spark, shaped, rules.is_unrecognized_heading) == shaped


CHUNK = "resume_id int, sequence long, chunk_type string, company string, text string"


def test_prose_keeps_separators(spark):
    chunk = [(1, 0, "SUMMARY", None, "Spark, SQL and ASP.NET"), (1, 1, "PROJECT", None, "Spark SQL in C++/C#; x.NET .NET node.js-like"), (1, 2, "SUMMARY", None, "Ray and India")]
    names = spark.createDataFrame([(x,) for x in ("Spark", "Spark SQL", ".NET", "C++", "C#", "C", "Node.js", "Ray", "India", "A B C D E F G H")], "skill string")
    got = {(r.sequence, r.skill, r.text) for r in discovery.prose_mentions(spark.createDataFrame(chunk, CHUNK), names).collect()}
    assert got == {(0, "Spark", "Spark"), (1, "Spark SQL", "Spark SQL"), (1, "C++", "C++"), (1, "C#", "C#"), (1, ".NET", ".NET"), (1, "Node.js", "node.js"), (2, "India", "India")}
    kept = {r.skill for r in discovery.discover(spark.createDataFrame(chunk, CHUNK), names).collect()}
    assert kept == {"Spark", "Spark SQL", "C++", "C#", ".NET", "Node.js"}  # a place names no skill
    long = spark.createDataFrame([(1, 0, "SUMMARY", None, "a b c d e f g h")], CHUNK)
    assert [r.skill for r in discovery.prose_mentions(long, names).collect() if len(r.skill) > 3] == ["A B C D E F G H"]


def test_cascade(spark):
    names = spark.createDataFrame([("kubernetes", True, "K8S"), ("postgresql", True, None), ("mysql database", True, "postgresql"), ("cobol", False, None)], "entity string, active boolean, display string")
    aliases = spark.createDataFrame([("postgresql", "postgres"), ("cobol", "cbl")], "entity string, alias string")
    asked = spark.createDataFrame([(t,) for t in ("Kubernetes", "k8s", "PostGres", "kubernetis", "postgresqll", "cobol", "cbl", "PostgreSQL", "nothing")], "text string")
    near = spark.createDataFrame([("nothing", "kubernetes", 0.95), ("nothing", "postgresql", 0.9), ("kubernetis", "postgresql", 0.99), ("cbl", "postgresql", 0.93), ("cobol", "kubernetes", 0.5)], "text string, entity string, similarity double")
    got = {(r.text, r.rank): (r.entity, r.method, r.confidence, r.confident) for r in catalog.rank_candidates(asked, names, aliases, semantic=near).collect()}
    assert got == {
        ("Kubernetes", 1): ("kubernetes", "EXACT", 1.0, True), ("k8s", 1): ("kubernetes", "EXACT", 1.0, True), ("PostGres", 1): ("postgresql", "ALIAS", 0.97, True), ("PostgreSQL", 1): ("postgresql", "EXACT", 1.0, True),
        ("kubernetis", 1): ("postgresql", "SEMANTIC", 0.99, True), ("kubernetis", 2): ("kubernetes", "FUZZY", 0.9, False), ("postgresqll", 1): ("postgresql", "FUZZY", 0.9091, False),
        ("cbl", 1): ("postgresql", "SEMANTIC", 0.93, True), ("nothing", 1): ("kubernetes", "SEMANTIC", 0.95, False), ("nothing", 2): ("postgresql", "SEMANTIC", 0.9, False),
    }
    assert {r.text for r in catalog.resolve(asked, names, aliases, catalog.ROLES).where("confident and method = 'FUZZY'").collect()} == {"kubernetis", "postgresqll"}
    assert catalog.resolve_skills(spark.createDataFrame([("framework",)], "text string"), names, aliases).count() == 0


def test_ambiguous_skills_and_verdicts(spark):
    chunk = spark.createDataFrame([(i, 0, "SKILL_SECTION", None, "kubernetis, tensorfloww") for i in (1, 2, 3)], CHUNK)
    names = spark.createDataFrame([("kubernetes",), ("tensorflow",)], "skill string")
    answers = spark.createDataFrame([(2, '{"results": [{"detected_text": "kubernetis", "chosen_skill_id": null}, {"detected_text": "tensorfloww", "chosen_skill_id": "tensorflow"}, {"detected_text": "odd", "chosen_skill_id": "kubernetes"}]}'), (3, '{"results": [{"detected_text": "kubernetis", "chosen_skill_id": "tensorflow", "confidence": 0.9}]}'), (1, None), (1, "broken")], "resume_id int, answer string")
    given = discovery.parse_validations(answers)
    got = {(r.resume_id, r.skill): (r.text, round(r.confidence, 4), r.method) for r in discovery.discover(chunk, names, verdicts=given).collect()}
    fallback = {"kubernetes": ("kubernetis", 0.72, "FUZZY"), "tensorflow": ("tensorfloww", 0.7273, "FUZZY")}
    assert got == {(1, k): v for k, v in fallback.items()} | {(3, k): v for k, v in fallback.items()} | {(2, "tensorflow"): ("tensorfloww", 0.5, "MODEL_VALIDATED")}
    parts = discovery.section_parts(chunk.where("resume_id = 1"))
    ranked = catalog.resolve_skills(parts, names.select(F.col("skill").alias("entity")), spark.createDataFrame([], "entity string, alias string"))
    asked = discovery.validation_requests(discovery.ambiguous_mentions(parts, ranked), spark.createDataFrame([("kubernetes", "containers")], "skill string, description string")).first()
    assert json.loads(asked.request) == {"items": [{"detected_text": "kubernetis", "candidates": [{"canonical_name": "kubernetes", "description": "containers"}]}, {"detected_text": "tensorfloww", "candidates": [{"canonical_name": "tensorflow", "description": ""}]}]}


def test_evidence_verdicts(spark):
    graded = spark.createDataFrame([(1, "docker", 0, "NONE", "NONE", []), (1, "aws", 0, "WEAK", "SKILLS_SECTION_ONLY", [9]), (1, "spark", 2, "STRONG", "EXPLICIT_IMPLEMENTATION", [1, 2, 3, 4])], "resume_id int, skill string, sources int, strength string, kind string, evidence array<long>")
    hits = spark.createDataFrame([(1, "docker", 5, 0.5, "five"), (1, "docker", 4, 0.9, "four"), (1, "aws", 6, 0.4, "six"), (1, "spark", 7, 0.9, "x")], "resume_id int, skill string, sequence long, score double, text string")
    passages = verdicts.evidence_passages(graded, hits)
    assert json.loads(verdicts.evidence_requests(passages).first().request) == {"skills": [{"skill": "aws", "passages": [{"passage_index": 0, "text": "six"}]}, {"skill": "docker", "passages": [{"passage_index": 0, "text": "four"}, {"passage_index": 1, "text": "five"}]}]}
    schema = "resume_id int, skill string, strength string, passage_index int, explanation string"

    def rows(*given):
        checked = verdicts.checked_verdicts(spark.createDataFrame(list(given), schema), passages, verdicts.sibling_groups(spark))
        return {(r.skill, r.sequence, r.kind, r.strength, r.confidence) for r in verdicts.evidence_rows(verdicts.upgraded(graded, checked)).collect()}

    spark_rows = {("spark", k, "EXPLICIT_IMPLEMENTATION", "STRONG", 1.0) for k in (1, 2, 3)}
    own = {("aws", 9, "SKILLS_SECTION_ONLY", "WEAK", 1.0)}
    assert rows((1, "docker", "MODERATE", 1, "ran Docker"), (1, "spark", "WEAK", 0, ""), (1, "other", "WEAK", 0, "")) == spark_rows | own | {("docker", 5, "INFERRED", "MODERATE", 0.6)}
    assert rows((1, "docker", "WEAK", 8, None)) == spark_rows | own | {("docker", 4, "INFERRED", "WEAK", 0.6)}
    assert rows((1, "docker", "STRONG", 0, "")) == rows((1, "docker", "WEAK", 0, "used Kubernetes")) == spark_rows | own
    assert rows((1, "docker", "WEAK", 0, "Kubernetes and docker")) == spark_rows | own | {("docker", 4, "INFERRED", "WEAK", 0.6)}
    assert rows((1, "aws", "WEAK", None, "")) == spark_rows | own | {("aws", 6, "SKILLS_SECTION_ONLY", "WEAK", 0.6)}


def test_verification(spark):
    stored = spark.createDataFrame([(1, 0, "a", 0.85, "AUTO_CONFIRMED"), (1, 1, "b", 0.85, "AUTO_CONFIRMED"), (1, 2, "c", 0.85, "AUTO_CONFIRMED")], "resume_id int, row_id int, skill string, confidence double, status string")
    log = spark.createDataFrame([(1, 0, "correct", "z", 1), (1, 0, "confirm", None, 2), (1, 1, "remove", None, 1), (1, 2, "correct", "unknown", 1), (2, 0, "remove", None, 1)], "resume_id int, row_id int, action string, new_skill string, ts int")
    keys = ["resume_id", "row_id"]
    good, bad = review.checked_actions(log, stored, spark.createDataFrame([("z",)], "skill string"), keys)
    assert {(r.resume_id, r.row_id, r.reason) for r in bad.collect()} == {(1, 2, "unknown skill"), (2, 0, "unknown row")}
    got = {(r.row_id, r.skill, r.confidence, r.status, r.user_modified) for r in review.verified(stored, review.fold_actions(good, keys, ["ts"]), keys).collect()}
    assert got == {(0, "z", 1.0, "USER_CONFIRMED", True), (2, "c", 0.85, "AUTO_CONFIRMED", False)}


def test_intake_and_loading(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    good, bad = intake.intake(intake.load_files(spark, str(tmp_path / "in")))
    assert [r.path[-5:] for r in good.collect()] == ["a.pdf"] and [(r.path[-5:], r.reason) for r in bad.collect()] == [("c.txt", "type")]
    rows = spark.createDataFrame([("b.PDF", bytearray(), None), ("d", bytearray(b"x"), "application/pdf"), ("e.pdf", None, None), (None, bytearray(b"x"), None)], "path string, content binary, content_type string")
    good, bad = intake.intake(rows)
    assert [r.path for r in good.collect()] == ["d"] and {(r.path, r.reason) for r in bad.collect()} == {("b.PDF", "empty"), ("e.pdf", "empty"), (None, "type")}
    stored = spark.createDataFrame([(1, 0, "a", "t", 1.0, "EXACT", "AUTO_CONFIRMED", None, False), (1, 1, "b", "t", 1.0, "EXACT", "USER_REMOVED", [1], True)], "resume_id int, row_id int, skill string, text string, confidence double, method string, status string, chunks array<long>, user_modified boolean")
    assert [(r.canonical_name, r.source_chunk_ids) for r in intake.skill_view(intake.find(stored, "resume_id", 1)).collect()] == [("a", [])]
    documents = spark.createDataFrame([(1, "f.pdf", "FAILED", 2, "parse", "bad", None)], "id int, filename string, status string, page_count int, failed_stage string, failure_reason string, uploaded_at timestamp")
    assert intake.document_view(documents).first().resume_id == 1
    (tmp_path / "s.json").write_text('["x", "y"]')
    (tmp_path / "o.json").write_text('[{"name": "n", "aliases": ["p"], "abbreviations": null}]')
    assert [r.name for r in catalog.load_json(spark, str(tmp_path / "s.json"), "name string").collect()] == ["x", "y"]
    seed = catalog.load_json(spark, str(tmp_path / "o.json"), "name string, aliases array<string>, abbreviations array<string>, misspellings array<string>")
    assert [tuple(r) for r in catalog.alias_rows(seed, "name").collect()] == [("n", "p", "ALIAS")]
    assert [r.name for r in catalog.insert_missing(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("x",), ("q",), ("q",)], "name string"), "name").orderBy("name").collect()] == ["q", "x"]


def test_requests_and_documents(spark):
    key = "resume_id int"
    roles = spark.createDataFrame([(1, 2, "B", "T", D(2020, 1, 1), None, True, ["r"], []), (1, 1, "A", "S", None, None, False, [], ["x"])], f"{key}, place int, company string, title string, start_date date, end_date date, is_current boolean, responsibilities array<string>, technologies array<string>")
    gaps = spark.createDataFrame([(1, D(2019, 1, 31), D(2019, 9, 1), 8)], f"{key}, gap_start date, gap_end date, gap_months long")
    skills = spark.createDataFrame([(1, "b"), (1, "a")], f"{key}, skill string")
    asked = json.loads(narrative.growth_requests(spark.createDataFrame([(1,)], key), roles, skills, gaps).first().request)
    assert [r["company"] for r in asked["roles"]] == ["A", "B"] and asked["verified_skills"] == ["a", "b"] and asked["documented_gaps"] == [{"gap_start": "2019-01-31", "gap_end": "2019-09-01", "duration_months": 8}]
    row = spark.createDataFrame([(1, None, "T", "F", 30, True, None, False)], f"{key}, summary string, recent_title string, recent_family string, total_months long, certification boolean, project boolean, achievement boolean")
    assert json.loads(narrative.completeness_requests(row).first().request) == {"summary_text": "", "most_recent_title": "T", "most_recent_role_family": "F", "actual_total_years_experience": "2.5", "sections_absent": ["projects", "achievements"]}
    scores = spark.createDataFrame([(1, "COMPLETED", 1.0, 2.0, 3.0, 4.0, 10.0)], f"{key}, status string, completeness double, growth double, evidence double, experience double, total double")
    parts = spark.createDataFrame([(1, "growth", 1, "b", 0.5), (1, "growth", 0, "a", 1.5)], f"{key}, category string, place int, sub_dimension string, points double")
    advice = spark.createDataFrame([(1, 2, "t", "c", "d", "e")], f"{key}, priority int, title string, category string, description string, audience string")
    document = json.loads(narrative.result_documents(scores, parts, advice).first().document)
    assert document["sub_scores"]["growth"] == [{"sub_dimension": "a", "points": 1.5}, {"sub_dimension": "b", "points": 0.5}] and document["scores"]["total"] == 10.0 and document["recommendations"][0]["priority"] == 2
    body = scores.withColumns({"warnings": F.array(F.lit("w")), "observations": F.lit(None).cast("array<string>"), "highlights": F.array(F.lit("h")), "experience_sentence": F.lit("s")})
    assert json.loads(narrative.narrative_requests(body).first().request)["completeness_warnings"] == ["w"]
    stamped = narrative.stamped(scores)
    assert narrative.stale(stamped).count() == 0 and narrative.stale(stamped.withColumn("embedding_version", F.lit(None).cast("string"))).count() == 1
    failed = narrative.isolated(spark.createDataFrame([("1",), ("x",)], "t string"), "parse", F.expr("try_cast(t as int)"), F.concat(F.lit("bad "), F.repeat("t", 3000)))
    assert {(r.t, r.result, r.failed_stage, len(r.failure_reason or "")) for r in failed.collect()} == {("1", 1, None, 0), ("x", None, "parse", 2000)}


def test_boxes_and_pages(spark):
    rows = spark.createDataFrame([(1, 0, "well-", (1.0, 5.0, 0.0, 2.0)), (1, 1, "known", (0.0, 4.0, 2.0, 4.0))], "doc_id int, line_no int, text string, box struct<x0:double,x1:double,top:double,bottom:double>")
    merged = text.merge_hyphens(rows).first()
    assert merged.text == "well-known" and tuple(merged.box) == (0.0, 5.0, 0.0, 4.0)
    ids = text.block_ids(spark.createDataFrame([(7, 2, 0), (7, 1, 5)], "doc_id int, page int, line_no int")).orderBy("sequence").collect()
    assert [r.block_id for r in ids] == ["7:p1:b0", "7:p2:b1"]


def test_contradictions_and_scopes(spark):
    facts = spark.createDataFrame([(1, "A long enough summary of work", 0, 0)], "resume_id int, summary string, total_months int, claimed int")
    given = spark.createDataFrame([(1, True, True, None, [], ["x"] * 9)], "resume_id int, summary_outdated boolean, summary_generic boolean, summary_reason string, not_expected array<string>, contradictions array<string>")
    flags = {c: F.lit(False) for c in ("education", "project", "certification", "achievement")} | {c: F.lit(0.0) for c in ("detailed", "clear")} | {"contact": F.lit(""), "skills": F.lit(0), "roles": F.lit(1)}
    row = scoring.with_verdicts(facts, given).withColumns(flags).withColumn("warned", scoring.warnings()).withColumns(scoring.completeness()).first()
    assert (row.summary_quality, row.freshness_consistency) == (0.5, 1.5)
    assert row.warned[0] == "Summary appears outdated relative to current experience." and row.warned[-9:] == ["x"] * 9
    rows = spark.createDataFrame([(1, [1.0], D(2020, 1, 1), None), (2, None, None, None), (3, [1.0], None, D(2019, 1, 1)), (4, [1.0], D(2022, 1, 1), None)], "id int, vector array<double>, start_date date, end_date date")
    assert sorted(r.id for r in vectors.in_scope(rows, D(2020, 1, 1), D(2021, 1, 1)).collect()) == [1]
    assert sorted(r.id for r in vectors.in_scope(rows, id=3).collect()) == [3]


@pytest.mark.parametrize("name", sorted(vectors.PRESETS))
def test_presets(spark, name):
    rows = spark.createDataFrame([(i, 1, [1.0 - i / 50], "EXPERIENCE", "PROJECT") for i in range(40)], "id int, doc int, vector array<double>, section string, chunk_type string")
    asked = spark.createDataFrame([(0, 1, [1.0])], "query_id int, doc int, vector array<double>")
    assert vectors.preset_search(asked, rows, "doc", name).count() == vectors.PRESETS[name]["k"]
