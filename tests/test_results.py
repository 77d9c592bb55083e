"""Commits of result tables, re-indexing, catalog roles, pages, stages and the trie scan."""

import pytest
from pyspark.sql import functions as F

from tenure.functions import rules
from tenure.operators import discovery, narrative, roles, sink, text
from tenure.plans import registry


def test_readers_get_all_tables_of_a_commit_or_none(spark, tmp_path):
    path = str(tmp_path / "results")
    first = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v2")], "id int, x string, scoring_version string")
    assert sink.write_results(path, evaluations=first, totals=first.select("id", "scoring_version")) == 1
    read = lambda name, **o: sorted(map(tuple, sink.read_results(spark, path, name, **o).collect()))
    assert read("evaluations") == [(1, "a", "v1"), (2, "b", "v2")]
    # the second table fails after the first is written: nothing of the run is seen
    bad = first.select("id", F.raise_error(F.lit("broken")).cast("string").alias("x"), "scoring_version")
    with pytest.raises(Exception, match="broken"):
        sink.write_results(path, evaluations=first.withColumn("x", F.lit("new")), totals=bad)
    assert sink.commit_number(spark, path) == 1 and read("evaluations") == [(1, "a", "v1"), (2, "b", "v2")]
    # a version that is written replaces that version alone; earlier commits stay readable
    sink.write_results(path, evaluations=first.where("id = 2").withColumn("x", F.lit("c")))
    assert read("evaluations") == [(1, "a", "v1"), (2, "c", "v2")] and read("evaluations", number=1) == [(1, "a", "v1"), (2, "b", "v2")] and len(read("totals")) == 2
    # another run took the number meanwhile
    with pytest.raises(RuntimeError, match="another run"):
        sink._commit(spark, path, 2, {})
    with pytest.raises(Exception, match="no committed table"):
        sink.read_results(spark, path, "other")
    sink.write_results(path, plain=spark.createDataFrame([(7,)], "id int"))
    assert read("plain") == [(7, narrative.VERSIONS["scoring_version"])]


def test_only_stale_rows_are_embedded_anew(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(8)], "id int, vector array<double>")
    sink.write_index(rows.where("id < 3"), path, {**narrative.VERSIONS, "chunking_version": "chunking-v0"})
    sink.write_index(rows.where("id >= 3"), path)
    index, anew = sink.reindex(spark, path, lambda df: df.withColumn("vector", F.array(F.lit(-1.0))))
    assert sorted(r.id for r in anew.collect()) == [0, 1, 2]
    assert sorted((r.id, r.vector[0], r.chunking_version) for r in index.collect()) == [(i, -1.0 if i < 3 else float(i), "chunking-v1") for i in range(8)]
    plan = anew._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chunking_version" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_catalog_roles(spark):
    rows = spark.createDataFrame([(1, 1, "Head"), (1, 2, "Lead Engineer"), (1, 3, "Owner"), (1, 4, "Unknown"), (1, 5, "developper"), (2, 1, "Founder"), (2, 2, "VP Sales")], "resume_id int, place int, title string")
    known = spark.createDataFrame([("r1", "Developer", "Eng", "Senior"), ("r2", "Lead Engineer", "Eng", None)], "entity string, title string, family string, level string")
    aliases = spark.createDataFrame([("r2", "Chief of Engineers")], "entity string, alias string")
    got = {(r.resume_id, r.place): (r.role_id, r.family, r.level, r.level_source, r.ambiguous) for r in roles.with_catalog_roles(rows, known, aliases).collect()}
    assert got == {
        (1, 1): (None, None, "Mid-Level", "inherited", True), (1, 2): ("r2", "Eng", "Lead", "rule", False), (1, 3): (None, None, "Lead", "inherited", True), (1, 4): (None, None, None, "none", False),
        (1, 5): ("r1", "Eng", "Senior", "catalog", False), (2, 1): (None, None, "Mid-Level", "inherited", True), (2, 2): (None, None, "VP", "rule", False),
    }


def test_pages_keep_apart(spark):
    words = spark.createDataFrame([(1, 1, 0, 5, 0.0, 8.0, "one"), (1, 2, 6, 9, 0.0, 8.0, "two"), (1, 1, 6, 9, 0.0, 8.4, "more")], "doc_id int, page int, x0 int, x1 int, top double, bottom double, text string")
    assert {(r.page, r.text) for r in text.cluster_words(words, ["doc_id", "page"]).collect()} == {(1, "one more"), (2, "two")}
    lines = spark.createDataFrame([(1, 1, 0, "well-"), (1, 1, 1, "known-"), (1, 2, 2, "fact")], "doc_id int, page int, line_no int, text string")
    assert {(r.page, r.text) for r in text.merge_hyphens(lines, ["doc_id", "page"]).collect()} == {(1, "well-known-"), (2, "fact")}
    assert [r.text for r in text.merge_hyphens(lines).collect()] == ["well-known-fact"]
    rows = spark.createDataFrame([(1, 1, 0, "Ann"), (1, 1, 1, "Skills"), (1, 2, 2, "Java"), (1, 2, 3, "Education"), (1, 3, 4, "Interests"), (1, 3, 5, "Chess")], "resume_id int, page int, line_no int, text string")
    assert [(r.place, r.section, r.page, r.blocks) for r in text.sections(rows, page="page").orderBy("place").collect()] == [(0, "CONTACT", 1, [0]), (1, "SKILLS", 1, [2]), (2, "INTERESTS", 3, [5])]


def test_headings_by_phrases(spark):
    known = {
        "Educational Qualification": "EDUCATION", "Internal Platform Tool": None, "Technologies": "SKILLS", "Major Project": None, "Projects": "PROJECTS", "Career History": "EXPERIENCE", "career  history": None, "Career-History": None,
        "MY EDUCATIONS": "EDUCATION", "Coeducation": None, "Summary of Experience": "EXPERIENCE", "Skills_2": None, "(Skills)": "SKILLS", "About Me:": "SUMMARY", "About": None, "• Skills": None, "": None, "  Hobbies　": "INTERESTS",
        "Personal Information": "CONTACT", "Information": None, "x" * 55 + " TOOLS": None, "x" * 54 + " TOOLS": "SKILLS", "Skills/Tools": "SKILLS",
    }
    df = spark.createDataFrame([(k, v) for k, v in known.items()] + [(None, None)], "line string, want string")
    wrong = df.withColumn("got", rules.canonical_section(F.col("line"))).where("not (got <=> want)").collect()
    assert not wrong, wrong


def test_prose_by_trie(spark):
    names = spark.createDataFrame([(n,) for n in ("Java", "java script", "Node.js", "C++", ".NET", "Spark", "spark SQL", "spark sql server", "go", "red ring")], "skill string")
    lines = {
        "Used JAVA Script and java": [("java script", "JAVA Script"), ("Java", "java")], "javascript, Javas": [], "node.js/C++ on .net": [("Node.js", "node.js"), ("C++", "C++"), (".NET", ".net")], "asp.net": [],
        "Spark SQL servers": [("spark SQL", "Spark SQL")], "spark sql server": [("spark sql server", "spark sql server")], "spark sparks": [("Spark", "spark")], "go red ring": [("red ring", "red ring")], "red": [], "": [],
    }
    chunked = spark.createDataFrame([(1, i, "SUMMARY", t) for i, t in enumerate(lines)] + [(1, 99, "EDUCATION", "Java"), (1, 100, "SUMMARY", None)], "resume_id int, sequence long, chunk_type string, text string")
    got = {}
    for r in discovery.prose_mentions(chunked, names).orderBy("sequence", "place").collect():
        got.setdefault(r.sequence, []).append((r.skill, r.text))
    assert got == {i: v for i, v in enumerate(lines.values()) if v}
    assert discovery.prose_mentions(chunked, names.limit(0)).count() == 0


def test_discover_is_planned_in_stages(spark):
    chunked = spark.createDataFrame([(1, 0, "SKILL_SECTION", "Java, Jva, COBOL"), (1, 1, "SUMMARY", "java work")], "resume_id int, sequence long, chunk_type string, text string")
    found = discovery.discover(chunked, spark.createDataFrame([("Java",), ("Scala",)], "skill string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert [(r.skill, r.chunks) for r in found.collect()] == [("Java", [0, 1])]


def test_listed_words_are_clustered_without_a_shuffle(spark):
    words = [(1, 2, 0, 5, 1.0, 9.0, "b"), (1, 1, 0, 5, -8.0, -1.0, "x"), (1, 1, 9, 12, 2.0, 10.0, "c"), (1, 1, 0, 4, 0.0, 8.4, "a"), (1, 1, 5, 7, 0.0, 8.0, ""), (1, 3, 0, 1, 0.0, 50.0, " "), (2, 1, 0, 3, 0.0, 1.0, "one"), (None, 1, 0, 3, 0.0, 1.0, "none"), (None, 1, 4, 9, 0.0, 0.5, "too")]
    rows = spark.createDataFrame(words, "doc_id int, page int, x0 int, x1 int, top double, bottom double, text string")
    lists = lambda *by: rows.groupBy("doc_id", *by).agg(F.collect_list(F.struct("page", "x0", "x1", "top", "bottom", "text")).alias("words"))
    for page in (None, "page"):
        keys = ["doc_id", page] if page else ["doc_id"]
        expected = sorted(map(str, text.cluster_words(rows, keys).select(*keys, F.col("line_key").cast("int"), "text", "box", "n_words").collect()))
        for given in (lists(), lists("page")):  # a row a document, and several
            got = text.cluster_listed_words(given, page=page).select(*keys, F.col("line_key").cast("int"), "text", "box", "n_words")
            assert sorted(map(str, got.collect())) == expected and len(expected) >= 4
    for name in ("txt1_txt2_word_lines", "txt1_txt2_page_word_lines"):
        assert "Exchange" not in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_plausible_texts_take_each_distinct_line_apart_once(spark):
    plan = registry.queries()["cat4_plausible_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate explode") < plan.index("Aggregate [text#")
