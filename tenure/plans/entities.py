"""Queries of catalogs, vectors, verification, evidence and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.rules import GROWTH_LABELS, GROWTH_POINTS
from tenure.operators import catalog, review, topk, vectors
from tenure.sources.careers import pick
from tenure.sources.tables import read

ACTIONS = {"click": "confirm", "purchase": "correct", "error": "remove"}
LABELS = (*GROWTH_LABELS, "MISSING")


def _catalog(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("entity")).distinct()
    words = F.split("entity", " ")
    swapped = names.select("entity", F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("alias"))
    return names, swapped.join(names.select(F.col("entity").alias("alias")), "alias", "left_anti")


def resolve_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, aliases = _catalog(spark, sf_dir)
    p, n = F.col("p_name"), F.col("p_partkey") % 4
    words = F.split(p, " ")
    text = F.when(n == 0, p).when(n == 1, F.upper(F.replace(p, F.lit(" "), F.lit("-")))).when(n == 2, F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)))).otherwise(F.concat(F.substring(p, 1, 2), F.expr("substring(p_name, 4)")))
    return catalog.resolve(read(spark, sf_dir, "part").select(text.alias("text")), names, aliases)


def mixed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with words swapped, dropped and added and letters lost, resolved by the mixed ratio."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("entity")).distinct()
    p, w, n = F.col("p_name"), F.split("p_name", " "), F.col("p_partkey") % 6
    second, first = F.get(w, F.lit(1)), F.get(w, F.lit(0))
    text = F.when(n == 0, F.concat_ws(" ", second, first)).when(n == 1, second).when(n == 2, F.concat(p, F.lit(" of steel"))).when(n == 3, F.concat(F.substring(p, 1, 3), F.expr("substring(p_name, 5)"))).when(n == 4, F.concat(first, F.lit(" big "), second)).otherwise(F.initcap(p))
    none = names.select("entity", F.lit("").alias("alias")).limit(0)
    found = catalog.resolve(read(spark, sf_dir, "part").select(text.alias("text")), names, none, pool=catalog.fuzzy_pool(names, none, loose_names=False))
    return found.select("text", "entity", "method", "confidence", "confident")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", catalog.stable_id(F.concat_ws(":", F.lit("part"), F.col("p_partkey").cast("string"))).alias("vector_id"))


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("category"))
    return catalog.search(names, "name", "RING")


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    old, seed = p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return catalog.upsert(old, seed, "p_partkey")


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = read(spark, sf_dir, "customer").where("c_nationkey < 20")
    ok, bad = catalog.dangling(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), some, "o_custkey", "c_custkey")
    return ok.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.latest(read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    ok = F.coalesce(F.length("text") > 0, F.lit(False)) & (F.octet_length("text") <= 20 * 1024 * 1024)
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), ok.alias("accepted"))


def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest of its label."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    top, _ = topk.block_top_k(e.withColumnRenamed("id", "query_id"), e, "label", 5)
    return top.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def nearest_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest in the whole table: one hot scope, dealt into blocks."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("scope"), F.col("embedding").alias("vector"))
    top, _ = topk.block_top_k(e.withColumnRenamed("id", "query_id"), e, "scope", 10, least=0.2)
    return top.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.health(read(spark, sf_dir, "embeddings"), "label", "embedding")


def _log(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(*ACTIONS))
    k = F.get_json_object("props", "$.k").cast("long")
    action = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in ACTIONS.items()])
    return e.select(F.col("user_id").alias("resume_id"), (k % 10).alias("row_id"), action.alias("action"), F.concat(F.lit("skill"), k.cast("string")).alias("new_skill"), "ts", "event_id")


def verified_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold_actions(_log(spark, sf_dir), ["resume_id", "row_id"], ["ts", "event_id"])


def verified_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verified_skills(spark, sf_dir).where("status <> 'USER_REMOVED'")
    skill = F.coalesce("skill", F.concat(F.lit("row"), F.col("row_id").cast("string")))
    return rows.groupBy("resume_id").agg(F.count("*").alias("skills"), review.skill_fingerprint(skill, F.col("status")).alias("fingerprint"))


def _checked(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("resume_id")).distinct().withColumn("row_id", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("row_id", F.col("row_id").cast("long"))
    skills = spark.range(60).select(F.concat(F.lit("skill"), F.col("id").cast("string")).alias("skill"))
    return rows, *review.checked_actions(_log(spark, sf_dir), rows, skills, ["resume_id", "row_id"])


def refused_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[2].select("resume_id", "row_id", "event_id", "reason")


def verified_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, good, _ = _checked(spark, sf_dir)
    rows = rows.withColumn("skill", F.concat(F.lit("row"), F.col("row_id").cast("string"))).withColumn("confidence", F.lit(0.85)).withColumn("status", F.lit("AUTO_CONFIRMED"))
    keys = ["resume_id", "row_id"]
    return review.verified(rows, review.fold_actions(good, keys, ["ts", "event_id"]), keys).select(*keys, "status", "skill", "confidence", "user_modified")


def frozen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = pick(("SKILLS_IDENTIFIED", "WAITING_FOR_SKILL_VERIFICATION", "SKILLS_VERIFIED", "FAILED"), F.col("c_custkey"))
    documents = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), status.alias("status"))
    after, refused = review.freeze(documents, documents.where("resume_id % 3 = 0"))
    ready = review.ready(after).select("resume_id", F.lit(True).alias("ready"))
    rows = after.join(refused.select("resume_id", F.lit(True).alias("refused")), "resume_id", "left").join(ready, "resume_id", "left")
    return rows.select("resume_id", "status", F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce("ready", F.lit(False)).alias("ready"))


def salvaged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    body, n = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")), F.col("conv_id") % 4
    said = F.translate("text", "{}[]", "")
    raw = F.when(n == 0, body).when(n == 1, F.concat(said, body, said)).when(n == 2, F.concat(said, F.lit("["), F.col("turn").cast("string"), F.lit("]"), said)).otherwise(F.concat(said, F.lit("{broken")))
    return c.select("conv_id", "turn", review.salvage(raw).alias("json"))


def evidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{6,}"), F.lit(0)))
    hits = d.select(F.explode(tokens).alias("skill"), F.col("lang").alias("chunk_type"), F.col("source").alias("company"))
    return review.grade(hits, ["skill"])


def growth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), F.explode(F.sequence(F.lit(1), F.lit(len(GROWTH_POINTS)))).alias("dimension"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("resume_id") + F.col("dimension")) % 6 + 1).cast("int"))
    return review.growth_points(rows.withColumn("label", label), ["resume_id"])


def top_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return review.ranked(rows, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_extendedprice")], 4).select("l_orderkey", "l_extendedprice", "place")


QUERIES = {
    "cat1_to_cat11_resolve_mentions": resolve_mentions, "cat13_stable_ids": stable_ids, "cat12_catalog_search": catalog_search, "io5_io6_catalog_upsert": catalog_upsert,
    "io8_dangling_references": dangling_references, "run4_latest_order": latest_order, "io2_io3_content_fingerprints": content_fingerprints, "ret3_to_ret8_top_vectors": top_vectors, "ret4_ret8_nearest_of_all": nearest_of_all, "cat7_mixed_matches": mixed_matches,
    "ret10_vector_health": vector_health, "ver1_ver4_verified_skills": verified_skills, "ver2_ver3_refused_actions": refused_actions, "ver4_verified_set": verified_set, "ver5_frozen_documents": frozen_documents, "ver6_verified_fingerprints": verified_fingerprints, "llm1_salvaged_answers": salvaged_answers,
    "evd1_evd2_evidence_grades": evidence_grades, "scr17_growth_scores": growth_scores, "rec5_top_recommendations": top_recommendations,
}

_LOG = """log AS (SELECT user_id AS resume_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'correct' ELSE 'remove' END AS action, ts, event_id
  FROM events WHERE event_type IN ('click', 'purchase', 'error')),
folded AS (SELECT resume_id, k % 10 AS row_id, CASE arg_max(action, (ts, event_id)) WHEN 'remove' THEN 'USER_REMOVED' WHEN 'correct' THEN 'USER_CORRECTED' ELSE 'USER_CONFIRMED' END AS status,
  arg_max('skill' || k, (ts, event_id)) FILTER (action = 'correct') AS skill, true AS user_modified FROM log GROUP BY 1, 2)"""
_CHECKED = """,
known AS (SELECT * FROM log WHERE k % 10 < 7 AND NOT (action = 'correct' AND k >= 60)),
refolded AS (SELECT resume_id, k % 10 AS row_id, CASE arg_max(action, (ts, event_id)) WHEN 'remove' THEN 'USER_REMOVED' WHEN 'correct' THEN 'USER_CORRECTED' ELSE 'USER_CONFIRMED' END AS status,
  arg_max('skill' || k, (ts, event_id)) FILTER (action = 'correct') AS skill FROM known GROUP BY 1, 2),
stored AS (SELECT DISTINCT user_id AS resume_id, unnest(range(0, 7)) AS row_id FROM events)"""

ORACLES = {
    "cat1_to_cat11_resolve_mentions": r"""WITH names AS (SELECT DISTINCT p_name AS entity FROM part),
ali AS (SELECT entity, split_part(entity, ' ', 2) || ' ' || split_part(entity, ' ', 1) AS alias FROM names),
m AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '-')) WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE substr(p_name, 1, 2) || substr(p_name, 4) END AS text FROM part),
t AS (SELECT text, lower(regexp_replace(text, '[\s\-.]', '', 'g')) AS key FROM m),
x AS (SELECT lower(regexp_replace(entity, '[\s\-.]', '', 'g')) AS key, max(entity) AS entity FROM names GROUP BY 1),
a AS (SELECT lower(regexp_replace(alias, '[\s\-.]', '', 'g')) AS key, max(entity) AS entity FROM ali WHERE alias NOT IN (SELECT entity FROM names) GROUP BY 1),
f AS (SELECT t.key, p.entity, max(1 - levenshtein(t.key, p.key) / greatest(length(t.key), length(p.key))::DOUBLE) AS ratio FROM (SELECT DISTINCT key FROM t WHERE key NOT IN (SELECT key FROM x) AND key NOT IN (SELECT key FROM a)) t, (SELECT * FROM x UNION ALL SELECT * FROM a) p GROUP BY 1, 2 HAVING ratio >= 0.88),
r AS (SELECT *, row_number() OVER w AS r FROM f WINDOW w AS (PARTITION BY key ORDER BY ratio DESC, entity))
SELECT text, entity, 'EXACT' AS method, 1.0::DOUBLE AS confidence, true AS confident FROM t JOIN x USING (key)
UNION ALL SELECT text, entity, 'ALIAS', 0.97::DOUBLE, true FROM t JOIN a USING (key) WHERE key NOT IN (SELECT key FROM x)
UNION ALL SELECT text, entity, 'FUZZY', CAST(round(CAST(ratio AS DECIMAL(18,8)), 4) AS DOUBLE), ratio >= 0.92 FROM t JOIN r USING (key) WHERE r = 1""",
    "cat13_stable_ids": "SELECT p_partkey, CAST(('0x' || substr(sha256('part:' || p_partkey), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS vector_id FROM part",
    "cat12_catalog_search": "SELECT p_name AS name, min(p_type) AS category FROM part WHERE lower(p_name) LIKE '%ring%' GROUP BY 1 ORDER BY 1 LIMIT 20",
    "io5_io6_catalog_upsert": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0",
    "io8_dangling_references": "SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AS known FROM orders",
    "run4_latest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "io2_io3_content_fingerprints": "SELECT doc_id, sha256(text) AS content_hash, coalesce(length(text) > 0 AND strlen(text) <= 20971520, false) AS accepted FROM documents",
    "ret3_to_ret8_top_vectors": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, CAST(round(CAST(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS DECIMAL(18,8)), 4) AS DOUBLE) AS score
  FROM embeddings q JOIN embeddings e ON q.label = e.label)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""",
    "ret4_ret8_nearest_of_all": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, CAST(round(CAST(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS DECIMAL(18,8)), 4) AS DOUBLE) AS score FROM embeddings q, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10) SELECT * FROM t WHERE score >= 0.2""",
    "ret10_vector_health": "SELECT label, count(*) AS vectors, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1",
    "ver1_ver4_verified_skills": f"WITH {_LOG} SELECT *, CASE WHEN skill IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM folded",
    "ver2_ver3_refused_actions": f"WITH {_LOG} SELECT resume_id, k % 10 AS row_id, event_id, CASE WHEN k % 10 >= 7 THEN 'unknown row' ELSE 'unknown skill' END AS reason FROM log WHERE k % 10 >= 7 OR (action = 'correct' AND k >= 60)",
    "ver4_verified_set": f"WITH {_LOG}{_CHECKED} SELECT s.resume_id, s.row_id, coalesce(r.status, 'AUTO_CONFIRMED') AS status, coalesce(r.skill, 'row' || s.row_id) AS skill, CASE WHEN r.skill IS NULL THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS confidence, r.status IS NOT NULL AS user_modified FROM stored s LEFT JOIN refolded r ON s.resume_id = r.resume_id AND s.row_id = r.row_id WHERE coalesce(r.status, '') <> 'USER_REMOVED'",
    "ver5_frozen_documents": """SELECT c_custkey AS resume_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 2 THEN 'SKILLS_VERIFIED' ELSE ['SKILLS_IDENTIFIED', 'WAITING_FOR_SKILL_VERIFICATION', 'SKILLS_VERIFIED', 'FAILED'][c_custkey % 4 + 1] END AS status,
  c_custkey % 3 = 0 AND c_custkey % 4 >= 2 AS refused, c_custkey % 4 = 2 OR (c_custkey % 3 = 0 AND c_custkey % 4 < 2) AS ready FROM customer""",
    "ver6_verified_fingerprints": f"WITH {_LOG} SELECT resume_id, count(*) AS skills, sha256(string_agg(coalesce(skill, 'row' || row_id) || ':' || status, '|' ORDER BY coalesce(skill, 'row' || row_id) || ':' || status)) AS fingerprint FROM folded WHERE status <> 'USER_REMOVED' GROUP BY 1",
    "llm1_salvaged_answers": """SELECT conv_id, turn, CASE conv_id % 4 WHEN 3 THEN NULL WHEN 2 THEN '[' || turn || ']' ELSE '{"turn": ' || turn || '}' END AS json FROM conversations""",
    "evd1_evd2_evidence_grades": r"""WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS skill, lang, source FROM documents), n AS (SELECT skill, count(*) AS sources FROM h GROUP BY 1)
SELECT skill, sources, CASE WHEN sources >= 2 THEN 'STRONG' ELSE 'MODERATE' END AS strength, CASE WHEN sources >= 2 THEN 'EXPLICIT_IMPLEMENTATION' ELSE 'RESPONSIBILITY_USAGE' END AS kind FROM n""",
    "scr17_growth_scores": """WITH d AS (SELECT c_custkey AS resume_id, unnest(range(1, 10)) AS dim FROM customer)
SELECT resume_id, CAST(round(CAST(sum([4, 5, 4, 3, 3, 2, 2, 1, 1][dim] * [0, 0.25, 0.5, 0.8, 1, 0][(resume_id + dim) % 6 + 1]) AS DECIMAL(18,8)), 2) AS DOUBLE) AS growth FROM d GROUP BY 1""",
    "rec5_top_recommendations": "SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem QUALIFY place <= 4",
}
