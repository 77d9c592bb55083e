"""Queries of vectors, catalog candidates and intake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators import catalog, intake, vectors
from tenure.sources.tables import read


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks: the label is the document; dates follow the id."""
    n = F.col("vec_id")
    start = F.date_add(F.lit(dt.date(2000, 1, 1)), n.cast("int"))
    return read(spark, sf_dir, "embeddings").select(
        n.alias("id"), "label", F.when(n % 11 != 0, F.col("embedding")).alias("vector"), F.when(n % 3 == 0, "EXPERIENCE").otherwise("PROJECTS").alias("section"),
        F.when(n % 3 == 0, "EXPERIENCE_RESPONSIBILITY").otherwise("PROJECT").alias("chunk_type"), F.when(n % 7 != 0, start).alias("start_date"), F.when(n % 5 != 0, F.date_add(start, 30)).alias("end_date"),
    )


def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 13 == 0, F.slice("vector", 1, 10)).when(F.col("id") % 17 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.transform("vector", lambda x: x * 3)))
    good, bad = vectors.checked(rows, "vector", 64)
    v = vectors.normalized(F.col("vector"))
    good = good.select("id", F.round(vectors.dot(v, v).cast("decimal(18,8)"), 4).cast("double").alias("norm"))
    return good.unionByName(bad.select("id", F.lit(-1.0).alias("norm")))


def preset_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vector is not null").select(F.col("id").alias("query_id"), "label", "vector")
    hits = vectors.preset_search(asked, rows, "label", "skill_evidence", date_from=dt.date(2000, 3, 1), date_to=dt.date(2001, 3, 1), section="PROJECTS")
    return vectors.hydrated(hits, rows).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "section", "chunk_type", F.coalesce(F.col("end_date").cast("string"), F.lit("open")).alias("until"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    fifth = e.where("id % 5 = 0")
    new = fifth.withColumn("version", F.lit(1)).unionByName(fifth.where("id % 10 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"), F.lit(2).alias("version")))
    out = vectors.upserted(e.withColumn("version", F.lit(0)), new, e.where("id % 7 = 0"))
    return out.select("id", "version", F.round(F.get("vector", F.lit(0)).cast("double").cast("decimal(18,8)"), 4).cast("double").alias("first"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    index = rows.where("vector is not null").select("id", F.lit("chunks").alias("domain")).unionByName(rows.select("id", F.lit("skills").alias("domain")))
    out = vectors.with_provenance(vectors.not_indexed(rows, index, "chunks").withColumn("vector", F.array(F.lit(0.0))), "embedder", "v1")
    return out.select("id", "label", "embedding_model", "embedding_version", "embedding_dimension")


def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the mean vectors of the labels of its domain (id modulo 4)."""
    e = read(spark, sf_dir, "embeddings").withColumn("domain", F.col("vec_id") % 4)
    each = e.select("domain", "label", F.posexplode("embedding").alias("i", "x")).groupBy("domain", "label", "i").agg(F.round(F.avg(F.col("x").cast("double")).cast("decimal(18,8)"), 6).cast("double").alias("x"))
    means = each.groupBy("domain", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    means = means.select(F.col("label").alias("id"), "domain", vectors.normalized(F.col("vector")).alias("vector"))
    asked = e.select(F.col("vec_id").alias("query_id"), "domain", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    hits = vectors.scoped_top_k(asked, means, "domain", 5, catalog.SKILLS.semantic)
    return hits.select("query_id", F.col("id").alias("entity"), "score", F.col("rank").cast("long").alias("rank"))


def catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", catalog.catalog_text(F.col("p_name"), "Category", F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))).alias("text"))


def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_name")
    seed = read(spark, sf_dir, "part").select(
        "p_partkey", F.split(p, " ").alias("aliases"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.substring(p, 1, 3))).alias("abbreviations"), F.array(F.concat(p, F.lit("x"))).alias("misspellings")
    )
    return catalog.alias_rows(seed, "p_partkey")


def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = read(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return catalog.replace_children(lines, new, "l_orderkey")


def counted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_counts({n: read(spark, sf_dir, n) for n in ("nation", "part", "customer", "orders", "lineitem")})


def canonical_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as titles, resolved with the cutoffs of roles; one of five is inactive and another only has its display name."""
    named = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("title")).distinct()
    roles = named.select(F.concat(F.lit("role "), F.substring("title", 1, 1)).alias("entity"), (F.substring("title", 1, 1) != "5").alias("active"), F.when(F.substring("title", 1, 1) != "4", F.col("title")).alias("display"))
    aliases = roles.where("entity = 'role 4'").select("entity", F.lit("4 not specified").alias("alias"))
    found = catalog.resolve(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("text")), roles, aliases, catalog.ROLES)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text")).join(found.where("confident"), "text", "left")
    return rows.select("o_orderkey", F.coalesce("entity", F.lit("none")).alias("canonical"), F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    files = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), n.cast("string"), F.when(n % 3 == 0, ".PDF").otherwise(".txt")).alias("path"), F.when(n % 3 == 1, "application/pdf").alias("content_type"), F.when(n % 5 != 0, F.col("text")).cast("binary").alias("content"))
    good, bad = intake.intake(files)
    return good.select("doc_id", F.lit("accepted").alias("outcome"), "content_hash").unionByName(bad.select("doc_id", F.col("reason").alias("outcome"), F.lit("").alias("content_hash")))


QUERIES = {
    "ret1_ret2_checked_vectors": checked_vectors, "ret3_ret5_ret6_ret7_ret9_preset_searches": preset_searches, "io10_vector_upsert": vector_upsert, "ret11_ret12_missing_vectors": missing_vectors,
    "cat8_semantic_candidates": semantic_candidates, "cat14_catalog_texts": catalog_texts, "io7_alias_rows": alias_rows, "io9_replaced_children": replaced_children, "io14_counted_tables": counted_tables,
    "cat2_cat3_exp8_canonical_roles": canonical_roles, "io2_io3_intake": taken_in,
}

_ROUND4 = "CAST(round(CAST({x} AS DECIMAL(18,8)), 4) AS DOUBLE)"
_V = """v AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 11 <> 0 THEN embedding::DOUBLE[] END AS vector, CASE WHEN vec_id % 3 = 0 THEN 'EXPERIENCE' ELSE 'PROJECTS' END AS section,
  CASE WHEN vec_id % 3 = 0 THEN 'EXPERIENCE_RESPONSIBILITY' ELSE 'PROJECT' END AS chunk_type, CASE WHEN vec_id % 7 <> 0 THEN DATE '2000-01-01' + vec_id::INT END AS start_date,
  CASE WHEN vec_id % 5 <> 0 THEN DATE '2000-01-01' + vec_id::INT + 30 END AS end_date FROM embeddings)"""

ORACLES = {
    "ret1_ret2_checked_vectors": f"WITH {_V} SELECT id, CASE WHEN vector IS NULL OR id % 13 = 0 THEN -1.0::DOUBLE WHEN id % 17 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM v",
    "ret3_ret5_ret6_ret7_ret9_preset_searches": f"""WITH {_V}, s AS (SELECT q.id AS query_id, e.id, {_ROUND4.format(x="list_inner_product(q.vector, e.vector)")} AS score, e.section, e.chunk_type, coalesce(CAST(e.end_date AS VARCHAR), 'open') AS until
  FROM v q JOIN v e ON q.label = e.label WHERE q.vector IS NOT NULL AND e.vector IS NOT NULL AND e.section = 'PROJECTS' AND (e.end_date IS NULL OR e.end_date >= DATE '2000-03-01') AND (e.start_date IS NULL OR e.start_date <= DATE '2001-03-01')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank, section, chunk_type, until FROM r WHERE rank <= 5 AND score >= 0.3""",
    "io10_vector_upsert": f"SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 2 WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS version, {_ROUND4.format(x='CASE WHEN vec_id % 10 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END')} AS first FROM embeddings WHERE vec_id % 7 <> 0",
    "ret11_ret12_missing_vectors": "SELECT vec_id AS id, label, 'embedder' AS embedding_model, 'v1' AS embedding_version, 1 AS embedding_dimension FROM embeddings WHERE vec_id % 11 = 0",
    "cat8_semantic_candidates": f"""WITH x AS (SELECT vec_id % 4 AS domain, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT domain, label, i, CAST(round(CAST(avg(x) AS DECIMAL(18,8)), 6) AS DOUBLE) AS x FROM x GROUP BY 1, 2, 3), n AS (SELECT domain, label, list(x ORDER BY i) AS v FROM m GROUP BY 1, 2),
s AS (SELECT vec_id AS query_id, n.label AS entity, {_ROUND4.format(x="list_inner_product(embedding::DOUBLE[], v) / sqrt(list_inner_product(v, v))")} AS score FROM embeddings JOIN n ON vec_id % 4 = domain),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM s) SELECT * FROM r WHERE rank <= 5 AND score >= 0.55""",
    "cat14_catalog_texts": "SELECT p_partkey, trim(p_name || '. Category: ' || CASE WHEN p_size % 5 <> 0 THEN p_type ELSE '' END || '. ' || CASE WHEN p_size % 3 <> 0 THEN p_brand ELSE '' END) AS text FROM part",
    "io7_alias_rows": """SELECT p_partkey, unnest(string_split(p_name, ' ')) AS alias, 'ALIAS' AS kind FROM part UNION ALL SELECT p_partkey, substr(p_name, 1, 3), 'ABBREVIATION' FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, p_name || 'x', 'MISSPELLING' FROM part""",
    "io9_replaced_children": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) UNION ALL SELECT o_orderkey, 1, 0.0::DOUBLE FROM orders WHERE o_orderkey % 10 = 0",
    "io14_counted_tables": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS \"rows\" FROM {n}" for n in ("nation", "part", "customer", "orders", "lineitem")),
    "cat2_cat3_exp8_canonical_roles": """SELECT o_orderkey, CASE o_orderpriority[1] WHEN '5' THEN 'none' ELSE 'role ' || o_orderpriority[1] END AS canonical, CASE o_orderpriority[1] WHEN '5' THEN 'none' WHEN '4' THEN 'ALIAS' ELSE 'EXACT' END AS method,
  CASE o_orderpriority[1] WHEN '5' THEN 0.0::DOUBLE WHEN '4' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM orders""",
    "io2_io3_intake": """WITH f AS (SELECT doc_id, doc_id % 3 <> 2 AS typed, CASE WHEN doc_id % 5 <> 0 THEN text END AS c FROM documents),
r AS (SELECT *, CASE WHEN NOT typed THEN 'type' WHEN coalesce(strlen(c), 0) = 0 THEN 'empty' WHEN strlen(c) > 20971520 THEN 'size' ELSE 'accepted' END AS outcome FROM f)
SELECT doc_id, outcome, CASE WHEN outcome = 'accepted' THEN sha256(c) ELSE '' END AS content_hash FROM r""",
}
