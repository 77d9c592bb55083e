"""Career documents that Spark derives from the given tables, line by line, and the same lines for DuckDB.

A customer is a document; each of its orders is a role with an anchor line, a title, a bullet per line item and a technology line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.sources.tables import ROLES_SQL, read, role_intervals

TODAY = dt.date(2004, 12, 31)
TITLES = ("Software Intern", "Junior Developer", "Senior Manager", "Project Head", "Staff Engineer", "Vice President", "Head of Data", "Developer", "Founder", "Lead Engineer", "Solution Architect")
BULLETS = ("Developed reports", "Owned the billing service", "Architected the platform", "Mentored two juniors", "Attended meetings", "Improved latency by 30%")
TOOLS = ("Java", "Scala", "Kafka")
_LAST = 1_000_000_000_000_000


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} % {len(values)} AS INTEGER) + 1)"


def career_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resume_id, line_no, text)."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), "c_name", "c_mktsegment")
    c = c.join(part, F.col("resume_id") == F.col("p_partkey"), "left")
    key, name = F.col("resume_id"), F.coalesce("p_name", F.lit("none"))
    claim = F.concat(F.lit("Engineer with more than "), (key % 20).cast("string"), F.lit(" years of experience in "), F.lower("c_mktsegment"), F.lit(" and a habit of finishing work"))
    fixed = (
        (0, F.when(key % 3 == 0, F.concat(F.lit("Ann Number"), F.translate("c_name", "0123456789#", "abcdefghij "))).otherwise(F.col("c_name"))), (1, F.when(key % 4 == 0, "Somewhere").otherwise("Phone (555) 555-0100")),
        (2, F.lit("Professional Summary")), (3, claim), (4, F.lit("Work History")),
        (_LAST, F.lit("Skills")), (_LAST + 1, F.concat(name, F.lit(", "), F.upper(F.replace(name, F.lit(" "), F.lit("-"))), F.lit("; Team Player, red ring, 2019"))),
        (_LAST + 2, F.lit("Education")), (_LAST + 3, F.lit("State College, 1990")), (_LAST + 4, F.lit("- Studied statistics.")), (_LAST + 5, F.lit("Evening School")),
    )
    lines = c.select("resume_id", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), t.alias("text")) for n, t in fixed])).alias("x")).select("resume_id", "x.*")
    role = F.col("role_id")
    until = F.when(role % 36 == 35, "Present").otherwise(F.date_format("end", "MMM yyyy"))
    anchor = F.concat(F.lit("Client: Firm "), (role % 7).cast("string"), F.lit(" "), F.date_format("start", "MMM yyyy"), F.lit(" - "), until)
    in_role = ((0, anchor), (1, F.concat(F.lit("Role: "), pick(TITLES, role))), (2, F.lit("Responsibilities:")), (90, F.concat(F.lit("Environment: Spark, SQL and "), pick(TOOLS, role))))
    at = role * 100 + 1000
    roles = role_intervals(spark, sf_dir).select("resume_id", F.explode(F.array(*[F.struct((at + n).alias("line_no"), t.alias("text")) for n, t in in_role])).alias("x")).select("resume_id", "x.*")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    items = items.join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("resume_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    used = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" for "), F.coalesce("p_name", F.lit("none")))).otherwise("")
    bullets = items.select("resume_id", (F.col("l_orderkey") * 100 + 1010 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("- "), pick(BULLETS, F.col("l_orderkey") + F.col("l_linenumber")), used).alias("text"))
    return lines.unionByName(roles).unionByName(bullets)


_FIXED = f"""unnest([0, 1, 2, 3, 4, {_LAST}, {_LAST + 1}, {_LAST + 2}, {_LAST + 3}, {_LAST + 4}, {_LAST + 5}]) AS line_no, unnest([
  CASE WHEN c_custkey % 3 = 0 THEN 'Ann Number' || translate(c_name, '0123456789#', 'abcdefghij ') ELSE c_name END, CASE WHEN c_custkey % 4 = 0 THEN 'Somewhere' ELSE 'Phone (555) 555-0100' END,
  'Professional Summary', 'Engineer with more than ' || (c_custkey % 20) || ' years of experience in ' || lower(c_mktsegment) || ' and a habit of finishing work', 'Work History', 'Skills',
  coalesce(p_name, 'none') || ', ' || upper(replace(coalesce(p_name, 'none'), ' ', '-')) || '; Team Player, red ring, 2019', 'Education', 'State College, 1990', '- Studied statistics.', 'Evening School']) AS text"""
#: Common table expressions roles, bullets (resume_id, role_id, n, text) and career (the lines).
CAREER_SQL = f"""{ROLES_SQL.format(spread=36)},
titled AS (SELECT *, 'Firm ' || (role_id % 7) AS company, {sql_pick(TITLES, "role_id")} AS title, role_id % 36 = 35 AS is_current, {sql_pick(TOOLS, "role_id")} AS tool FROM roles),
bullets AS (SELECT o_custkey AS resume_id, l_orderkey AS role_id, l_linenumber AS n, p_name,
  {sql_pick(BULLETS, "(l_orderkey + l_linenumber)")} || CASE WHEN l_linenumber % 2 = 0 THEN ' for ' || coalesce(p_name, 'none') ELSE '' END AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
career AS (SELECT c_custkey AS resume_id, {_FIXED} FROM customer LEFT JOIN part ON p_partkey = c_custkey
  UNION ALL SELECT resume_id, role_id * 100 + 1000, 'Client: ' || company || ' ' || strftime(start_date, '%b %Y') || ' - ' || CASE WHEN is_current THEN 'Present' ELSE strftime(end_date, '%b %Y') END FROM titled
  UNION ALL SELECT resume_id, role_id * 100 + 1001, 'Role: ' || title FROM titled
  UNION ALL SELECT resume_id, role_id * 100 + 1002, 'Responsibilities:' FROM titled
  UNION ALL SELECT resume_id, role_id * 100 + 1090, 'Environment: Spark, SQL and ' || tool FROM titled
  UNION ALL SELECT resume_id, role_id * 100 + 1010 + n, '- ' || text FROM bullets)"""
