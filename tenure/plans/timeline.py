"""Queries of the career timeline: intervals, seniority, bullets, experience scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.functions import dates, patterns, rules
from tenure.operators import intervals
from tenure.sources.careers import BULLETS, TITLES, TODAY, pick, sql_pick
from tenure.sources.tables import ROLES_SQL, read, role_intervals

def total_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_months(role_intervals(spark, sf_dir), "resume_id")


def role_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = intervals.months_inclusive(F.col("start"), F.col("end"))
    return role_intervals(spark, sf_dir).select("role_id", months.alias("months"), dates.month_label(months).alias("label"))


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = role_intervals(spark, sf_dir).groupBy("resume_id").agg(F.max("end").alias("last_end"), F.max_by("role_id", F.struct("end", "role_id")).alias("recent_role"))
    days = F.datediff(F.lit(TODAY), "last_end")
    score = F.when(days < 180, 4.0).otherwise(F.greatest(F.lit(0.0), 4.0 * (1 - days / (3 * 365.0))))
    return last.select("resume_id", "recent_role", days.cast("long").alias("days"), F.round(score.cast("decimal(18,8)"), 2).cast("double").alias("current_freshness"))


def career_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(role_intervals(spark, sf_dir), "resume_id", order=("role_id",))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = role_intervals(spark, sf_dir).withColumn("title", pick(TITLES, F.col("role_id"))).withColumn("own", rules.seniority(F.col("title")))
    rows = intervals.carry_forward(roles, "resume_id", F.col("own"), ["start", "role_id"], "Mid-Level", "level")
    place = F.row_number().over(Window.partitionBy("resume_id").orderBy(F.col("start").asc_nulls_first(), "role_id"))
    return rows.select("role_id", "title", "level", rules.ladder_place(F.col("level")).alias("level_id"), rules.seniority_confidence(F.col("title")).alias("confidence"), place.cast("long").alias("place"))


def bullet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(BULLETS, F.col("l_orderkey") + F.col("l_linenumber"))
    rank = F.coalesce(*[F.when(F.col("level") == name, r) for name, r, _ in rules.BULLETS], F.lit(0))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("role_id"), text.alias("text")).withColumn("level", rules.bullet_level(F.col("text"))).withColumn("rank", rank)
    return rows.groupBy("role_id").agg(
        F.count("*").alias("bullets"), rules.role_level(F.max("rank")).alias("role_level"), F.count_if(F.col("rank") == 4).alias("leadership"), F.count_if(F.col("rank") >= 2).alias("ownership"),
        F.count_if(F.col("text").rlike(patterns.METRIC)).alias("with_metric"),
    )


def experience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = role_intervals(spark, sf_dir)
    bullets = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("role_id")).agg(F.count("*").alias("n"))
    per = roles.join(bullets, "role_id", "left").groupBy("resume_id").agg(F.avg(F.coalesce("n", F.lit(0))).alias("depth"), F.avg(F.col("start").isNotNull().cast("int")).alias("dated"))
    per = per.join(intervals.union_months(roles, "resume_id"), "resume_id", "left")
    everyone = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id")).join(per, "resume_id", "left")
    r2 = lambda x: F.round(F.coalesce(x, F.lit(0.0)).cast("decimal(18,8)"), 2).cast("double")
    magnitude = 8 * (0.5 * F.col("dated") + 0.5 * F.least(F.lit(1.0), F.col("total_months") / 24.0))
    return everyone.select("resume_id", r2(magnitude).alias("documented_magnitude"), r2(5 * F.least(F.lit(1.0), F.col("depth") / 5)).alias("role_depth"))


QUERIES = {
    "dat5_exp11_total_experience": total_experience, "dat4_dat6_role_months": role_months, "dat7_exp13_scr4_recency": recency, "exp12_career_gaps": career_gaps,
    "exp6_exp7_exp10_levels": levels, "exp4_exp5_rec2_bullet_levels": bullet_levels, "scr1_scr2_scr6_experience_score": experience_score,
}

MONTHS = "((year({e}) - year({s})) * 12 + month({e}) - month({s}) + 1)"
_ROLES = ROLES_SQL.format(spread=36)
_UNION = f"""{_ROLES},
marked AS (SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY resume_id ORDER BY start_date, end_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM roles),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY resume_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT resume_id, island, min(start_date) AS s, max(end_date) AS e FROM numbered GROUP BY ALL),
totals AS (SELECT resume_id, CAST(sum({MONTHS.format(s="s", e="e")}) AS BIGINT) AS total_months FROM merged GROUP BY resume_id)"""
_R2 = "CAST(round(CAST({x} AS DECIMAL(18,8)), 2) AS DOUBLE)"
_LEVEL = rules.sql_case("lower(title)", rules.SENIORITY, f"CASE WHEN regexp_matches(lower(title), '{rules.AMBIGUOUS_TITLE}') THEN NULL ELSE 'Mid-Level' END")
_RANK = "CASE level " + " ".join(f"WHEN '{n}' THEN {r}" for n, r, _ in rules.BULLETS) + " ELSE 0 END"

ORACLES = {
    "dat5_exp11_total_experience": f"WITH {_UNION} SELECT * FROM totals",
    "dat4_dat6_role_months": f"""WITH {_ROLES}, m AS (SELECT role_id, CAST({MONTHS.format(s="start_date", e="end_date")} AS BIGINT) AS months FROM roles)
SELECT role_id, months, CASE WHEN months <= 0 THEN '0 months' ELSE concat_ws(' ', CASE WHEN months // 12 > 0 THEN (months // 12) || ' year' || CASE WHEN months // 12 > 1 THEN 's' ELSE '' END END,
  CASE WHEN months % 12 > 0 THEN (months % 12) || ' month' || CASE WHEN months % 12 > 1 THEN 's' ELSE '' END END) END AS label FROM m""",
    "dat7_exp13_scr4_recency": f"""WITH {_ROLES}, x AS (SELECT resume_id, max(end_date) AS last_end, arg_max(role_id, (end_date, role_id)) AS recent_role FROM roles GROUP BY 1),
d AS (SELECT *, date_diff('day', last_end, DATE '{TODAY}') AS days FROM x)
SELECT resume_id, recent_role, days, {_R2.format(x="CASE WHEN days < 180 THEN 4.0::DOUBLE ELSE greatest(0.0::DOUBLE, 4.0::DOUBLE * (1 - days / 1095.0::DOUBLE)) END")} AS current_freshness FROM d""",
    "exp12_career_gaps": f"""WITH {_ROLES}, n AS (SELECT *, lag(end_date) OVER (PARTITION BY resume_id ORDER BY start_date, end_date, role_id) AS p FROM roles)
SELECT resume_id, p AS gap_start, start_date AS gap_end, CAST({MONTHS.format(s="p", e="start_date")} - 1 AS BIGINT) AS gap_months FROM n WHERE start_date > p AND {MONTHS.format(s="p", e="start_date")} - 1 >= 6""",
    "exp6_exp7_exp10_levels": f"""WITH {_ROLES}, t AS (SELECT *, {sql_pick(TITLES, "role_id")} AS title FROM roles), o AS (SELECT *, {_LEVEL} AS own FROM t),
l AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY start_date, role_id ROWS UNBOUNDED PRECEDING), 'Mid-Level') AS level FROM o)
SELECT role_id, title, level, list_position({list(rules.LADDER)}, level)::BIGINT AS level_id,
  CASE title WHEN 'Developer' THEN 0.7::DOUBLE WHEN 'Project Head' THEN 0.3::DOUBLE WHEN 'Founder' THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
  row_number() OVER (PARTITION BY resume_id ORDER BY start_date NULLS FIRST, role_id) AS place FROM l""",
    "exp4_exp5_rec2_bullet_levels": f"""WITH b AS (SELECT l_orderkey AS role_id, {sql_pick(BULLETS, "(l_orderkey + l_linenumber)")} AS text FROM lineitem),
l AS (SELECT *, {rules.sql_case("lower(text)", rules.BULLETS, "'OTHER'")} AS level FROM b), r AS (SELECT *, {_RANK} AS rank FROM l)
SELECT role_id, count(*) AS bullets, CASE max(rank) WHEN 4 THEN 'MENTORING_LEADERSHIP' WHEN 3 THEN 'ARCHITECTURE' WHEN 2 THEN 'OWNERSHIP' ELSE 'TASK_EXECUTION' END AS role_level, count(*) FILTER (rank = 4) AS leadership, count(*) FILTER (rank >= 2) AS ownership,
  count(*) FILTER (text LIKE '%30!%%' ESCAPE '!') AS with_metric FROM r GROUP BY 1""",
    "scr1_scr2_scr6_experience_score": f"""WITH {_UNION}, b AS (SELECT l_orderkey AS role_id, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT resume_id, avg(coalesce(n, 0)) AS depth, avg(CASE WHEN start_date IS NULL THEN 0 ELSE 1 END) AS dated FROM roles LEFT JOIN b USING (role_id) GROUP BY 1)
SELECT c_custkey AS resume_id, {_R2.format(x="coalesce(8 * (0.5 * dated + 0.5 * least(1.0::DOUBLE, total_months / 24.0::DOUBLE)), 0)")} AS documented_magnitude,
  {_R2.format(x="coalesce(5 * least(1.0::DOUBLE, depth / 5), 0)")} AS role_depth FROM customer LEFT JOIN p ON c_custkey = resume_id LEFT JOIN totals USING (resume_id)""",
}
