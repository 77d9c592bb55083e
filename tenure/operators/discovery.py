"""Skills of career documents: mentions in chunks, ambiguous ones and verdicts on them, consolidation, evidence grades.

Verdicts of a model are a table; what the model would be asked is a table, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import words
from tenure.operators.catalog import resolve_skills
from tenure.stages import stage

PROSE = ("SUMMARY", "EXPERIENCE_RESPONSIBILITY", "EXPERIENCE_TECHNOLOGY", "EXPERIENCE_PROJECT", "PROJECT")
STRONG = ("EXPERIENCE_RESPONSIBILITY", "EXPERIENCE_PROJECT", "PROJECT")
#: Weak kinds in the order they count.
WEAK = (("EXPERIENCE_TECHNOLOGY", "TECHNICAL_ENVIRONMENT"), ("CERTIFICATION", "CERTIFICATION_ONLY"), ("SUMMARY", "RESPONSIBILITY_USAGE"), ("SKILL_SECTION", "SKILLS_SECTION_ONLY"))


# Confidence of a prose mention, share kept without a verdict, a verdict's confidence by default, candidates of a request.
IN_PROSE, NO_VERDICT, VERDICT, MOST_CANDIDATES = 0.85, 0.8, 0.5, 5


def section_parts(chunked: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, sequence, place, text) of the parts of skills sections that may name a skill."""
    parts = chunked.where("chunk_type = 'SKILL_SECTION'").select(key, "sequence", F.posexplode_outer(words.skill_candidates(F.col("text"))).alias("place", "text"))
    return parts.where(words.is_plausible_skill(F.col("text")))


def section_mentions(parts: DataFrame, ranked: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, sequence, place, skill, text, confidence, method) of the parts that ``ranked`` candidates decide."""
    sure = ranked.where("rank = 1 and confident").select("text", F.col("entity").alias("skill"), "confidence", "method")
    return parts.join(sure, "text").select(key, "sequence", "place", "skill", "text", "confidence", "method")


def ambiguous_mentions(parts: DataFrame, ranked: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, text, sequence, place, candidates): each undecided text of a document once, where it stands first, with its first candidates in order."""
    first = ranked.where("rank = 1 and not confident").select("text")
    options = ranked.where(F.col("rank") <= MOST_CANDIDATES).join(first, "text", "left_semi")
    options = options.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("entity").alias("skill"), "confidence", "method"))).alias("candidates"))
    at = F.min(F.struct("sequence", "place"))
    rows = parts.join(options, "text").groupBy(key, "text").agg(at.alias("at"), F.first("candidates").alias("candidates"))
    return rows.select(key, "text", "at.sequence", "at.place", "candidates")


def validation_requests(ambiguous: DataFrame, descriptions: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, request): JSON of a document's undecided texts with their candidates, described by ``descriptions`` (skill, description)."""
    rows = ambiguous.select(key, "text", "sequence", "place", F.explode("candidates").alias("c")).select(key, "text", "sequence", "place", "c.rank", "c.skill").join(descriptions, "skill", "left")
    option = F.struct("rank", F.col("skill").alias("canonical_name"), F.coalesce("description", F.lit("")).alias("description"))
    rows = rows.groupBy(key, "text").agg(F.min("sequence").alias("sequence"), F.min("place").alias("place"), F.sort_array(F.collect_list(option)).alias("options"))
    item = F.struct("sequence", "place", F.col("text").alias("detected_text"), F.transform("options", lambda o: o.dropFields("rank")).alias("candidates"))
    rows = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i.dropFields("sequence", "place")).alias("items"))
    return rows.select(key, F.to_json(F.struct("items")).alias("request"))


def parse_validations(answers: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, text, chosen, confidence) of answers (key, answer: JSON text or null)."""
    schema = "results array<struct<detected_text string, chosen_skill_id string, confidence double>>"
    rows = answers.select(key, F.explode(F.from_json("answer", schema)["results"]).alias("r"))
    return rows.select(key, F.col("r.detected_text").alias("text"), F.col("r.chosen_skill_id").alias("chosen"), "r.confidence")


def valid_verdicts(verdicts: DataFrame, ambiguous: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, text, chosen, confidence): verdicts on undecided texts that choose nothing or one of the text's candidates; of several on one text one counts."""
    rows = verdicts.join(ambiguous.select(key, "text", F.col("candidates.skill").alias("options")), [key, "text"])
    rows = rows.where(F.col("chosen").isNull() | F.array_contains("options", F.col("chosen")))
    one = F.max(F.struct(F.coalesce("chosen", F.lit("")).alias("chosen"), F.coalesce("confidence", F.lit(VERDICT)).alias("confidence"))).alias("v")
    return rows.groupBy(key, "text").agg(one).select(key, "text", F.nullif("v.chosen", F.lit("")).alias("chosen"), "v.confidence")


def judged_mentions(ambiguous: DataFrame, verdicts: DataFrame | None, key: str = "resume_id") -> DataFrame:
    """(key, sequence, place, skill, text, confidence, method): without a verdict the first candidate with less confidence, a refused text not at all."""
    first = F.get("candidates", F.lit(0))
    alone = [first["skill"].alias("skill"), "text", (first["confidence"] * NO_VERDICT).alias("confidence"), first["method"].alias("method")]
    if verdicts is None:
        return ambiguous.select(key, "sequence", "place", *alone)
    rows = ambiguous.join(valid_verdicts(verdicts, ambiguous, key).withColumn("judged", F.lit(True)), [key, "text"], "left")
    rows = rows.where("judged is null or chosen is not null")
    judged = F.col("judged").isNotNull()
    return rows.select(
        key, "sequence", "place", F.when(judged, F.col("chosen")).otherwise(first["skill"]).alias("skill"), "text",
        F.when(judged, F.col("confidence")).otherwise(first["confidence"] * NO_VERDICT).alias("confidence"), F.when(judged, "MODEL_VALIDATED").otherwise(first["method"]).alias("method"),
    )


def name_trie(catalog: DataFrame) -> DataFrame:
    """(depth, node, token, child, skill): arcs of the trie of the catalog's lower-case names, token by token. A node is the text that leads to it;
    ``skill`` is set where a name ends (of names that differ in case only, the last)."""
    names = catalog.select(F.lower("skill").alias("k"), "skill").where("k <> ''").groupBy("k").agg(F.max("skill").alias("skill"))
    names = names.select("k", "skill", words.tokens(F.col("k")).alias("w")).select("k", "skill", "w", F.posexplode("w").alias("depth", "token"))
    node = F.array_join(F.slice("w", F.lit(1), F.col("depth")), "")
    arcs = names.select("depth", node.alias("node"), "token", F.concat(node, F.col("token")).alias("child"), F.when(F.concat(node, F.col("token")) == F.col("k"), F.col("skill")).alias("skill"))
    return arcs.groupBy("depth", "node", "token").agg(F.max("child").alias("child"), F.max("skill").alias("skill"))


def prose_mentions(chunked: DataFrame, catalog: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, sequence, place, skill, text, confidence, method) of catalog names in prose chunks: character by character, without regard to
    case, not next to a letter or digit. From the left the longest name wins and names don't overlap; names that are common words take
    their place but aren't mentions.

    One join finds the places whose token begins a name. From there each level of the trie is a join on (node, next token); a place keeps the
    longest name that ended so far. Only as many tokens as the longest name has, and one more, go along with a place.
    """
    trie = stage(name_trie(catalog), "name-trie")
    levels = (trie.agg(F.max("depth")).first()[0] or 0) + 1
    rows = chunked.where(F.col("chunk_type").isin(*PROSE)).select(key, "sequence", words.tokens(F.col("text")).alias("w"))
    rows = rows.select(key, "sequence", "w", F.posexplode_outer("w").alias("start", "token"))  # "outer": no filter that computes the tokens again
    arcs = lambda depth: trie.where(F.col("depth") == depth)
    rows = rows.join(arcs(0).select(F.col("token").alias("t0"), F.col("child").alias("node"), F.col("skill").alias("ended")), F.lower("token") == F.col("t0"))
    letter = lambda c: F.coalesce(c.rlike("^[A-Za-z0-9]"), F.lit(False))
    rows = rows.where(~letter(F.get("w", F.col("start") - 1))).select(key, "sequence", "start", F.slice("w", F.col("start") + 1, levels + 1).alias("w"), "node", "ended")
    best = lambda n: F.when(F.col("ended").isNotNull() & ~letter(F.get("w", F.lit(n))), F.struct(F.lit(n).alias("n"), F.col("ended").alias("skill")))
    rows = rows.withColumn("best", best(1))
    for depth in range(1, levels):
        step = arcs(depth).select("node", F.col("token").alias("next"), "child", F.col("skill").alias("ends"))
        rows = rows.withColumn("next", F.lower(F.get("w", F.lit(depth)))).join(step, ["node", "next"], "left")
        rows = rows.select(key, "sequence", "start", "w", F.col("child").alias("node"), F.col("ends").alias("ended"), "best")
        rows = rows.withColumn("best", F.coalesce(best(depth + 1), F.col("best")))
    text = F.array_join(F.slice("w", F.lit(1), F.col("best.n")), "")
    hits = rows.where("best is not null").groupBy(key, "sequence").agg(F.sort_array(F.collect_list(F.struct("start", F.col("best.n").alias("n"), F.col("best.skill").alias("skill"), text.alias("text")))).alias("hits"))
    none = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<skill:string,text:string>>").alias("kept"))
    take = lambda acc, x: F.struct((x["start"] + x["n"]).alias("until"), F.concat(acc["kept"], F.array(F.struct(x["skill"], x["text"]))).alias("kept"))
    kept = F.aggregate("hits", none, lambda acc, x: F.when(x["start"] >= acc["until"], take(acc, x)).otherwise(acc))
    rows = hits.select(key, "sequence", F.posexplode_outer(kept["kept"]).alias("place", "x")).select(key, "sequence", "place", "x.skill", "x.text")
    rows = rows.where(~F.lower("text").isin(list(words.NOT_IN_PROSE)))
    return rows.withColumn("confidence", F.lit(IN_PROSE)).withColumn("method", F.lit("EXACT"))


def consolidate(section: DataFrame, prose: DataFrame, judged: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill, text, confidence, method, chunks): each skill of a document once. Section mentions come first, then prose, then judged ones;
    the first text stays, the first of the highest confidences and its method, and the chunk numbers are united. What is left without a text that may
    name a skill goes, unless a model has confirmed it."""
    rows = section.withColumn("rank", F.lit(0)).unionByName(prose.withColumn("rank", F.lit(1))).unionByName(judged.withColumn("rank", F.lit(2)))
    order = F.struct("rank", "sequence", "place")
    # a prose mention of a known skill only adds its chunk; it never raises the confidence of a section mention, which is higher
    best = F.max_by(F.struct("confidence", "method"), F.struct("confidence", -F.col("rank"), -F.col("sequence"), -F.col("place")))
    rows = rows.groupBy(key, "skill").agg(F.min_by("text", order).alias("text"), best.alias("b"), F.sort_array(F.collect_set("sequence")).alias("chunks"))
    rows = rows.select(key, "skill", "text", "b.confidence", "b.method", "chunks")
    return rows.where(words.is_plausible_skill(F.col("text")) | (F.col("method") == "MODEL_VALIDATED"))


def discover(chunked: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, verdicts: DataFrame | None = None, semantic: DataFrame | None = None, key: str = "resume_id") -> DataFrame:
    """(key, skill, text, confidence, method, chunks) of chunks (key, sequence, chunk_type, text).

    ``catalog``: (skill); ``aliases``: (entity, alias); ``verdicts``: (key, text, chosen, confidence); ``semantic``: (text, entity, similarity).
    Documents without skills have no rows.
    """
    spark = chunked.sparkSession
    aliases = spark.createDataFrame([], "entity string, alias string") if aliases is None else aliases
    parts = stage(section_parts(chunked, key), "skill-parts")
    ranked = stage(resolve_skills(parts, catalog.select(F.col("skill").alias("entity")), aliases, semantic), "ranked-skills")
    ambiguous = ambiguous_mentions(parts, ranked, key)
    if verdicts is not None:
        ambiguous = stage(ambiguous, "ambiguous-skills")
    found = consolidate(section_mentions(parts, ranked, key), prose_mentions(chunked, catalog, key), judged_mentions(ambiguous, verdicts, key), key)
    return stage(found, "skills")


# Ways a skill can be found; others are stored as EXACT.
METHODS = ("EXACT", "ALIAS", "FUZZY", "SEMANTIC", "MODEL_VALIDATED")


def stored_skills(found: DataFrame, key: str = "resume_id") -> DataFrame:
    """Discovered skills as rows to be verified: AUTO_CONFIRMED, numbered by skill within the document."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy(key).orderBy("skill")) - 1
    method = F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise("EXACT")
    return found.select(key, row.cast("long").alias("row_id"), "skill", "text", "confidence", method.alias("method"), F.lit("AUTO_CONFIRMED").alias("status"), F.array_sort("chunks").alias("chunks"), F.lit(False).alias("user_modified"))


def grade_skills(skills: DataFrame, chunked: DataFrame, key: str = "resume_id", most: int = 3) -> DataFrame:
    """(key, skill, sources, strength, kind, evidence): two distinct (chunk type, company) sources are strong, one is moderate, else the
    first weak kind counts. ``evidence`` holds the first chunk of each source, at most ``most``; a null company is a value of its own."""
    rows = skills.select(key, "skill", F.explode("chunks").alias("sequence")).join(chunked.select(key, "sequence", "chunk_type", "company"), [key, "sequence"])
    sources = rows.groupBy(key, "skill", "chunk_type", "company").agg(F.min("sequence").alias("sequence"))
    strong = F.col("chunk_type").isin(*STRONG)
    weak = [F.min(F.when(F.col("chunk_type") == t, F.col("sequence"))).alias(t) for t, _ in WEAK]
    out = sources.groupBy(key, "skill").agg(F.count_if(strong).alias("sources"), F.sort_array(F.collect_list(F.when(strong, F.col("sequence")))).alias("firsts"), *weak)
    n = F.col("sources")
    kind = F.when(n >= 2, "EXPLICIT_IMPLEMENTATION").when(n == 1, "RESPONSIBILITY_USAGE")
    only = F.array().cast("array<bigint>")
    evidence = F.when(n > 0, F.slice("firsts", 1, most))
    strength = F.when(n >= 2, "STRONG").when(n == 1, "MODERATE")
    for t, name in WEAK:
        kind, evidence, strength = kind.when(F.col(t).isNotNull(), name), evidence.when(F.col(t).isNotNull(), F.array(t)), strength.when(F.col(t).isNotNull(), "WEAK")
    return out.select(key, "skill", "sources", strength.otherwise("NONE").alias("strength"), kind.otherwise("NONE").alias("kind"), evidence.otherwise(only).alias("evidence"))
