"""Chunks of career documents (roles with their bullets and technologies, list entries, plain sections) and role rows.

Everything is keyed by document: one exchange on the key serves the section windows, the groups and the numbering.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions import dates, patterns
from tenure.operators import intervals
from tenure.operators.text import section_lines

_PIECES = "array<struct<chunk_type:string,text:string>>"


def _piece(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("chunk_type"), text.alias("text"))


def _lookup(values: dict[str, str], at: Column, default: str) -> Column:
    return F.coalesce(*[F.when(at == k, v) for k, v in values.items()], F.lit(default))


def _role_pieces(head: Column, dated: Column) -> Column:
    """Header, bullets and technology line of a group of lines (o, kind, text); an undated role's lines are all bullets."""
    of = lambda k: F.when(dated, F.filter("lines", lambda x: x["kind"] == k))
    value = lambda line, label: patterns.found(line["text"], label)

    def pieces(named: Column, tech: Column) -> Column:
        role = patterns.strip(value(named, patterns.ROLE_LABEL))
        kept = F.filter("lines", lambda x: ~dated | (x["kind"] == "bullet") | ((x["kind"] == "role") & (x["o"] > named["o"])))
        bullets = F.filter(F.transform(kept, lambda x: patterns.without_bullet(x["text"])), lambda s: s != "")
        header = F.when(dated, F.concat_ws("\n", head, F.concat(F.lit("Role: "), role))).otherwise("(Undated experience entries)")
        all_ = F.concat(
            F.array(_piece("EXPERIENCE_ROLE", header)),
            F.transform(bullets, lambda s: _piece("EXPERIENCE_RESPONSIBILITY", s)),
            F.when(tech.isNotNull(), F.array(_piece("EXPERIENCE_TECHNOLOGY", patterns.strip(value(tech, patterns.TECHNOLOGY_LABEL))))).otherwise(F.array().cast(_PIECES)),
        )
        return F.struct(role.alias("role"), all_.alias("pieces"))

    return patterns.let(F.get(of("role"), F.lit(0)), lambda named: patterns.let(F.get(F.reverse(of("tech")), F.lit(0)), lambda tech: pieces(named, tech)))


def _section_pieces(listed: Column) -> Column:
    """One piece of the lines: an entry of a list section (its title stays as it is) or the whole of another; none without text."""
    entry = lambda t: F.when(listed & ~patterns.is_entry_title(t), patterns.without_bullet(t)).otherwise(t)
    text = F.array_join(F.transform("lines", lambda x: entry(x["text"])), "\n")
    kind = _lookup({**patterns.LIST_TYPES, **patterns.PLAIN_TYPES}, F.col("section"), "OTHER")
    piece = lambda t: F.when(t != "", F.array(F.struct(kind.alias("chunk_type"), t.alias("text")))).otherwise(F.array().cast(_PIECES))
    return F.struct(F.lit(None).cast("string").alias("role"), patterns.let(patterns.strip(text), piece).alias("pieces"))


def chunks(rows: DataFrame, today: dt.date, key: str = "resume_id", order: str = "line_no") -> DataFrame:
    """(key, sequence, parent_sequence, chunk_type, section, company, role, start_date, end_date, is_current, text) of lines (key, order, text).

    Blank lines don't count; a null text is blank. Bullets and technology lines point at their role's header. Lines of an experience section before its first
    anchor are dropped; one without anchors is an undated role. All lines are sorted once: an anchor or a title opens a group, groups make pieces, and only groups are numbered.
    """
    lines = section_lines(rows, key, order).where("_s is null").withColumn("text", patterns.strip(F.col("text"))).where("text <> ''")
    t, in_role, listed = F.col("text"), F.col("section") == "EXPERIENCE", F.col("section").isin(*patterns.LIST_TYPES)
    # labels are short, so the first signs of a line rule out most of them before the patterns run
    labelled = in_role & t.rlike(r"(?i)^[rtpdlem]")
    kind = (
        F.when(labelled & patterns.found(t, patterns.ROLE_LABEL).isNotNull(), "role").when(labelled & (t.rlike(patterns.LOCATION_LABEL) | t.rlike(patterns.RESPONSIBILITIES_LABEL)), "drop")
        .when(labelled & patterns.found(t, patterns.TECHNOLOGY_LABEL).isNotNull(), "tech").otherwise("bullet")
    )
    opens = F.when(in_role, patterns.is_role_anchor(t)).when(listed, patterns.is_entry_title(t)).otherwise(False)
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(by))
    anchor = in_role & F.col("opens")
    line = F.struct(F.col(order).alias("o"), kind.alias("kind"), "text")
    groups = lines.groupBy(key, "island", "part").agg(F.first("section").alias("section"), F.max(F.when(anchor, t)).alias("head"), F.sort_array(F.collect_list(F.when(~anchor, line))).alias("lines"))
    dated = F.max(F.col("head").isNotNull()).over(Window.partitionBy(key, "island"))
    groups = groups.withColumn("dated", dated).where("section <> 'EXPERIENCE' or head is not null or not dated")
    head = F.col("head")
    span = dates.parse_range(patterns.found(head, patterns.DATE_RANGE, 0), today)
    made = F.when(in_role, _role_pieces(head, F.col("dated"))).otherwise(_section_pieces(listed))
    groups = groups.select(key, "island", "part", "section", F.when(in_role, patterns.company(head)).alias("company"), F.when(in_role, span).alias("span"), made.alias("made"))
    groups = groups.withColumn("n", F.size("made.pieces"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("island", "part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("first", F.coalesce(before, F.lit(0)))
    out = groups.select("*", F.posexplode_outer("made.pieces").alias("place", "piece")).where("piece is not null")  # "outer" keeps Catalyst from computing them twice for a filter
    return out.select(
        key, (F.col("first") + F.col("place")).alias("sequence"), F.when(F.col("place") > 0, F.col("first")).alias("parent_sequence"), "piece.chunk_type", "section", "company", "made.role",
        F.col("span.start").alias("start_date"), F.col("span.end").alias("end_date"), F.coalesce("span.is_current", F.lit(False)).alias("is_current"), "piece.text",
    )


def embedding_text(name: Column) -> Column:
    """Labelled context and text of a chunk; absent parts are left out."""
    part = lambda label, value: F.concat(F.lit(f"{label}:\n"), value)
    end = F.when(F.col("is_current"), "Present").otherwise(F.coalesce(F.col("end_date").cast("string"), F.lit("?")))
    span = F.when(F.coalesce("start_date", "end_date").isNotNull(), F.concat(F.coalesce(F.col("start_date").cast("string"), F.lit("?")), F.lit(" to "), end))
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n\n", part("Candidate", filled(name)), part("Company", filled(F.col("company"))), part("Role", filled(F.col("role"))), part("Dates", span),
        part("Section", F.col("section")), part("Chunk Type", F.col("chunk_type")), part("Original Text", F.col("text")),
    )


def text_of_type(kind: str) -> Column:
    """Aggregate: the texts of a document's chunks of a type, in order, joined by line ends."""
    rows = F.sort_array(F.collect_list(F.when(F.col("chunk_type") == kind, F.struct("sequence", "text"))))
    return F.array_join(F.transform(rows, lambda x: x["text"]), "\n")


def presence_flags() -> list[Column]:
    """Aggregates project, certification, achievement: whether a document has such chunks."""
    return [F.bool_or(F.col("chunk_type") == k).alias(k.lower()) for k in ("PROJECT", "CERTIFICATION", "ACHIEVEMENT")]


def candidate_name(rows: DataFrame, key: str = "resume_id", order: str = "line_no") -> DataFrame:
    """(key, name): the first line if it is short, without digits and without @; else null."""
    first = rows.groupBy(key).agg(F.min_by("text", order).alias("t"))
    t = patterns.strip(F.col("t"))
    return first.select(key, F.when((t != "") & (F.length(t) <= 60) & ~t.rlike(r"[@\d]"), t).alias("name"))


def role_rows(chunked: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, place, company, title, start_date, end_date, is_current, months, responsibilities, technologies, confidence) of chunks.

    Roles are in order of their start (unknown first); the place counts all of them, those without company and title are then left out.
    """
    of = lambda kind, value: F.when(F.col("chunk_type") == kind, value)
    rows = chunked.where(F.col("chunk_type").startswith("EXPERIENCE_")).withColumn("head", F.coalesce("parent_sequence", "sequence"))
    same = [F.first(c).alias(c) for c in ("company", "role", "start_date", "end_date", "is_current")]
    bullets = F.transform(F.sort_array(F.collect_list(of("EXPERIENCE_RESPONSIBILITY", F.struct("sequence", "text")))), lambda x: x["text"])
    tools = F.split(F.max(of("EXPERIENCE_TECHNOLOGY", F.col("text"))), r"(?i)[,;/]|\band\b")
    tools = F.filter(F.transform(tools, patterns.strip), lambda s: s != "")
    rows = rows.groupBy(key, "head").agg(*same, bullets.alias("responsibilities"), F.coalesce(tools, F.array().cast("array<string>")).alias("technologies"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("start_date").asc_nulls_first(), "head")).cast("long"))
    titled = F.length("role").between(2, 120)
    rows = rows.where((F.coalesce("company", F.lit("")) != "") | F.coalesce(titled, F.lit(False)))
    dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    months = F.when(dated, intervals.months_inclusive(F.col("start_date"), F.col("end_date"))).otherwise(0).cast("long")
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    return rows.select(
        key, "place", unknown("company").alias("company"), unknown("role").alias("title"), "start_date", "end_date", "is_current", months.alias("months"), "responsibilities", "technologies",
        F.when(dated, 1.0).otherwise(0.5).alias("confidence"),
    )
