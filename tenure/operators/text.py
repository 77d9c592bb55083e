"""Lines of documents: splitting, repair, clustering of positioned words, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions import rules
from tenure.functions.patterns import let
from tenure.stages import stage

#: Ends of lines, and what a line holds that isn't blank.
LINE_END, NOT_BLANK = "\r\n|\r|\n", r"(?U)\S"


def block_ids(rows: DataFrame, key: str = "doc_id", page: str = "page", order: str = "line_no") -> DataFrame:
    """``rows`` with ``sequence``, from 0 over the whole document in order of page and line, and ``block_id`` doc:pPAGE:bSEQUENCE."""
    at = (F.row_number().over(Window.partitionBy(key).orderBy(page, order)) - 1).cast("long")
    rows = rows.withColumn("sequence", at)
    return rows.withColumn("block_id", F.concat(F.col(key).cast("string"), F.lit(":p"), F.col(page).cast("string"), F.lit(":b"), F.col("sequence").cast("string")))


def document_texts(pages: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """(key, raw_text, normalized_text, n_pages) of pages (key, page, raw, normalized): raw with a banner before each page, normalized with a blank line between them."""
    rows = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, "raw", "normalized"))).alias("p"), F.count_distinct(page).alias("n_pages"))
    raw = F.array_join(F.transform("p", lambda x: F.concat(F.lit("--- PAGE "), x[page].cast("string"), F.lit(" ---\n"), F.coalesce(x["raw"], F.lit("")))), "\n")
    normal = F.array_join(F.transform("p", lambda x: F.coalesce(x["normalized"], F.lit(""))), "\n\n")
    return rows.select(key, raw.alias("raw_text"), normal.alias("normalized_text"), "n_pages")


def present_sections(sectioned: DataFrame, names: list[str], key: str = "resume_id") -> DataFrame:
    """(key, has_NAME...) of section rows."""
    return sectioned.groupBy(key).agg(*[F.bool_or(F.col("section") == n).alias(f"has_{n.lower()}") for n in names])


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, text) of the lines that aren't blank; CRLF, CR and LF end lines, numbers count blank lines."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("line_no", "text"))
    return rows.where(F.col("text").rlike(NOT_BLANK))


def normalized(text) -> F.Column:
    """Runs of space and tab are one space, lines are stripped, more than two line ends are two, ends are stripped."""
    s = F.regexp_replace(text, r"[ \t]+", " ")
    s = F.regexp_replace(s, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def merge_hyphens(rows: DataFrame, key: str | list[str] = "doc_id", order: str = "line_no") -> DataFrame:
    """(key, line_no, text): a line that ends in one hyphen takes in the next ones while they start lower-case. A ``box`` of the rows grows with them.
    With document and page as ``key`` a hyphen at a page's end stays."""
    key = _keys(key)
    by = Window.partitionBy(*key).orderBy(order)
    before = F.lag("text").over(by)
    glued = F.coalesce(before.rlike("-$") & ~before.rlike("--$") & F.col("text").rlike(r"^\p{Ll}"), F.lit(False))
    rows = rows.withColumn("_i", F.sum(F.when(glued, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda x: x["text"]), "")
    boxes = [enclosing(*[F.col(f"box.{c}") for c in ("x0", "x1", "top", "bottom")]).alias("box")] if "box" in rows.columns else []
    return rows.groupBy(*key, "_i").agg(F.min(order).alias(order), joined.alias("text"), *boxes).drop("_i")


def cluster_words(words: DataFrame, key: str | list[str] = "doc_id", height: float = 4.0) -> DataFrame:
    """(key, line_key, text, box, n_words) from positioned words (key, x0, x1, top, bottom, text): one line per rounded bottom (half to even); its box encloses its words.
    With document and page as ``key`` words of two pages never meet."""
    key = _keys(key)
    at = F.rint(F.col("bottom") / height) * height
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    out = words.groupBy(*key, at.alias("line_key")).agg(text.alias("text"), enclosing(F.col("x0"), F.col("x1"), F.col("top"), F.col("bottom")).alias("box"), F.count("*").alias("n_words"))
    return out.where(F.trim("text") != "")


def listed_words(text: F.Column, word) -> F.Column:
    """Array of ``word(line_no, place, word)`` of the words, parted by single spaces, of the lines of a text that aren't blank; numbers count blank lines."""
    of_line = lambda line, n: F.when(line.rlike(NOT_BLANK), F.transform(F.split(line, " "), lambda w, i: word(n, i, w)))
    return F.flatten(F.array_compact(F.transform(F.split(text, LINE_END), of_line)))


def one_list_a_key(rows: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, words) with the arrays of a key's rows put together. Only keys are shuffled, and the arrays of those that have several rows."""
    rows = rows.select(key, words)
    again = stage(rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("_again")), "repeated-keys")
    if again.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("_again"))
    joined = rows.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(words)).alias(words))
    return rows.join(again, same, "left_anti").unionByName(joined)


def cluster_listed_words(rows: DataFrame, key: str = "doc_id", page: str | None = None, words: str = "words", height: float = 4.0) -> DataFrame:
    """The same as ``cluster_words`` from one array of words (x0, x1, top, bottom, text, and page if there is one) a row, which leaves no word to shuffle:
    a document's words are sorted in place and cut where the line changes."""
    inside = [page] if page else []
    at = lambda w: (F.rint(w["bottom"] / height) * height + F.lit(0.0)).alias("line_key")  # noqa: E731  no negative zero
    placed = F.transform(words, lambda w: F.struct(*[w[c].alias(c) for c in inside], at(w), *[w[c].alias(c) for c in ("x0", "text", "x1", "top", "bottom")]))

    def whole(line: F.Column) -> F.Column:
        ends = [f(line[c]).alias(c) for c, f in (("x0", F.array_min), ("x1", F.array_max), ("top", F.array_min), ("bottom", F.array_max))]
        first = [F.get(line[c], F.lit(0)).alias(c) for c in (*inside, "line_key")]
        return F.struct(*first, F.array_join(line["text"], " ").alias("text"), F.struct(*ends).alias("box"), F.size(line).cast("long").alias("n_words"))

    def cut(s: F.Column) -> F.Column:
        changes = lambda c: let(s[c], lambda x: F.transform(x, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(x, i - 1))))
        change = F.zip_with(changes(page), changes("line_key"), lambda a, b: a | b) if page else changes("line_key")
        starts = F.array_compact(F.transform(change, lambda c, i: F.when(c, i)))
        stop = lambda p, k: F.coalesce(F.get(p, k + 1), F.size(s))
        return let(starts, lambda p: F.transform(p, lambda a, k: let(F.slice(s, a + 1, stop(p, k) - a), whole)))

    found = one_list_a_key(rows, key, words).select(key, F.explode_outer(let(F.sort_array(placed), cut)).alias("line"))  # "outer" keeps Catalyst from computing them twice for a filter
    return found.where("line is not null").where(F.trim("line.text") != "").select(key, "line.*")


def enclosing(x0, x1, top, bottom) -> F.Column:
    """Aggregate: the box around boxes."""
    return F.struct(F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(top).alias("top"), F.max(bottom).alias("bottom"))


def section_lines(rows: DataFrame, key: str = "resume_id", order: str = "line_no", page: str | None = None) -> DataFrame:
    """(key, order, text, section, island, _s, and page if there is one): the section of each line; ``_s`` is set on headings, which start sections. Lines before any are CONTACT."""
    rows = rows.select(key, order, *([page] if page else []), "text", rules.canonical_section(F.col("text")).alias("_s"))
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last("_s", ignorenulls=True).over(by), F.lit("CONTACT"))).withColumn("island", F.count("_s").over(by))


def sections(rows: DataFrame, key: str = "resume_id", order: str = "line_no", page: str | None = None) -> DataFrame:
    """(key, place, section, confidence, n_lines, blocks, text): headings start sections and are consumed; lines before any are CONTACT. ``blocks``: the numbers of the lines.
    ``order`` runs through the document; with a ``page`` the rows carry the page of the section's heading, or of its first line without one."""
    rows = section_lines(rows, key, order, page)
    lines = F.sort_array(F.collect_list(F.when(F.col("_s").isNull(), F.struct(order, "text"))))
    pages = [F.min_by(page, order).alias(page)] if page else []
    out = rows.groupBy(key, "island").agg(F.first("section").alias("section"), F.count_if(F.col("_s").isNull()).alias("n_lines"), lines.alias("l"), *pages).where("n_lines > 0")
    place = F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1
    text, blocks = F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.transform("l", lambda x: x[order])
    return out.select(key, *([page] if page else []), place.cast("long").alias("place"), "section", F.when(F.col("island") == 0, 0.5).otherwise(0.95).alias("confidence"), "n_lines", blocks.alias("blocks"), text.alias("text"))


def unrecognized_headings(rows: DataFrame, key: str = "resume_id", order: str = "line_no") -> DataFrame:
    """Rows whose line has the shape of a heading and is none that is known."""
    return rows.where(rules.is_unrecognized_heading(F.col("text")))
