"""Rubrics and patterns. The values are fixed: results depend on them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.functions.patterns import BULLET, let, strip

# Sections in match order and the phrases that name them, as whole words of the upper-cased line; a star stands for any word with this beginning.
SECTIONS = {
    "EXPERIENCE": ("EXPERIENCE", "EMPLOYMENT HISTORY", "CAREER HISTORY", "WORK HISTORY", "PROFESSIONAL EXPERIENCE", "PROFESSIONAL HISTORY", "WORK EXPERIENCE"),
    "SUMMARY": ("SUMMARY", "PROFILE", "ABOUT ME", "OBJECTIVE", "CAREER PROFILE", "EXECUTIVE SUMMARY"),
    "SKILLS": ("SKILL", "SKILLS", "COMPETENCIES", "TECHNOLOGIES", "TOOLS", "EXPERTISE", "TECHNOLOGY STACK"),
    "PROJECTS": ("PROJECTS", "KEY PROJECTS", "SELECTED PROJECTS"),
    "EDUCATION": ("EDUCATION*", "ACADEMIC BACKGROUND", "ACADEMIC QUALIFICATIONS", "QUALIFICATION", "QUALIFICATIONS"),
    "CERTIFICATIONS": ("CERTIFICATIONS", "LICENSES", "CERTIFICATES", "ACCREDITATIONS", "CREDENTIALS", "PROFESSIONAL CERTIFICATIONS"),
    "AWARDS": ("AWARDS",),
    "ACHIEVEMENTS": ("ACHIEVEMENTS", "HONORS", "ACCOMPLISHMENTS"),
    "PUBLICATIONS": ("PUBLICATIONS",),
    "INTERESTS": ("INTERESTS", "HOBBIES"),
    "CONTACT": ("CONTACT", "PERSONAL DETAILS", "PERSONAL INFORMATION", "CONTACT INFO", "CONTACT INFORMATION"),
}
# Level of a title, in match order, without regard to case.
SENIORITY = (
    ("Intern", r"\b(intern|apprentice)\b"),
    ("Trainee", r"\btrainee\b"),
    ("Junior", r"\bjunior\b"),
    ("Associate", r"\bassociate\b"),
    ("C-Level", r"\b(chief|ceo|cto|cfo|coo|president)\b"),
    ("VP", r"\b(vp|vice[\s-]president)\b"),
    ("Head", r"\bhead\s+of\b"),
    ("Director", r"\bdirector\b"),
    ("Senior Manager", r"\b(senior\s+manager|sr\.?\s*manager)\b"),
    ("Manager", r"\bmanager\b"),
    ("Architect", r"\barchitect\b"),
    ("Staff", r"\bstaff\b"),
    ("Principal", r"\bprincipal\b"),
    ("Lead", r"\b(lead|scrum\s*master|product\s*owner)\b"),
    ("Senior", r"\b(senior|sr\.?)\b"),
)
AMBIGUOUS_TITLE = r"\b(head|founder|co-founder|owner)\b"
DEFAULT_LEVEL = "Mid-Level"
# The ladder of levels, numbered from 1; confidence of a rule, of the default, of an empty and of an ambiguous title.
LADDER = ("Intern", "Trainee", "Junior", "Associate", "Mid-Level", "Senior", "Lead", "Principal", "Staff", "Architect", "Manager", "Senior Manager", "Director", "Head", "VP", "C-Level")
LEVEL_CONFIDENCE = {"rule": 0.9, "default": 0.7, "empty": 0.4, "ambiguous": 0.3}
# Level of a bullet, highest first, without regard to case; a role without any is TASK_EXECUTION.
BULLETS = (
    ("MENTORING_LEADERSHIP", 4, r"\b(mentored|guided|team lead|managed\s+(?:a\s+)?team|directed|scrum master|product owner|led\s+a\s+team|supervised|coached)\b"),
    ("ARCHITECTURE", 3, r"\b(architected|designed\s+(?:the|a|an)?\s*(?:system|architecture|solution)|scaled|microservices|distributed system|system design|integration architecture)\b"),
    ("OWNERSHIP", 2, r"\b(managed|owned|led|spearheaded|maintained|responsible for|drove|delivered end-to-end)\b"),
    ("TASK_EXECUTION", 1, r"\b(developed|implemented|built|coded|created|configured|analyzed|tested|wrote|fixed|designed|developed)\b"),
)
DEFAULT_RESPONSIBILITY = "TASK_EXECUTION"
# Growth: greatest points of the nine dimensions, fraction of a label.
GROWTH_POINTS = (4, 5, 4, 3, 3, 2, 2, 1, 1)
GROWTH_LABELS = {"NONE": 0.0, "LOW": 0.25, "MODERATE": 0.5, "HIGH": 0.8, "EXCEPTIONAL": 1.0}


def first_match(text: Column, rules, default=None) -> Column:
    """Name of the first rule whose pattern (last field) is found in the text."""
    out = None
    for name, *_, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def _ranks(n_words: int) -> Column:
    """Map of the phrases of so many words to the place of their section."""
    pairs = [(p, k) for k, phrases in enumerate(SECTIONS.values()) for p in phrases if p.count(" ") + 1 == n_words and "*" not in p]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _phrase_section(s: Column) -> Column:
    """Section of the first rule that has a phrase in the stripped line: its words, and each with the next behind a single space, are looked up."""
    begin = [(p[:-1], k) for k, phrases in enumerate(SECTIONS.values()) for p in phrases if "*" in p]
    first = sorted({p.split(" ")[0] for phrases in SECTIONS.values() for p in phrases if "*" not in p})

    def least(t: Column) -> Column:
        def rank(w: Column, i: Column) -> Column:
            two = F.try_element_at(_ranks(2), F.concat(w, F.lit(" "), F.get(t, i + 1)))
            return F.least(F.try_element_at(_ranks(1), w), two, *[F.when(w.startswith(b), k) for b, k in begin])

        # few lines hold a first word of a phrase; the others are out after one look at each word
        some = F.exists(t, lambda w: functools.reduce(operator.or_, [w.startswith(b) for b, _ in begin], w.isin(first)))
        return F.when(some, F.get(F.array(*[F.lit(n) for n in SECTIONS]), F.array_min(F.transform(t, rank))))

    return let(F.split(F.regexp_replace(F.upper(s), r"(?U)[^\w ]", " | "), " "), least)


def canonical_section(line: Column) -> Column:
    """Section of a heading-shaped line (1 to 60 characters, no bullet), else null. The shape rules out most lines before their words are looked up."""
    return let(strip(line), lambda s: F.when(F.length(s).between(1, 60) & ~s.rlike(BULLET + r"\s"), _phrase_section(s)))


def is_unrecognized_heading(line: Column) -> Column:
    """Whether a line that is no known heading has the shape of one: up to 40 characters and five words in capitals or title case,
    without digits and @, not ending like a sentence or a list."""

    def shaped(s: Column) -> Column:
        # title case: each run of letters is one capital and small letters
        titled = s.rlike(r"\p{Lu}") & ~s.rlike(r"(?<!\p{L})[\p{Ll}]|\p{L}\p{Lu}")
        plain = F.length(s).between(1, 40) & ~s.rlike(r"(?U)[@\d]|[.,;:]$") & ~s.rlike(BULLET + r"\s") & (F.size(F.split(s, r"\s+")) <= 5)
        return plain & ((s == F.upper(s)) | titled) & _phrase_section(s).isNull()

    return F.coalesce(let(strip(line), shaped), F.lit(False))


def seniority(title: Column) -> Column:
    """Level of a title; null if ambiguous (it is inherited), Mid-Level by default."""
    t = F.lower(strip(title))
    return F.when(F.coalesce(t, F.lit("")) == "", DEFAULT_LEVEL).otherwise(F.coalesce(first_match(t, SENIORITY), F.when(~t.rlike(AMBIGUOUS_TITLE), DEFAULT_LEVEL)))


def seniority_confidence(title: Column) -> Column:
    t, known = F.lower(strip(title)), LEVEL_CONFIDENCE
    by_rule = F.when(first_match(t, SENIORITY).isNotNull(), known["rule"]).when(t.rlike(AMBIGUOUS_TITLE), known["ambiguous"]).otherwise(known["default"])
    return F.when(F.coalesce(t, F.lit("")) == "", known["empty"]).otherwise(by_rule)


def ladder_place(level: Column) -> Column:
    """Number of a level on the ladder, null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LADDER]), level), F.lit(0)).cast("long")


def bullet_level(text: Column) -> Column:
    return F.coalesce(first_match(F.lower(text), BULLETS), F.lit("OTHER"))


def role_level(rank: Column) -> Column:
    """Level of a role from the greatest rank of its bullets."""
    return F.coalesce(*[F.when(rank == r, name) for name, r, _ in BULLETS], F.lit(DEFAULT_RESPONSIBILITY))


def section_patterns() -> tuple[tuple[str, str], ...]:
    """(section, regular expression) of the same phrases, for engines that match them one by one."""
    return tuple((name, r"\b(" + "|".join(p[:-1] if p.endswith("*") else p + r"\b" for p in phrases) + ")") for name, phrases in SECTIONS.items())


def sql_case(text: str, rules, default: str = "NULL") -> str:
    """The same first match for DuckDB."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{name}'" for name, *_, p in rules) + f" ELSE {default} END"
