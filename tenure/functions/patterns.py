"""Patterns of lines in career documents. The values are fixed: results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: signs that open a bullet, the letter o and the private-use block of symbol fonts included.
BULLET = r"^[•\-*o●▪\x{F000}-\x{F0FF}]"
# A date and a range of dates in a line.
_DATE = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*[’']?\s*(?:\d{4}|\d{2})|\d{1,2}[/.]\d{4}|\b(?:19|20)\d{2}\b)"
DATE_RANGE = rf"(?i){_DATE}\s*(?:–|—|-|\bto\b)\s*(?:{_DATE}|Present|Current|Till\s*date|Now|Ongoing)"
# Labels of lines inside a role.
COMPANY_LABEL = r"(?i)^(?:Client|Company|Employer|Organization)\s*[:\-]\s*(.+)$"
ROLE_LABEL = r"(?i)^(?:Role|Title|Position|Designation)\s*[:\-]\s*(.+)$"
TECHNOLOGY_LABEL = r"(?i)^(?:Environment|Technologies|Tech\s*Stack|Tools\s*(?:&|and)?\s*Technologies|Module)\s*[:\-]\s*(.+)$"
LOCATION_LABEL = r"(?i)^Location\s*[:\-]\s*(.+)$"
RESPONSIBILITIES_LABEL = r"(?i)^Responsibilities\s*:?\s*$"
# Contact data and claims.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d{1,3}[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
CLAIMED_YEARS = r"(?i)(\d{1,2})\+?\s*years?(?:\s+of)?\s+experience"
METRIC = r"(?i)\b\d+%|\$\d+|\b\d+\s*(?:users|clients|customers|projects|systems|applications|teams|servers)\b"
# Chunk type of a section; other sections are OTHER. The first group holds lists of entries.
LIST_TYPES = {"PROJECTS": "PROJECT", "EDUCATION": "EDUCATION", "CERTIFICATIONS": "CERTIFICATION", "ACHIEVEMENTS": "ACHIEVEMENT", "AWARDS": "ACHIEVEMENT", "PUBLICATIONS": "PUBLICATION"}
PLAIN_TYPES = {"CONTACT": "CONTACT", "SUMMARY": "SUMMARY", "SKILLS": "SKILL_SECTION"}


#: Fixed value: white space of any script, taken off the ends of texts.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used: Catalyst would put its expression in each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def without_bullet(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), BULLET + r"\s*", ""))


def is_entry_title(text: Column) -> Column:
    """A stripped line of 1 to 90 characters that is no bullet and doesn't end in a full stop."""
    return F.length(text).between(1, 90) & ~text.rlike(BULLET) & ~text.endswith(".")


def is_role_anchor(text: Column) -> Column:
    """A line with a date range that is no bullet. Every date has two digits in a row, which most lines lack."""
    return text.rlike("[0-9]{2}") & text.rlike(DATE_RANGE) & ~strip(text).rlike(BULLET)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda s: F.when(s != "", s))


def company(anchor: Column) -> Column:
    """Company of an anchor line: its labelled value or the whole line, less the date range and edge signs."""
    edge = lambda s, signs: F.regexp_replace(F.regexp_replace(s, DATE_RANGE, ""), rf"^[{signs}]+|[{signs}]+$", "")
    whole = lambda: let(edge(anchor, r"\s\-–—:"), lambda s: F.when(s != "", s))
    return let(found(strip(anchor), COMPANY_LABEL), lambda labelled: F.when(labelled.isNotNull(), edge(labelled, r"\s\-–—")).otherwise(whole()))
