"""Text functions: case folding, white space, titles, languages, types of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import document, rows
from . import patterns as P


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern (Python's dialect) is found in the text."""
    return text.rlike(P.java(pattern))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, P.java(pattern), by)


def fold(s: Column) -> Column:
    """Case folding for comparisons."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def squeeze(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, f"[{P.S}]+", " "))


def words(s: Column) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(s, f"[{P.S}]+"), "")


def clean(s: Column) -> Column:
    """A mention without leading titles and outer punctuation."""
    return F.btrim(F.regexp_replace(squeeze(s), P.java(P.TITLES), ""), F.lit(" ,;:"))


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before an offset from 0."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    """The n characters from an offset on."""
    return F.substring(text, end + 1, F.lit(n))


def is_social_insurance(text: Column, legal_area: Column) -> Column:
    return matches(F.coalesce(legal_area, F.lit("")), P.SOCIAL_INSURANCE) | matches(F.substring(text, 1, 4000), P.SOCIAL_INSURANCE)


def guess_language(text: Column) -> Column:
    """The language whose stop words are most frequent among the first 3,000 words; ties go to de, fr, it in this order."""
    head = F.slice(words(F.lower(text)), 1, 3000)

    def votes(language: str) -> Column:
        return F.size(F.filter(head, lambda w: w.isin(*P.STOPWORDS[language])))

    de, fr, it = map(votes, ("de", "fr", "it"))
    return F.when((de >= fr) & (de >= it), "de").when(fr >= it, "fr").otherwise("it")


def plausible(surface: Column, type_: Column) -> Column:
    """Whether a surface can be a name or number of its type: no role noun, citation or docket."""
    return rows.column(document.plausible, "boolean")(surface, type_)


def typed(type_: Column, role: Column, mention: Column) -> Column:
    """The type that a labelled role and the words of the mention say it must have."""
    return rows.column(document.typed, "string")(type_, role, mention)
