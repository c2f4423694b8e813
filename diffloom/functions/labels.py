"""Labels of raters in any spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels, in the order that breaks ties.
LABELS = ("bugfix", "refactoring", "documentation", "test", "cosmetic", "other")
#: Other spellings, compared without case, blanks and punctuation.
ALIASES = {
    "bug": "bugfix", "fix": "bugfix", "bugs": "bugfix", "fixes": "bugfix", "refactor": "refactoring", "refactored": "refactoring",
    "doc": "documentation", "docs": "documentation", "comment": "documentation", "tests": "test", "testing": "test", "cosmetics": "cosmetic",
    "style": "cosmetic", "others": "other",
}


def clean_label(raw: Column) -> Column:
    """One of the labels for any spelling of it; null for null and blank text, ``other`` for any other text.

    Case, blanks and punctuation don't count; a word within one edit of a label (two, if it is long) is that label.
    """
    word = F.regexp_replace(F.lower(raw), r"[^\p{L}]+", "")
    exact = F.when(word.isin(*LABELS), word)
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[word]
    near = F.coalesce(*[F.when(F.levenshtein(word, F.lit(k)) <= (2 if len(k) > 7 else 1), F.lit(k)) for k in LABELS])
    blank = raw.isNull() | (F.trim(F.regexp_replace(raw, r"\s+", " ")) == "")
    return F.when(~blank, F.coalesce(exact, alias, near, F.lit("other")))
