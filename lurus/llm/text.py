"""Canonical forms of texts: what is left of a text once its formatting is taken away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{Nd}]+"
FIELD_BREAK = r"[;|\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]+"
LABELLED = r"(?s)^[^:]*[\p{L}\p{Nd}][^:]*:.*[\p{L}\p{Nd}]"


def letters(text: Column) -> Column:
    """Letters and digits of a text in lower case; null stays null."""
    return F.lower(F.regexp_replace(text, NOT_ALNUM, ""))


def canonical(text: Column) -> Column:
    """A text without its formatting: letter case, white space, marks, and the order of `label: value` fields.

    A text is taken as labelled if, set apart by `;`, `|` or line breaks, it has two or more fields that hold a letter or digit, each with one
    before and one after its first colon; its fields are then put in order. Null and wordless texts give "".
    """
    fields = F.filter(F.split(text, FIELD_BREAK), lambda f: f.rlike(r"[\p{L}\p{Nd}]"))
    labelled = F.contains(text, F.lit(":")) & (F.size(fields) >= 2) & F.forall(fields, lambda f: f.rlike(LABELLED))
    in_order = F.array_join(F.array_sort(F.transform(fields, letters)), "")
    return F.coalesce(F.when(labelled, in_order).otherwise(letters(text)), F.lit(""))


def split_name(split: Column) -> Column:
    """train, val or test, read without regard to case and outer spaces; anything else is null."""
    s = F.lower(F.regexp_replace(split, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s.isin("valid", "validation"), "val").when(s.isin("train", "val", "test"), s)


#: Category codes and names of the test data.
CATEGORIES = {"eja": "spelling", "tip": "typographic", "alg": "algospeak", "mor": "morphological", "sem": "semantic", "sin": "syntactic", "mix": "mixed"}


def category_name(category: Column) -> Column:
    """Full name of a category given by name or code, without regard to case and outer spaces; unknown ones are null."""
    s = F.lower(F.regexp_replace(category, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    out = F.when(s.isin(*CATEGORIES.values()), s)
    for code, name in CATEGORIES.items():
        out = out.when(s == code, name)
    return out


def plain_columns(df, names: dict[str, str]):
    """Only the named columns, under the operator's own names; other columns cannot clash with its working columns."""
    return df.select(*(F.col(f"`{given}`").alias(own) for own, given in names.items()))
