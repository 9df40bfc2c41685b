"""Column builders for texts: normal forms, tokens, spacing repair and edit distances. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: all Unicode white space, as Java's and RE2's `\s` know ASCII only.
SPACE = r"\t-\r\x{1C}-\x{1F} \x{85}\p{Z}"
MODES = ("raw", "lower", "lower_nopunct")


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def stripped(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normal(text: Column, mode: str) -> Column:
    """A text as it enters edit distances. Null counts as empty; `raw` changes nothing else."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    text = F.coalesce(text, F.lit(""))
    if mode == "raw":
        return text
    text = F.lower(text)
    if mode == "lower_nopunct":
        text = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{SPACE}]", "")
    return squeeze(text)


def key_form(text: Column) -> Column:
    """Lower case and single blanks: the form in which targets are compared."""
    return squeeze(F.lower(text))


def tokens(text: Column, lower: bool = False) -> Column:
    """White-space tokens; null, empty and blank texts have none."""
    text = squeeze(F.coalesce(text, F.lit("")))
    return F.filter(F.split(F.lower(text) if lower else text, " "), lambda t: t != "")


def mend_spacing(text: Column) -> Column:
    """No blanks before closing and after opening marks, single blanks elsewhere."""
    for pattern, to in ((rf"[{SPACE}]+([,.!?;:])", "$1"), (rf"([(\[{{])[{SPACE}]+", "$1"), (rf"[{SPACE}]+([)\]}}])", "$1"), (rf"[{SPACE}]{{2,}}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return stripped(text)


def mend_generated(text: Column) -> Column:
    """The wider repair for generated text: more closing marks, typographic quotes, and `* ' \" -` glued to both neighbours."""
    for pattern, to in ((rf"[{SPACE}]+([,.!?;:%)\]}}»”’])", "$1"), (rf"([(\[{{«“‘])[{SPACE}]+", "$1"), (rf"[{SPACE}]+([*'\"-])[{SPACE}]+", "$1"), (rf"[{SPACE}]{{2,}}", " ")):
        text = F.regexp_replace(text, pattern, to)
    return stripped(text)


def join_pieces(text: Column) -> Column:
    """Word pieces as text: sentence marks dropped, `##x` glued to what stands before it, spacing mended."""
    kept = F.array_join(F.filter(tokens(text), lambda t: ~t.isin("[CLS]", "[SEP]")), " ")
    return mend_generated(F.regexp_replace(F.regexp_replace(kept, " ##", ""), "^##", ""))


def punct_parts(token: Column) -> tuple[Column, Column, Column]:
    """Leading ASCII punctuation, core, trailing ASCII punctuation of a token. One without any other character is all leading."""
    lead, middle = F.regexp_extract(token, r"^\p{Punct}*", 0), core(token)
    return lead, middle, F.substr(token, F.length(lead) + F.length(middle) + 1)


def core(token: Column) -> Column:
    return F.regexp_replace(token, r"^\p{Punct}+|\p{Punct}+$", "")


def same_core(a: Column, b: Column) -> Column:
    """Equal but for punctuation at the ends and case."""
    return F.lower(core(a)) == F.lower(core(b))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def blind_leet(text: Column) -> Column:
    """The baseline that decodes three digits wherever they stand."""
    return F.translate(text, "430", "aeo")


def char_edits(hyp: Column, ref: Column) -> Column:
    return F.levenshtein(hyp, ref)


def word_edits(hyp: Column, ref: Column) -> Column:
    """Edit distance over words: each distinct word of the two becomes one code point, then the built-in distance applies. Two texts
    of more than 10**6 different words are refused, as there are no more code points."""
    a, b = tokens(hyp), tokens(ref)
    vocabulary = F.array_distinct(F.concat(a, b))

    def packed(words: Column, known: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(65536) + F.array_position(known, w)), 8, "0")), "UTF-32")), "")

    distance = lambda v: F.when(F.size(v) > 10**6, F.raise_error(F.lit("more than 10**6 different words")).cast("int")).otherwise(F.levenshtein(packed(a, v), packed(b, v)))
    return F.element_at(F.transform(F.array(vocabulary), distance), 1)


def rate(edits: Column, length: Column, hyp: Column, empty: str = "one") -> Column:
    """Edits per reference length. For an empty reference: `one` gives 0 if the hypothesis is empty too and else 1, `zero` gives 0, `edits` divides by 1."""
    if empty == "edits":
        return edits / F.greatest(length, F.lit(1))
    other = F.lit(0.0) if empty == "zero" else F.when(hyp == "", 0.0).otherwise(1.0)
    return F.when(length == 0, other).otherwise(edits / F.nullif(length, F.lit(0)))


def differing_chars(a: Column, b: Column) -> Column:
    """Positions at which the common length of two texts differs, plus their difference in length."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    n = F.least(F.length(a), F.length(b))
    at = F.zip_with(F.slice(chars(a), F.lit(1), n), F.slice(chars(b), F.lit(1), n), lambda x, y: (x != y).cast("int"))
    return F.aggregate(at, F.lit(0), lambda s, x: s + x) + F.abs(F.length(a) - F.length(b))


def exact_match(a: Column, b: Column) -> Column:
    """Equal but for case and white space at the ends."""
    return F.lower(stripped(a)) == F.lower(stripped(b))


def megabytes(size: Column) -> Column:
    return F.concat(F.format_number(size / 1e6, 1), F.lit(" MB"))


def percent(share: Column) -> Column:
    return F.concat(F.format_number(100 * share, 1), F.lit(" %"))


def bar(share: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("█"), F.round(share * width).cast("int"))
