"""Text expressions of built-in functions alone: they stay in the JVM, though lambdas in them are interpreted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.plain import DEFINITION, STOPWORDS

WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"
CONFIDENT, LIKELY = 0.8, 0.4


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits in order, repeats kept; null stays null and empty text gives []."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda x: x != "")


def compact(text: Column) -> Column:
    """Lower case with letters and digits only."""
    return F.regexp_replace(F.lower(text), WORD_BREAK, "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int = 220) -> Column:
    """Collapsed text of at most `most` characters; a longer one ends with three dots."""
    flat = collapse(text)
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def simple_snippet(text: Column, most: int = 160) -> Column:
    """First `most` characters of the text with lines collapsed and empty lines dropped."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: collapse(x)), lambda x: x != "")
    flat = F.array_join(lines, "\n")
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def phrases(tokens: Column, most: int = 4) -> Column:
    """Distinct runs of 2 to `most` tokens joined by spaces, sorted; fewer than two tokens give []."""
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.lit(most)),
            lambda n: F.when(n <= F.size(tokens), F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(runs)))


def significant(tokens: Column) -> Column:
    """Tokens of more than one byte that are neither ASCII digits alone nor stop words."""
    return F.filter(tokens, lambda x: (F.octet_length(x) > 1) & ~x.rlike("^[0-9]+$") & ~x.isin(*STOPWORDS))


def safe_component(text: Column) -> Column:
    """A name for a synthetic path: other characters become `_`, none of which stay at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9\-_.]", "_"), r"^_+|_+$", "")


def safe_doc_id(text: Column) -> Column:
    return F.translate(text, "/\\:\0", "____")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def shown_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def confidence(score: Column) -> Column:
    return F.when(score > CONFIDENT, F.lit("high")).when(score > LIKELY, F.lit("medium")).otherwise(F.lit("low"))


def clamp_signal(score: Column, ceiling: float) -> Column:
    """score / ceiling within 0 and 1; what is not finite, or a ceiling that is not positive, gives 0."""
    if ceiling <= 0:
        return F.lit(0.0)
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.greatest(score / ceiling, F.lit(0.0)), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; arrays of unequal length give null."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def looks_like_definition(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+", "")).rlike("^" + DEFINITION.pattern)
