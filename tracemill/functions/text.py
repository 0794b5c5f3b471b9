"""Text functions over columns: normalizing, titles, snippets, paths, tags."""

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters that search folds to plain ones, and those that it ignores.
SINGLE_QUOTES = "‘’‚‛′‵ʼ"
DOUBLE_QUOTES = "“”„‟″‶«»"
DASHES = "‐‑‒–—―−"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

#: Characters that NFKC leaves as they are, whatever stands beside them: ASCII, and letters and signs of Latin without a fold.
STABLE = "\\x00-\\x7F¡-§©«¬®°±¶·»¿-ÿĀ-ıĴ-ľŁ-ňŊ-ž"
SPACES = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _folded(text: Column) -> Column:
    plain = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + INVISIBLE, plain)


def single_spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_search_text(text: Column) -> Column:
    """quotes, dashes and invisible signs folded, NFKC, folded again, lower case, single-spaced.

    Only texts with a sign that NFKC might change are handed to Python; of all others it gets a null.
    """
    folded = _folded(text)
    composed = _folded(_nfkc(F.when(folded.rlike(f"[^{STABLE}]"), folded)))
    return single_spaced(F.lower(F.coalesce(composed, folded)))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield lists.map(lambda xs: [None if x is None else unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")


def normalize_search_texts(texts: Column) -> Column:
    """F1 of each text of an array, whose row stays where it is; arrays without a text for Python are handed over as nulls."""
    odd = lambda x: x.rlike(f"[^{STABLE}]")
    folded = F.transform(texts, _folded)
    composed = _nfkc_each(F.when(F.exists(folded, odd), F.transform(folded, lambda x: F.when(odd(x), x))))
    whole = lambda x, y: single_spaced(F.lower(F.coalesce(_folded(y), x)))
    return F.when(composed.isNull(), F.transform(folded, lambda x: single_spaced(F.lower(x)))).otherwise(F.zip_with(folded, composed, whole))


_FOLDS = str.maketrans({**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict.fromkeys(DASHES, "-"), **dict.fromkeys(INVISIBLE, None)})


def normalized(text: str) -> str:
    """F1 of one text, such as a query."""
    return " ".join(unicodedata.normalize("NFKC", text.translate(_FOLDS)).translate(_FOLDS).lower().split())


def normalize_plain(text: Column) -> Column:
    """F1 for text known to be NFKC already and free of folded signs: no Python."""
    return single_spaced(F.lower(text))


def short_title(text: Column, most: int = 100) -> Column:
    """single-spaced, cut at ``most`` characters with an ellipsis."""
    flat = single_spaced(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def clip(text: Column, most: int) -> Column:
    """at most ``most`` characters, the last an ellipsis if cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def short_path(path: Column) -> Column:
    """F8: a path of at most two parts, or its last two after an ellipsis."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit(".../"), F.concat_ws("/", F.slice(parts, -2, 2))))


def decode_directory(name: Column) -> Column:
    """the working directory that a dashed directory name stands for, every dash being a slash."""
    return F.regexp_replace(name, "-", "/")


def strip_tags(text: Column) -> Column:
    """without ``<...>`` tags, trimmed."""
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def slug(text: Column, most: int = 60) -> Column:
    """lower-case letters and digits joined by dashes; ``session`` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")
    return F.when(cut == "", "session").otherwise(cut)


def count_occurrences(text: Column, needle: Column) -> Column:
    """F16: non-overlapping occurrences; none for an empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(gone / F.length(needle))).otherwise(F.lit(0)).cast("long")


def snippet(text: Column, at: Column, size: Column, before: int = 50, after: int = 70) -> Column:
    """the surroundings of a match at 1-based ``at``, single-spaced, with an ellipsis where the start is cut."""
    begin = F.greatest(at - before, F.lit(1))
    flat = single_spaced(F.substring(text, begin, at - begin + size + after))
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), flat))


def call_id_parts(text: Column) -> tuple[Column, Column]:
    """an id and what follows it after a line feed."""
    return F.split_part(text, F.lit("\n"), F.lit(1)), F.split_part(text, F.lit("\n"), F.lit(2))


def instruction_label(role: Column, text: Column) -> Column:
    """what kind of instructions a text is, by how it begins, else by its role."""
    flat = F.ltrim(text)
    return (
        F.when(F.startswith(flat, F.lit("<environment_context>")), "Environment context").when(F.startswith(flat, F.lit("<user_instructions>")), "User instructions (AGENTS.md)")
        .when(role == "developer", "Developer instructions").when(role == "system", "System prompt").otherwise("Context")
    )


def error_text(name: Column, message: Column) -> Column:
    """``name: message``, or what there is of it."""
    return F.concat_ws(": ", F.nullif(name, F.lit("")), F.nullif(message, F.lit("")))


def summary_parts(parts: Column) -> Column:
    """texts of an array<struct<type, text>> of summary parts, blank ones left out, a blank line between."""
    texts = F.transform(F.filter(parts, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != ""), lambda x: x["text"])
    return F.array_join(texts, "\n\n")
