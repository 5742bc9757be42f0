"""Text expressions: normalisation, tokens and n-grams, all JVM-side.

The one exception is :func:`unicode_fold`, an Arrow UDF for HTML entities and
compatibility characters, which Spark has no built-in for.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import as_column, blank_to_empty

# Unit words that are glued to the number before them.
UNITS = ["ml", "lt", "l", "kg", "gr", "g", "cm", "mm", "gb", "tb", "w", "mah"]
WORD = r"[\p{L}\p{N}_]"


def strip(c: str | Column) -> Column:
    """All leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(as_column(c), r"^\s+|\s+$", "")


def turkish_lower(c: str | Column) -> Column:
    """Dotted and dotless capital i folded before the general lower-casing."""
    return F.lower(F.translate(as_column(c), "İI", "iı"))


def normalize_basic(c: str | Column) -> Column:
    text = strip(turkish_lower(blank_to_empty(c)))
    text = F.regexp_replace(text, r"[/|>\\]+", " ")
    return F.regexp_replace(text, r"\s+", " ")


#: Texts that are Python strings at the same time, however many a batch holds.
FOLD_ROWS = 256


@F.arrow_udf(StringType())
def _fold_batch(values: pa.Array) -> pa.Array:
    def fold(first: int) -> pa.Array:
        texts = values.slice(first, FOLD_ROWS).to_pylist()
        return pa.array([None if v is None else unicodedata.normalize("NFKC", html.unescape(v)) for v in texts], pa.string())

    return pa.concat_arrays([fold(first) for first in range(0, len(values), FOLD_ROWS)] or [pa.array([], pa.string())])


def unicode_fold(c: str | Column) -> Column:
    """HTML entities resolved and NFKC applied.

    ASCII texts without an ampersand are their own fold; the Arrow function
    gets a null in their place.
    """
    text = as_column(c)
    return F.coalesce(_fold_batch(F.when(F.regexp(text, F.lit(r"[^\x00-\x7F]|&")), text)), text)


def normalize_search(c: str | Column, fold: bool = True, squeeze: bool = True) -> Column:
    """Search normalisation that keeps product codes and number+unit pairs.

    ``fold`` runs the Unicode step, ``squeeze`` shortens runs of four or more
    equal characters to two.
    """
    text = blank_to_empty(c)
    if fold:
        text = unicode_fold(text)
    text = turkish_lower(text)
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.translate(text, "’–—", "'--")
    text = F.regexp_replace(text, rf"(?<={WORD})'(?={WORD})", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-+]", " ")
    text = F.regexp_replace(text, rf"(\p{{Nd}})\s*({'|'.join(UNITS)})(?!{WORD})", "$1$2")
    if squeeze:
        text = F.regexp_replace(text, r"(.)\1{3,}", "$1$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_review(c: str | Column) -> Column:
    """Markup removed, links replaced by a word, blanks collapsed, lower case."""
    text = F.regexp_replace(blank_to_empty(c), r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", " URL ")
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def collapse(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(blank_to_empty(c), r"\s+", " "))


def words(c: str | Column) -> Column:
    """Whitespace words without empty strings."""
    return F.filter(F.split(as_column(c), r"\s+"), lambda w: w != "")


def tokens(c: str | Column) -> Column:
    """Runs of at least two word characters, lower case."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(rf"({WORD}{{2,}})"), F.lit(1))


def bigrams(toks: Column) -> Column:
    return F.when(
        F.size(toks) > 1,
        F.zip_with(
            F.slice(toks, F.lit(1), F.size(toks) - 1),
            F.slice(toks, F.lit(2), F.size(toks) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def char_ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of one word padded by a blank on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length(padded))
    return F.flatten(
        F.transform(
            sizes,
            lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, n)),
        )
    )


def word_set(c: str | Column) -> Column:
    return F.array_distinct(words(c))


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))
