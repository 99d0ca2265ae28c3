"""Text functions as column expressions.

White space is Unicode white space plus U+001C..1F, word boundaries and case are
Unicode aware; Java's defaults are not, hence the flags in every pattern.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = "(?U)[\\s\\x{1C}-\\x{1F}]+"
EDGE = "(?U)^[\\s\\x{1C}-\\x{1F}]+|[\\s\\x{1C}-\\x{1F}]+$"

# The English function words of the reference density.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "as", "with", "are", "by", "this", "on", "be", "it", "an", "or", "we",
    "which", "from", "at", "was", "were", "these", "can", "has", "have", "not", "but", "their", "such", "into", "than", "also", "how", "our", "its", "may",
)
# Fixed value: a line that opens a bibliography.
BIBLIOGRAPHY = "(?imuUd)^\\s*(?:#{1,6}\\s*)?(?:\\*+\\s*)?(references|bibliography|literature cited|works cited)\\b"
# Fixed value: the instruction that instruction-tuned embedders expect before a question.
INSTRUCTION = "Instruct: Given a question, retrieve the scientific paper passage that answers it\nQuery: "


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: an expression used inside a lambda is else computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """White space off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, EDGE, "")


def words(c: Column) -> Column:
    """Runs of anything but white space; null stays null, blank text gives no words."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Lower-case runs of ``[a-z0-9_]``; accented letters separate tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1)


def collapse(c: Column, length: int | None = None) -> Column:
    """White space runs as one blank, optionally the first ``length`` characters."""
    flat = F.regexp_replace(c, WS, " ")
    return F.substring(flat, 1, length) if length else flat


def snippet(c: Column, width: int = 240) -> Column:
    """The text, or its first ``width - 3`` characters and an ellipsis if it has ``width`` or more."""
    return F.when(F.length(c) >= width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def single_blank_pieces(c: Column) -> Column:
    """Pieces between single blanks: repeated blanks make empty pieces; an empty text has none (null)."""
    return F.when(c != "", F.size(F.split(c, " ", -1)))


def reference_density(c: Column) -> Column:
    """How much a chunk looks like a bibliography: initials and page ranges per hundred words, and missing function words."""
    n_words = F.greatest(word_count(c), F.lit(1))
    initials = F.regexp_count(c, F.lit("(?U)\\b[A-Z]\\."))
    ranges = F.regexp_count(c, F.lit("(?U)\\b\\d+\\s*[e\\-–]\\s*\\d+\\b"))
    letters = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    stops = F.size(F.filter(letters, lambda t: t.isin(*STOP_WORDS)))
    ratio = stops / F.greatest(F.size(letters), F.lit(1))
    return initials * 100.0 / n_words + ranges * 200.0 / n_words + F.greatest(F.lit(0.0), F.lit(0.18) - ratio) * 100.0


def is_reference_chunk(c: Column, threshold: float = 20.0, min_words: int = 8) -> Column:
    return (word_count(c) >= min_words) & (reference_density(c) >= threshold)


def cut_bibliography(c: Column) -> Column:
    """The text before the first line that opens with a bibliography heading (a prose line starting so cuts, too)."""
    return F.element_at(F.split(c, BIBLIOGRAPHY, 2), 1)


def slug(c: Column) -> Column:
    """Lower case, runs of other than ``[a-z0-9]`` as one underscore, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def table_name(corpus: Column, model: Column, chunker: Column | None = None) -> Column:
    return F.concat_ws("__", slug(corpus), slug(model), slug(chunker if chunker is not None else F.lit("fixed")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix only."""
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def unescape_html(c: Column) -> Column:
    """HTML entities decoded; the full entity table is not in the JVM functions."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.pandas_udf(run, StringType())(c)


def instructed(query: Column, model: Column, instruction: str = INSTRUCTION) -> Column:
    """The query with an instruction before it for models that want one; passages never get it."""
    return F.when(F.lower(model).contains("qwen3"), F.concat(F.lit(instruction), query)).otherwise(query)


def has_article(text: Column, number: Column, ordinal_aware: bool = False) -> Column:
    """Whether the text names article ``number``. By default "Artículo 2o." does not name article 2 (no word boundary after the digit)."""
    tail = "(?:\\b|[oa]\\b|[ºª°])" if ordinal_aware else "\\b"
    return F.regexp_like(text, F.concat(F.lit("(?iuU)Art[íi]culo\\s+"), number.cast("string"), F.lit(tail)))


def article_numbers(text: Column) -> Column:
    """The different article numbers that a text names, as ``has_article`` finds them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?iuU)Art[íi]culo\\s+(\\d+)\\b"), 1))


def article_number(source: Column) -> Column:
    """The first article number of a citation, or an empty string."""
    return F.regexp_extract(source, "Art\\.?\\s*(\\d+)", 1)


def markdown_stats(c: Column) -> dict[str, Column]:
    """Words, headings and table rows of a Markdown text."""
    return {
        "n_words": word_count(c).cast("long"),
        "n_headings": F.regexp_count(c, F.lit("(?m)^#{1,6}\\s")).cast("long"),
        "n_table_rows": F.regexp_count(c, F.lit("(?m)^\\s*\\|.*\\|\\s*$")).cast("long"),
    }
