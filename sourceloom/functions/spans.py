"""Column helpers for quotes and spans. Offsets are code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_ws


def quote_in_content(quote: Column, content: Column) -> Column:
    """Containment after whitespace normalisation on both sides."""
    return F.contains(norm_ws(content), norm_ws(quote))


def first_index(quote: Column, content: Column) -> Column:
    """Zero-based first position, -1 when absent or when the quote is empty."""
    return F.when(F.length(quote) > 0, F.call_function("locate", quote, content) - 1).otherwise(F.lit(-1))


def occurs_once(quote: Column, content: Column) -> Column:
    """True for exactly one occurrence; overlapping repeats count as repeats."""
    first = first_index(quote, content)
    again = F.call_function("locate", quote, content, first + 2)
    return F.coalesce((first >= 0) & (again == 0), F.lit(False))


def span_ok(start: Column, end: Column, quote: Column, content: Column) -> Column:
    """The stated offsets lie inside the content and cut out exactly the quote."""
    inside = (start >= 0) & (start < end) & (end <= F.length(content))
    return F.coalesce(inside & (content.substr(start + 1, end - start) == quote), F.lit(False))


def repaired_start(start: Column, end: Column, quote: Column, content: Column) -> Column:
    """Given start when valid, else the start of a verbatim unique quote, else null."""
    return F.when(span_ok(start, end, quote, content), start).when(
        occurs_once(quote, content), first_index(quote, content))


def qualifier_offset(parent_quote: Column, qualifier: Column) -> Column:
    """Offset inside the parent quote when the qualifier occurs there once, else null."""
    return F.when(occurs_once(qualifier, parent_quote), first_index(qualifier, parent_quote))


def _loose(quote: Column) -> Column:
    """Pattern for the quote with any run of whitespace between its words."""
    trimmed = F.regexp_replace(F.regexp_replace(quote, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    safe = F.replace(trimmed, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    body = F.regexp_replace(safe, r"(?U)\s+", r"\\E\\s+\\Q")
    return F.concat(F.lit("(?U)\\Q"), body, F.lit("\\E"))


def _overlapping(pattern: Column, content: Column) -> Column:
    return F.regexp_count(content, F.concat(F.lit("(?="), pattern, F.lit(")")))


def recovered_text(quote: Column, content: Column, min_prefix: int = 40) -> Column:
    """The source text a quote stands for, or null.

    An exact unique quote stands for itself.  Otherwise a unique match up to
    whitespace is taken; when there is none at all, ever shorter sentence
    prefixes of at least ``min_prefix`` characters are tried.
    """
    parts = F.split(F.regexp_replace(F.trim(quote), r"(?<=[.!?])(?U)\s+", "\x01"), "\x01")
    shorter = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, 1, n), " "))).otherwise(F.array().cast("array<string>"))
    long_enough = F.filter(shorter, lambda p: F.length(p) >= min_prefix)
    prefix = F.get(F.filter(long_enough, lambda p: _overlapping(_loose(p), content) == 1), F.lit(0))
    hits = _overlapping(_loose(quote), content)
    return (F.when(F.coalesce(F.length(quote), F.lit(0)) == 0, F.lit(None).cast("string"))
            .when(occurs_once(quote, content), quote)
            .when(hits == 1, F.regexp_substr(content, _loose(quote)))
            .when((hits == 0) & prefix.isNotNull(), F.regexp_substr(content, _loose(prefix))))


def adjacent_quotes(first: Column, second: Column, content: Column, max_gap: int = 8) -> Column:
    """Both quotes occur once and only a little whitespace lies between them."""
    a, b = first_index(first, content), first_index(second, content)
    left_end = F.when(a <= b, a + F.length(first)).otherwise(b + F.length(second))
    right = F.greatest(a, b)
    between = content.substr(left_end + 1, right - left_end)
    return (occurs_once(first, content) & occurs_once(second, content) & (left_end <= right)
            & (right - left_end <= max_gap) & ~between.rlike(r"(?U)[^\s\x1c-\x1f]"))


def literal_anchor(text: Column, phrase: Column) -> Column:
    """The literal text matching the phrase's words, any punctuation between them."""
    body = F.array_join(F.regexp_extract_all(phrase, F.lit(r"(?U)\w+"), 0), r"[\W_]+")
    found = F.regexp_substr(text, F.concat(F.lit(r"(?iU)(?<!\w)"), body, F.lit(r"(?!\w)")))
    return F.when(F.length(body) > 0, found)


def doi_anchor(text: Column, doi: Column) -> Column:
    """The complete identifier in the text; longer identifiers with this prefix do not count."""
    return F.regexp_substr(text, F.concat(
        F.lit(r"(?iU)(?<![\w/])\Q"), doi, F.lit(r"\E(?![\w/.:;-])")))
