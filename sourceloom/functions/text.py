"""Column helpers for text: whitespace, words, terms, hashes, passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words and character ranges of the term rules.
SEARCH_STOPWORDS = ["the", "and", "for", "that", "with", "find", "provide",
                    "source", "record", "target", "evidence"]
EVIDENCE_STOPWORDS = ["the", "and", "that", "this", "with", "from", "before", "after",
                      "until", "has", "have", "had", "was", "were", "will"]
CJK = "㐀-䶿一-鿿"
SPACE = r"(?U)[\s\x1c-\x1f]+"
LEAD = r"(?U)^[\s\x1c-\x1f]+"
TAIL = r"(?U)[\s\x1c-\x1f]+$"
WORD = r"[\p{L}\p{N}_]+"


def norm_ws(c: Column) -> Column:
    """Runs of Unicode whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    return F.lower(c)


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def word_norm(c: Column) -> Column:
    """Lower-cased words joined by one space."""
    return F.array_join(words(c), " ")


def contains_phrase(text_norm: Column, phrase_norm: Column) -> Column:
    """Phrase on word boundaries; both sides already went through ``word_norm``."""
    sp = F.lit(" ")
    return F.contains(F.concat(sp, text_norm, sp), F.concat(sp, phrase_norm, sp))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def record_fingerprint(**fields: Column) -> Column:
    """Hash of a record; the fields are taken in name order, nulls kept distinct."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def _grams(run: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (width - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: run.substr(i, F.lit(width)))
    return F.filter(grams, lambda g: F.length(g) == width)


def _cjk_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), 0)


def search_terms(c: Column) -> Column:
    """Distinct routing terms: Latin words of three or more, CJK 1- to 3-grams."""
    low = F.lower(c)
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}"), 0),
                     lambda t: ~t.isin(SEARCH_STOPWORDS))
    cjk = F.flatten(F.transform(_cjk_runs(low), lambda r: F.concat(
        _grams(r, 1), _grams(r, 2), _grams(r, 3))))
    return F.array_distinct(F.concat(latin, cjk))


def evidence_terms(c: Column) -> Column:
    """Distinct grounding terms: Latin words, numbers and percents; CJK 2- and 3-grams."""
    latin = F.array_except(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9%]{3,}"), 0), F.array(*[F.lit(w) for w in EVIDENCE_STOPWORDS]))
    cjk = F.flatten(F.transform(_cjk_runs(c), lambda r: F.when(
        F.length(r) == 1, F.array(r)).otherwise(F.concat(_grams(r, 2), _grams(r, 3)))))
    return F.when(F.octet_length(c) == F.length(c), latin).otherwise(F.array_distinct(F.concat(latin, cjk)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """Running start offset of each piece from the piece lengths."""
    return lengths.map(lambda v: (np.cumsum(v) - v).astype("int32"))


# Fixed value: where a sentence ends.
SENTENCE_END = r"([.!?])(?=\s+(?:[A-Z0-9\[(]|The\b|In\b|Source\b|Scope\b))"
_MARK = "\x01"


def sentence_passages(df: DataFrame, id_col: str, text_col: str, min_chars: int = 24) -> DataFrame:
    """One row per sentence passage with exact code-point offsets, end exclusive.

    Sentences end at punctuation that is followed by a plausible next token.
    Fragments under ``min_chars`` are left out; a text without any passage is
    returned whole.  Only the array of piece lengths crosses into Python.
    """
    text = F.col(text_col)
    pieces = df.filter(~is_blank(text)).select(
        id_col, text_col, F.split(F.regexp_replace(text, SENTENCE_END, "$1" + _MARK), _MARK).alias("_p"))
    pieces = pieces.withColumn("_s", _starts(F.transform("_p", lambda p: F.length(p))))
    trimmed = F.transform(F.arrays_zip("_p", "_s"), lambda z: F.struct(
        (z["_s"] + F.length(z["_p"]) - F.length(F.regexp_replace(z["_p"], LEAD, ""))).alias("start"),
        F.regexp_replace(F.regexp_replace(z["_p"], LEAD, ""), TAIL, "").alias("text")))
    kept = F.filter(trimmed, lambda t: F.length(F.regexp_replace(t["text"], r"(?U)\s+", " ")) >= min_chars)
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    rows = pieces.select(id_col, F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(whole)).alias("pos", "t"))
    number = F.col("pos") + 1
    return rows.select(
        id_col,
        F.concat(F.lit("p"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0"))
                 .otherwise(number.cast("string"))).alias("passage_id"),
        F.col("t.start").alias("start"),
        (F.col("t.start") + F.length("t.text")).alias("end"),
        F.col("t.text").alias("text"))
