"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and stores one bit per failed rule.  A policy is a version name and the set of
rules that reject; policies, what-if policies and ablations work on the stored bits and never read the texts again.

Defined cases: a null text is a document without words; ties do not occur; repeated rows are judged one by one; an empty
table gives an empty ledger.  Words are runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Rules in bit order: a rule holds where the document fails it.  Ratios are integer comparisons.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "symbols": lambda m: 4 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"],
    "no_words": lambda m: m["n_words"] == 0,
}

# Versioned policies: which rules reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three that occurs at least twice in the text."""
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        # a repeated window adds three words, or fewer where the next one begins sooner; least() skips the missing next
        return let(F.sort_array(twice), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(3), F.get(at, j + 1) - p)), F.lit(0), lambda total, n: total + n))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))))


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, BLANKS), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"))))


def failures(m: Column) -> Column:
    """The failure bits of a struct of measurements."""
    return reduce(Column.bitwiseOR, [F.when(rule(m), F.lit(1 << k)).otherwise(0).cast("long") for k, rule in enumerate(RULES.values())])


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit k is set where rule k fails.  One projection, no shuffle."""
    entry = let(measurements(F.col(text)), lambda m: F.struct(m.alias("m"), failures(m).alias("failed")))
    return docs.select(F.col(doc_id).alias("doc_id"), entry.alias("_e")).select("doc_id", "_e.m.*", "_e.failed")


def keep(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule of the policy rejects."""
    return docs.filter(let(measurements(F.col(text)), lambda m: failures(m).bitwiseAND(_policy_mask(policy)) == 0))


def _policy_mask(policy: str | tuple[str, ...]) -> int:
    return mask(POLICIES[policy] if isinstance(policy, str) else policy)


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """A ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(_policy_mask(policy)) == 0)


def ablations(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, rejected by it alone, and kept if it were dropped.

    The bit words are counted first, at most one row for each that occurs, so the ledger is read and shuffled once.
    """
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    full, names = mask(rules), list(RULES)
    words = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                                   for r in sorted(set(rules))])).alias("r")
    hit = F.col("failed").bitwiseAND(full)
    without = F.col("failed").bitwiseAND(F.lit(full).cast("long").bitwiseXOR(F.col("r.bit")))
    return words.select("n", "failed", per_rule).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))
