"""The rule ledger against brute force."""

import re
from collections import Counter

from common import AWKWARD, awkward_documents, empty_documents

from sourceloom.llm import quality

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in BLANK.split(text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
TEXTS = AWKWARD + ["a b c a b c", "a a a a", "a a a", "x y z\nx y z\n x y z", "# * $ % & | < >", "one two three four one two three", "a b a b a b a",
                   "w " * 30_000, " ".join(map(str, range(20_000))) + " 1 2 3"]


def test_measurements(spark):
    docs = awkward_documents(spark, TEXTS)
    got = Counter(tuple(r[f] for f in FIELDS) for r in quality.ledger(docs).collect())
    assert got == Counter(brute(r["text"]) for r in docs.select("text").collect())


def test_policies_and_ablations(spark):
    rows = quality.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plain = rows.collect()
    names = list(quality.RULES)
    for policy in ("base", "v1", ("symbols",)):
        rules = quality.POLICIES.get(policy, policy) if isinstance(policy, str) else policy
        failed = [{n for k, n in enumerate(names) if r["failed"] >> k & 1} & set(rules) for r in plain]
        assert Counter(r["kept"] for r in quality.apply_policy(rows, policy).collect()) == Counter(not f for f in failed)
        for r in quality.ablations(rows, policy).collect():
            assert r["n_failed"] == sum(r["rule"] in f for f in failed)
            assert r["n_only"] == sum(f == {r["rule"]} for f in failed)
            assert r["n_kept_without"] == sum(not f - {r["rule"]} for f in failed)


def test_keep_agrees_with_ledger(spark):
    docs = awkward_documents(spark, TEXTS)
    kept = quality.keep(docs, "v1")
    assert kept.columns == docs.columns
    assert kept.count() == quality.apply_policy(quality.ledger(docs)).filter("kept").count()


def test_empty(spark):
    assert quality.ledger(empty_documents(spark)).count() == 0
    assert quality.ablations(quality.ledger(empty_documents(spark))).count() == 0
