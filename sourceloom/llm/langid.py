"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram is the product of its letters' vectors, each rotated by its place;
a text is the sum of its n-grams, and a language the sum of the unit vectors of its training texts.  A text gets the language
of the nearest prototype by cosine.  Letters are lower-cased characters of Unicode's letter categories; whatever stands
between them is one boundary symbol, which n-grams may begin or end with.

Training reads a sample of about ``rows_per_language`` labelled texts of each language, chosen by a hash of the row: a
documented bound on fitting.  Its vectors are summed by dimension in Spark; languages times dimensions numbers reach the driver.

Defined cases: null texts and texts without letters are ``und`` with score 0; ties go to the alphabetically first language;
without any training text everything is ``und``; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import spans_of

UNDETERMINED = "und"


class Profiles:
    """Text vectors for one seed and number of dimensions."""

    def __init__(self, dims: int, seed: int, block: int = 8_192, keep: int = 8_192):
        self.dims, self.seed, self.block, self.keep, self.known = dims, seed, block, keep, {}

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The random vectors of code points; 0 is the boundary symbol.  ``keep`` of them are remembered."""
        if len(self.known) > self.keep:
            self.known.clear()
        rows = []
        for p in points.tolist():
            if p not in self.known:
                bits = np.random.default_rng([self.seed, p]).integers(0, 2, self.dims, dtype=np.int8)
                self.known[p] = (2 * bits - 1).astype(np.int8)
            rows.append(self.known[p])
        return np.stack(rows)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One vector per text: the sum of its trigram vectors."""
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        coded = np.frombuffer((" " + " ".join([t.lower() for t in texts]) + " ").encode("utf-32-le", "replace"), dtype="<u4")
        used = np.flatnonzero(np.bincount(coded))
        alphabet = np.array([0] + [p for p in used.tolist() if chr(p).isalpha()], dtype=np.int64)
        table = np.zeros(int(used[-1]) + 1, dtype=np.int64)
        table[alphabet] = np.arange(len(alphabet))
        table[0] = 0
        symbols, base = table[coded], len(alphabet)
        owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])
        middle = np.flatnonzero(symbols[1:-1]) + 1
        grams = (symbols[middle - 1] * base + symbols[middle]) * base + symbols[middle + 1]
        keys, counts = np.unique(owner[middle - 1] * base**3 + grams, return_counts=True)
        for at in range(0, len(keys), self.block):
            docs, codes = np.divmod(keys[at:at + self.block], base**3)
            some, where = np.unique(codes, return_inverse=True)
            used, places = np.unique(np.stack([some // base**2, some // base % base, some % base]), return_inverse=True)
            letters = self.letters(alphabet[used])  # of this block only, however many letters the texts have
            a, b, c = places.reshape(3, -1)
            bound = np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]
            starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            weight = counts[at:at + self.block].astype(np.float32)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(docs)]):
                out[docs[a]] += weight[a:b] @ bound[where[a:b]].astype(np.float32)
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _bundles(dims: int, seed: int):
    def run(batches):
        import pyarrow as pa
        profiles, sums = Profiles(dims, seed), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in spans_of(texts, 200_000):
                units = _unit(profiles.vectors(texts[a:b]))
                for lang, unit in zip(langs[a:b], units):
                    sums[lang] = sums.get(lang, 0) + unit.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["lang", "bundle"])
    return run


def train(rows: DataFrame, lang: str = "lang", text: str = "text", dims: int = 1024, seed: int = 7,
          rows_per_language: int = 5_000) -> dict[str, np.ndarray]:
    """Unit prototype of every language among the labelled rows."""
    labelled = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = 1 << 20
    share = F.lit(0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, min(steps, -(-steps * rows_per_language // n))).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(steps)) < share)
    parts = chosen.mapInArrow(_bundles(dims, seed), "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out = {name: np.zeros(dims) for name in sorted(sizes)}
    for r in sums:
        out[r["lang"]][r["at"]] = r["v"]
    return {name: v / np.linalg.norm(v) for name, v in out.items() if v.any()}


def _predictions(prototypes: dict[str, np.ndarray], dims: int, seed: int):
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None

    def run(series):
        profiles = Profiles(dims, seed)
        for texts in series:
            texts = ["" if t is None else t for t in texts.tolist()]
            found = [(UNDETERMINED, 0.0)] * len(texts)
            for a, b in spans_of(texts, 200_000) if names else ():
                cosines = _unit(profiles.vectors(texts[a:b])) @ matrix.T
                best = cosines.argmax(axis=1)
                for k, (i, row) in enumerate(zip(best.tolist(), cosines)):
                    if row.any():
                        found[a + k] = (names[i], float(min(1.0, max(0.0, row[i]))))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dims: int = 1024, seed: int = 7,
            output: str = "language") -> DataFrame:
    """``docs`` with ``output``: struct of lang_pred and score (the cosine, negative ones as 0); only the text goes to Python."""
    run = _predictions(prototypes, dims, seed)

    def judge(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(series)

    return docs.withColumn(output, F.pandas_udf(judge, "lang_pred string, score double")(F.col(text)))


def keep(docs: DataFrame, least: float = 0.1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is determined with a cosine of ``least``; learned from four of five labelled rows."""
    prototypes = train(docs.filter(fold(doc_id, 5) != 0), lang, text)
    judged = predict(docs, prototypes, text, output="_language")
    return judged.filter((F.col("_language.lang_pred") != UNDETERMINED) & (F.col("_language.score") >= least)).drop("_language")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds
