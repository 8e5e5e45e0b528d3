"""Language by hierarchy: first the family, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased text, letters only, as square roots of counts
at unit length; they cover the whole text. Both levels are linear support vector machines, learned
by dual coordinate descent, in one task of the cluster. Training uses up to `per_language` different
texts of each of the thousand commonest languages, those with the smallest hashes and at most `longest`
bytes; these bounds are parameters.

A null text, or one without a letter, is `und` with score 0. Rows whose language is null teach
nothing. Without any labelled row every text is `und`. Ties between languages go to the first by
name. Repeated rows are judged one by one, and rows without an id teach like others; other columns are
ignored, and passed on by `keep`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import remainder, sample, text_hash, trained
from bookloom.llm.wordhash import portions

#: Families of related languages; a language not named here is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic",
            "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance",
            "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic"}
SIZE = 8192
#: Bytes of text that a task judges at once.
PORTION = 500_000
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and all bytes of other letters stay, the rest becomes a blank.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", np.uint8)
    a = raw.astype(np.uint32)
    code = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
    code = code[(raw[:-2] != 32) | (raw[1:-1] != 32)]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=SIZE)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


Sparse = tuple[np.ndarray, np.ndarray]


def sparse(text: str) -> Sparse:
    """Places and values of a text's features."""
    x = features(text)
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at]


def linear_svm(x: list[Sparse], y: np.ndarray, cost: float = 10.0, rounds: int = 25) -> np.ndarray:
    """Weights of a hinge-loss SVM for labels -1 and 1, by dual coordinate descent."""
    rng, w, alpha = np.random.default_rng(0), np.zeros(SIZE, np.float32), np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, values = x[i]
            g = y[i] * float(values @ w[at]) - 1
            new = min(max(alpha[i] - g, 0.0), cost)  # rows have unit length
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * values
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """groups: family -> its languages; weights: (a, b) -> weights that are positive for a."""

    groups: dict[str, list[str]]
    families: dict[tuple[str, str], np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def best(self, names: list[str], weights: dict, x: np.ndarray) -> tuple[str, float]:
        """Most pairwise wins, then margin, then name; with its least sure win as a probability."""
        if len(names) == 1:
            return names[0], 1.0
        wins, least = dict.fromkeys(names, 0), dict.fromkeys(names, np.inf)
        total = dict.fromkeys(names, 0.0)
        for (a, b), w in weights.items():
            if a in wins and b in wins:
                m = float(x @ w)
                wins[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        top = min(names, key=lambda n: (-wins[n], -total[n], n))
        return top, 1 / (1 + np.exp(-3 * least[top]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.groups or not LETTER.search(text):
            return "und", 0.0
        x = features(text)
        family, p = self.best(sorted(self.groups), self.families, x)
        lang, q = self.best(self.groups[family], self.pairs, x)
        return lang, float(p * q)


def train(labelled: DataFrame, per_language: int = 800, longest: int = 20_000) -> Model:
    """labelled: text, lang. The fit runs in one task of the cluster, on the bounded sample."""
    rows = labelled.where("text is not null and lang is not null").where(
        F.octet_length("text") <= longest)
    hashes = rows.select(F.col("lang").alias("label"), text_hash().alias("h"))
    return trained(sample(hashes, rows, F.lit(per_language)), fit)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: lang, text."""
    rows = [(lang, t) for lang, t in rows if LETTER.search(t)]
    langs = sorted({lang for lang, _ in rows})
    family = {lang: FAMILIES.get(lang, lang) for lang in langs}
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family[lang], []).append(lang)
    x = [sparse(t) for _, t in rows]
    y = np.array([lang for lang, _ in rows], object)
    f = np.array([family[lang] for lang in y], object)

    def machines(labels: np.ndarray, names: list[str]) -> dict:
        out = {}
        for a, b in itertools.combinations(sorted(names), 2):
            of = (labels == a) | (labels == b)
            out[a, b] = linear_svm([x[i] for i in np.flatnonzero(of)], np.where(labels[of] == a, 1.0, -1.0))
        return out

    pairs: dict = {}
    for names in groups.values():
        pairs |= machines(y, names)
    return Model(groups, machines(f, list(groups)), pairs)


def identify(docs: DataFrame, model: Model, names: tuple[str, str]) -> DataFrame:
    """All columns of docs, and the language and its score by the names given."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, at, PORTION):
                found = [shared.value.predict(t) for t in part.column(at).to_pylist()]
                yield pa.record_batch(
                    [*part.columns, pa.array([p for p, _ in found], pa.string()),
                     pa.array([s for _, s in found], pa.float64())], [*b.schema.names, *names])

    return docs.mapInArrow(judge, schema)


def held_out() -> Column:
    """A null id is not held out."""
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def keep(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows of docs with a language, unchanged: not `und`, and a score of `least` or more."""
    names = tuple(next(f"{base}{k}" for k in itertools.count() if f"{base}{k}" not in docs.columns)
                  for base in ("_lang", "_score"))
    found = identify(docs, train(docs.where(~held_out())), names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*docs.columns)


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    names = ("lang_pred", "score")
    found = identify(docs.select("doc_id", "text"), train(docs.where(~held_out())), names)
    return found.select("doc_id", held_out().alias("held_out"), *names)
