"""Language identification: the family first, then the language within it.

A text's features are the shares of its byte pairs, after lower-casing A-Z and
reading every other ASCII character as a blank.  Linear classifiers score their
mean over the text: first one-versus-rest among the families that were learned,
then, within the winner, a one-versus-one linear support vector machine for
each pair of languages, by votes and, where these tie, by margins.  The score
is the logistic of the smallest winning margin.

Learning uses at most ``EXAMPLES`` texts of a language (those whose ids hash
lowest, one text an id, of ``EXAMPLE_BYTES`` at most), so it is bounded; languages may be any, and those without a known
family form one of their own.  A null text or one without a letter is ``und``
with score 1; where nothing could be learned every text is ``und`` with score
0.  Rows with a null doc_id are predicted, but never learned from.  An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import crc_mod, for_workers, hash_sample, table

EXAMPLES = 400  # texts learned from, of each language
EXAMPLE_BYTES = 1 << 16  # longer texts are predicted, but not learned from
HELD_OUT = 4  # op9: rows with crc32(doc_id) mod 4 = 2
UNKNOWN = "und"

# Families of languages (ISO 639 codes); fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "hr", "sr", "sl"),
    "uralic": ("fi", "hu", "et"),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}

_LETTER = re.compile(r"[^\W\d_]")
# Byte classes: 0 blank, 1-26 a-z, 27-154 the bytes beyond ASCII.
_CLASS = bytes([(c | 32) - 96 if chr(c).isascii() and chr(c).isalpha() else c - 101 if c >= 128 else 0 for c in range(256)])
_CLASSES = 155
N_FEATURES = _CLASSES * _CLASSES


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def pair_codes(text: bytes) -> np.ndarray:
    """The byte pairs of a text as numbers below N_FEATURES, blanks around it."""
    kind = np.frombuffer(b"\0" + text.translate(_CLASS) + b"\0", np.uint8).astype(np.int32)
    codes = kind[:-1] * _CLASSES + kind[1:]
    return codes[codes > 0]  # two blanks say nothing


@dataclass
class LinearModels:
    """One-versus-one (or -rest) separators; positive margins speak for ``first``."""

    names: list[str]
    first: list[int] = field(default_factory=list)
    second: list[int] = field(default_factory=list)  # -1: the rest
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, N_FEATURES + 1)))

    def decide(self, margins: np.ndarray) -> tuple[int, float]:
        if len(self.names) == 1:
            return 0, np.inf
        votes, sums, low = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for m, a, b in zip(margins, self.first, self.second):
            votes[a if m >= 0 else b] += b >= 0
            sums[a] += m
            low[a] = min(low[a], m)
            if b >= 0:
                sums[b] -= m
                low[b] = min(low[b], -m)
        best = int(np.lexsort((sums, votes))[-1])
        return best, float(low[best])


@dataclass
class LanguageModel:
    families: LinearModels
    within: dict[str, LinearModels]
    weights: np.ndarray | None = None  # all separators' weights, one column each, the intercepts last

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not _LETTER.search(text):
            return UNKNOWN, 1.0
        if self.weights is None:
            return UNKNOWN, 0.0
        margins = self.weights[pair_codes(text.encode())].mean(axis=0) + self.weights[-1]
        at = len(self.families.first)
        best, margin = self.families.decide(margins[:at])
        for name, models in self.within.items():
            n = len(models.first)
            if name == self.families.names[best]:
                lang, inner = models.decide(margins[at:at + n])
                margin = min(margin, inner)
                return models.names[lang], float(1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))
            at += n
        raise AssertionError("every family has languages")


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, seed: int = 9, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent on sparse rows (places
    and values) of vectors of ``size``; a constant is among the features."""
    rng, alpha, w = np.random.default_rng(seed), np.zeros(len(y)), np.zeros(size)
    norm = np.array([v @ v for _, v in x]) + 0.5 / cost
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(y)):
            at, value = x[i]
            gradient = y[i] * (value @ w[at]) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


def _separators(names: list[str], pairs: list[tuple[int, int]], x: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray,
                size: int) -> LinearModels:
    models, weights = LinearModels(names), []
    for a, b in pairs:
        use = np.flatnonzero(np.isin(label, [a, b]) if b >= 0 else np.ones(len(label), bool))
        models.first.append(a)
        models.second.append(b)
        weights.append(train_svm([x[i] for i in use], np.where(label[use] == a, 1.0, -1.0), size))
    if weights:
        models.weights = np.array(weights)
    return models


def train(examples: list[tuple[str, str]]) -> LanguageModel:
    """From (language, text) pairs."""
    coded = [(lang, pair_codes(text.encode())) for lang, text in examples]
    coded = [(lang, codes) for lang, codes in coded if len(codes)]
    langs = [lang for lang, _ in coded]
    if not coded:
        return LanguageModel(LinearModels([]), {})
    # sparse rows: a text has few of all pairs, and languages may be many
    rows = [np.unique(codes, return_counts=True) for _, codes in coded]
    used, place = np.unique(np.concatenate([at for at, _ in rows]), return_inverse=True)
    shares = [n / n.sum() for _, n in rows]
    mean = np.bincount(place, np.concatenate(shares)) / len(rows)
    # rare pairs count as much as frequent ones of the same spread; unseen pairs weigh nothing
    scale = 1 / np.sqrt(mean * len(used))
    ends = np.cumsum([len(s) for s in shares])[:-1]
    size = len(used) + 1  # with the constant
    z = [(np.append(at, len(used)), np.append(share * scale[at], 1.0)) for at, share in zip(np.split(place, ends), shares)]
    names = sorted({family_of(lang) for lang in langs})
    family = np.array([names.index(family_of(lang)) for lang in langs])
    outer = [(0, 1)] if len(names) == 2 else [(i, -1) for i in range(len(names))] if len(names) > 2 else []
    model = LanguageModel(_separators(names, outer, z, family, size), {})
    for i, name in enumerate(names):
        inner = sorted({lang for lang in langs if family_of(lang) == name})
        label = np.array([inner.index(lang) if lang in inner else -2 for lang in langs])
        model.within[name] = _separators(inner, list(combinations(range(len(inner)), 2)),
                                           [z[j] for j in np.flatnonzero(family == i)], label[family == i], size)
    parts = [m.weights for m in [model.families, *model.within.values()] if len(m.first)]
    model.weights = np.zeros((N_FEATURES + 1, sum(map(len, parts))))
    if parts:
        found = np.vstack(parts)
        model.weights[used] = (found[:, :-1] * scale).T
        model.weights[-1] = found[:, -1]
    for m in [model.families, *model.within.values()]:
        m.weights = np.zeros((0, 0))  # only the joint table goes to the tasks
    return model


def learn(docs: DataFrame, usable: Column) -> LanguageModel:
    """The model of a bounded sample of the rows that meet ``usable``."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).where(
        usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    marked = marked.where(F.octet_length("text") <= EXAMPLE_BYTES)
    one = marked.select("doc_id", "lang").groupBy("doc_id").agg(F.min("lang").alias("lang"))  # an id may have many rows
    drawn = {r["doc_id"]: r["lang"] for r in hash_sample(one, "lang", EXAMPLES)}
    if not drawn:
        return train([])
    texts = (marked.where(F.col("doc_id").isin(list(drawn))).groupBy("doc_id", "lang")
             .agg(F.min_by("text", F.sha2("text", 256)).alias("text")).collect())  # one bounded text an id and language
    return train([(r["lang"], r["text"]) for r in sorted(texts) if drawn[r["doc_id"]] == r["lang"]])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row a document: doc_id, lang_pred, score."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "lang_pred": pd.Series([f[0] for f in found], dtype=object),
                                "score": np.array([f[1] for f in found], float)})

    return (for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInPandas(run, "doc_id long, lang_pred string, score double"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), HELD_OUT) == 2
    return identify(docs, learn(docs, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")
