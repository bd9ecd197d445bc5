"""Quality classifier: ridge regression on random Fourier features.

A text becomes a few statistics of its bytes, words and lines.  Standardised
over all documents, they pass through random Fourier features that approximate
a Gaussian kernel.  The normal equations of the ridge regression are sums over
rows: every partition sums its own, the sums of the partitions are added by
row of the matrix, and only the finished system reaches the driver, whose size
does not depend on the data.  Isotonic regression over a fixed grid of raw
scores turns these into probabilities.

All labelled training rows are used.  A document with several labels counts
with their mean.  A null text is empty; a row with a null doc_id is scored like
any other, but never learned from.  Without labels every score is 0.5, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import crc_mod, for_workers, table, written

THRESHOLD = 0.3
FOURIER = 200  # random features
KERNEL_WIDTH = 3.0  # in standard deviations of a statistic
RIDGE = 1.0
SEED = 8
GRID = 1000  # cells of a unit of raw score for the calibration
LIMIT = 4.0  # standardised statistics beyond it count as it
BRANCH = 256  # partitions whose sums are added together at first
SUMS_SCHEMA = "row int, branch int, sums array<double>"
HELD_OUT = 5  # op8: rows with crc32(doc_id) mod 5 = 0

STATISTICS = ("log_bytes", "upper", "digits", "symbols", "commas", "blanks", "log_lines", "line_repeats", "word_bytes",
              "distinct_words", "symbol_pairs", "symbol_ends", "lone_symbols", "non_ascii", "entropy")

# Kinds of bytes: 0 others, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 beyond ASCII.
_KIND = bytearray(256)
for _kind, _chars in ((6, bytes(range(33, 127))), (1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                      (3, b"0123456789"), (4, b" \t\n\r\v\f"), (5, b".,;:?'\"()-"), (7, bytes(range(128, 256)))):
    for _c in _chars:
        _KIND[_c] = _kind
_KIND = bytes(_KIND)


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text (UTF-8), in the order of STATISTICS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    kind = np.frombuffer(text.translate(_KIND), np.uint8)
    share = np.bincount(kind, minlength=8) / n
    raw = np.frombuffer(text, np.uint8)
    used = np.bincount(raw)
    used = used[used > 0] / n
    symbol, blank = kind == 6, kind == 4
    words, lines = text.lower().split(), text.split(b"\n")
    n_words = max(1, len(words))
    after = np.append(blank[1:], True)
    before = np.append(True, blank[:-1])
    return [
        np.log1p(n), share[2] / max(1e-9, share[1] + share[2]), share[3], share[6], share[5], share[4],
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), min(50.0, n * (1 - share[4]) / n_words),
        len(set(words)) / n_words, np.count_nonzero(symbol[1:] & (raw[1:] == raw[:-1])) / n,
        np.count_nonzero(symbol & after) / n_words, np.count_nonzero(symbol & after & before) / n_words,
        share[7], -float(np.sum(used * np.log(used))),
    ]


def _statistics_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                            "x": [statistics(t or b"") for t in pdf["text"]]})


def document_statistics(docs: DataFrame) -> DataFrame:
    return (for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInPandas(_statistics_batches, "doc_id long, x array<double>"))


# ---- the model ---------------------------------------------------------------------------

@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None  # with the intercept last; None: nothing was learned
    grid: np.ndarray | None = None  # calibration: raw scores, and the probability at each
    chance: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.grid, self.chance)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), len(STATISTICS))


def _normal_equations(model: QualityModel):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                z = model.features(_matrix(pdf["x"]))
                part = z.T @ np.column_stack([z, pdf["y"].to_numpy(float)])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "branch": TaskContext.get().partitionId() // BRANCH, "sums": list(total)})

    return run


def _add_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [key[0]], "branch": [pdf["branch"].iloc[0] // BRANCH], "sums": [np.sum(pdf["sums"].tolist(), axis=0)]})


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, learn: Column) -> QualityModel:
    """``stats`` (doc_id, x) of all documents, ``labels`` (doc_id, y); ``learn`` is
    the condition on doc_id of the rows to learn from."""
    n = len(STATISTICS)
    moments = stats.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    rng = np.random.default_rng(SEED)
    model = QualityModel(
        mean=np.array([m or 0.0 for m in moments[:n]]), scale=np.array([max(s or 0.0, 1e-6) for s in moments[n:]]),
        frequencies=rng.normal(size=(n, FOURIER)) / KERNEL_WIDTH, phases=rng.uniform(0, 2 * np.pi, FOURIER))
    marks = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = written(stats.where(learn).join(marks, "doc_id").select("x", "y"), "training")
    parts = rows.mapInPandas(_normal_equations(model), SUMS_SCHEMA)
    # added in two levels, so a group holds BRANCH partitions' rows, then one of BRANCH partitions each
    system = (parts.groupBy("row", "branch").applyInPandas(_add_rows, SUMS_SCHEMA)
              .groupBy("row").applyInPandas(_add_rows, SUMS_SCHEMA).orderBy("row").collect())
    if not system:
        return model
    sums = np.array([r["sums"] for r in system])
    penalty = RIDGE * np.eye(len(sums))
    penalty[-1, -1] = 1e-6  # the intercept is free
    model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.clip(model.raw(_matrix(pdf["x"])), -1, 2) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"cell": np.floor(raw * GRID).astype(np.int64), "y": pdf["y"].to_numpy(float)})

    seen = (rows.mapInPandas(cells, "cell long, y double").groupBy("cell")
            .agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").collect())  # 3 * GRID rows at most
    model.grid = np.array([(r["cell"] + 0.5) / GRID for r in seen])
    model.chance = np.clip(isotonic(np.array([r["y"] for r in seen]), np.array([r["n"] for r in seen], float)), 0, 1)
    return model


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))


def _learned() -> Column:
    return F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), HELD_OUT) != 0)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    stats = written(document_statistics(docs), "statistics")
    model = train(stats, quality_labels(labels), _learned())

    def scored(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(_matrix(pdf["x"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score,
                                "predicted": (score >= THRESHOLD).astype(np.int32)})

    return (stats.mapInPandas(scored, "doc_id long, score double, predicted int")
            .select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", "predicted"))


def stay(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier does not reject, with all their columns."""
    stats = written(document_statistics(docs), "statistics")
    model = train(stats, quality_labels(labels), _learned())

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(pd.Series([statistics(t or b"") for t in text]))))

    return docs.where(score(F.col("text").cast("binary")) >= THRESHOLD)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
