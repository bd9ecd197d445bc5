"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are the words of the whole text, hashed to ``DIMENSIONS`` places; document
frequencies are counted over all documents, and every term of a text counts in
its norm, whether an example has it or not, so a cosine is that of the whole
texts.  The examples, a bounded sample of each class drawn evenly over the
languages, form a block-max inverted index: a term's postings are cut by blocks
of similar examples, and each piece knows its largest weight.  A search sums
these into an upper bound of each block, looks into the most promising blocks,
and then only into those whose bound reaches the k-th best cosine found, so its
result is exact.

The neighbours vote with their cosine, in which each shared term counts by how
much its presence among the examples says about the label (the root of 1 + chi-
square): labels weigh in the vote, never in the distance.  Votes become
probabilities by isotonic regression over the examples' own votes, each example
left out of its own search, weighted to the shares of its class and language
among all labelled rows.

An example has ``EXAMPLE_BYTES`` at most; longer labelled texts teach nothing,
but are scored whole.  A null text is empty.  A text without terms of any
example has no neighbours and gets the share of toxic examples among those
without any.  A document with several labels counts with the larger one, one
id with several texts with that of the smallest hash; rows with a null doc_id
are scored, but never learned from.  Without examples of both classes the
score is the share of toxic rows (0 without labels).  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import crc_mod, for_workers, table, written
from strata.llm.quality import isotonic

THRESHOLD = 0.7
EXAMPLES = 1000  # labelled documents of each class in the index
EXAMPLE_BYTES = 1 << 16
STRATA = 64  # languages are hashed to so many, so that quotas are a table of fixed size
DIMENSIONS = 1 << 20  # places terms are hashed to
NEIGHBOURS = 50
BLOCK = 64  # examples of a block
COMMON = 8  # a term that more than one of so many examples has is kept as a row of a matrix
FIRST_BLOCKS = 2  # blocks that a search looks into before it prunes
HELD_OUT = 3  # op4: rows with crc32(doc_id) mod 3 = 1

# Word bytes are 0-9, a-z and all beyond ASCII; A-Z are lower-cased, the rest are blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's words, ascending, and how often each occurs."""
    words = Counter(text.translate(_WORDS).split())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    places = np.fromiter(map(crc32, words), np.int64, len(words)) & (DIMENSIONS - 1)
    counts = np.fromiter(words.values(), float, len(words))
    order = np.argsort(places, kind="stable")
    places, counts = places[order], counts[order]
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return places[first], np.add.reduceat(counts, first)


# ---- the index ---------------------------------------------------------------------------

def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples, by term and block.  The lists of terms that many
    examples have are kept as rows of a matrix, those of others as postings."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    telling: np.ndarray  # of the index's terms, ascending by place

    def __post_init__(self):
        self.size = len(self.vectors)
        sizes = [len(t) for t, _ in self.vectors]
        terms = np.concatenate([t for t, _ in self.vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        owner = np.repeat(np.arange(self.size), sizes)
        order = np.lexsort((owner, terms))
        self.terms, row = np.unique(terms[order], return_inverse=True)
        owner, weight = owner[order], weight[order]
        self.blocks = -(-self.size // BLOCK)
        self.block_of = np.arange(self.size) // BLOCK
        common = np.bincount(row, minlength=len(self.terms)) * COMMON > self.size
        self.dense_row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.size))
        often = common[row]
        self.dense[self.dense_row[row[often]], owner[often]] = weight[often]
        padded = np.zeros((len(self.dense), self.blocks * BLOCK))
        padded[:, :self.size] = self.dense
        self.dense_best = padded.reshape(len(padded), self.blocks, BLOCK).max(axis=2, initial=0)
        self.dense_telling = self.telling[common]
        row, self.owner, self.weight = row[~often], owner[~often], weight[~often]
        self.vote_weight = self.weight * self.telling[row]
        pair = row * (self.size // BLOCK + 1) + self.owner // BLOCK  # a term's postings in one block lie together
        self.piece = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        self.piece_size = np.diff(np.append(self.piece, len(pair)))
        self.piece_block = self.owner[self.piece] // BLOCK
        self.piece_best = np.maximum.reduceat(self.weight, self.piece) if len(self.piece) else np.zeros(0)
        self.start = np.searchsorted(row[self.piece], np.arange(len(self.terms) + 1))  # pieces of each term

    def __getstate__(self):
        return self.vectors, self.telling  # the lists are built where they are used

    def __setstate__(self, state):
        self.__init__(*state)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, but: int = -1):
        """(examples, cosines, vote weights) of the k nearest with a cosine above 0,
        best first, ties by number; example ``but`` is left out."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        row, weight = at[known], weight[known]
        often = self.dense_row[row] >= 0
        lists, heavy = self.dense_row[row[often]], weight[often]
        row, weight = row[~often], weight[~often]
        many = self.start[row + 1] - self.start[row]
        pieces, factor = _ranges(self.start[row], many), np.repeat(weight, many)
        block = self.piece_block[pieces]
        bound = np.bincount(block, self.piece_best[pieces] * factor, self.blocks) + heavy @ self.dense_best[lists]
        cosine, votes = np.zeros(self.size), np.zeros(self.size)

        def look_into(chosen: np.ndarray) -> None:
            wanted = chosen[block]
            sizes = self.piece_size[pieces[wanted]]
            at = _ranges(self.piece[pieces[wanted]], sizes)
            by = np.repeat(factor[wanted], sizes)
            nonlocal cosine, votes
            cosine = cosine + np.bincount(self.owner[at], self.weight[at] * by, self.size)
            votes = votes + np.bincount(self.owner[at], self.vote_weight[at] * by, self.size)
            members = chosen[self.block_of]
            if 4 * np.count_nonzero(chosen) > self.blocks:  # whole rows are quicker than many of their places
                cosine += np.where(members, heavy @ self.dense[lists], 0.0)
            else:
                cosine[members] += heavy @ self.dense[np.ix_(lists, np.flatnonzero(members))]
            if but >= 0:
                cosine[but] = 0.0

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:max(FIRST_BLOCKS, -(-k // BLOCK))]] = True
        look_into(first)
        least = np.partition(cosine, -k)[-k] if self.size > k else 0.0
        rest = ~first & (bound > 0) & (bound >= least - 1e-9)  # a hair below, for rounding
        if rest.any():
            look_into(rest)
        found = np.flatnonzero(cosine > 0)
        if len(found) > k:
            found = found[cosine[found] >= np.partition(cosine[found], -k)[-k]]
        found = found[np.lexsort((found, -cosine[found]))[:k]]
        return found, cosine[found], votes[found] + (heavy * self.dense_telling[lists]) @ self.dense[np.ix_(lists, found)]


@dataclass
class ToxicityModel:
    share: float  # of toxic rows among the labelled
    idf: np.ndarray | None = None  # of all places
    index: BlockMaxIndex | None = None
    doc_ids: np.ndarray | None = None
    labels: np.ndarray | None = None
    grid: np.ndarray | None = None
    chance: np.ndarray | None = None
    without: float = 0.0  # score where there are no neighbours

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(weight @ weight)  # of all terms of the text
        return terms, weight / norm if norm > 0 else weight

    def vote(self, found: np.ndarray, weight: np.ndarray) -> float:
        return float(weight @ self.labels[found] / weight.sum())

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
        """Probability and evidence: doc_id, label and cosine of the three nearest."""
        if self.index is None:
            return self.share, []
        found, cosine, weight = self.index.search(*self.vector(terms, counts))
        if not len(found):
            return self.without, []
        near = [{"doc_id": int(self.doc_ids[i]), "label": int(self.labels[i]), "cosine": float(c)} for i, c in zip(found[:3], cosine[:3])]
        return float(np.interp(self.vote(found, weight), self.grid, self.chance)), near


def tells(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """How much each term's presence says about the label: the root of 1 + chi-
    square, for all the vectors' terms in ascending order."""
    n, positive = len(labels), labels.sum()
    terms, row = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
    label = np.repeat(labels, [len(t) for t, _ in vectors])
    d = np.bincount(row, minlength=len(terms)).astype(float)
    a = np.bincount(row, label, len(terms))  # examples of each label with and without the term
    b, c = d - a, positive - a
    chi2 = n * (a * (n - d - c) - b * c) ** 2 / np.maximum(d * (n - d) * positive * (n - positive), 1)
    return np.sqrt(1 + chi2)


def _fit(examples: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray, share: float, stands_for: np.ndarray) -> ToxicityModel:
    """From (doc_id, label, terms, counts) of both classes; each stands for so
    many labelled rows."""
    model = ToxicityModel(share, idf)
    vectors = [model.vector(terms, counts) for _, _, terms, counts in examples]
    # similar examples share a block, so the blocks' bounds are tight: by label, then heaviest term
    heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(len(examples)), key=lambda i: (examples[i][1], heaviest[i], examples[i][0]))
    vectors = [vectors[i] for i in order]
    model.doc_ids = np.array([examples[i][0] for i in order])
    model.labels = np.array([examples[i][1] for i in order], float)
    index = model.index = BlockMaxIndex(vectors, tells(vectors, model.labels))
    weight = stands_for[order]
    toxic = weight[model.labels == 1].sum()
    weight = np.where(model.labels == 1, weight * share / toxic, weight * (1 - share) / (weight.sum() - toxic)) * len(order)
    votes = np.full(len(order), np.nan)
    for i, (terms, w) in enumerate(vectors):
        found, _, by = index.search(terms, w, but=i)
        if len(found):
            votes[i] = model.vote(found, by)
    none = np.isnan(votes)
    # with the weight of one row of the average share, so that few examples aren't certain
    model.without = float((weight[none] @ model.labels[none] + share) / (weight[none].sum() + 1))
    if none.all():
        model.grid, model.chance = np.zeros(1), np.array([model.without])
        return model
    value = np.unique(votes[~none])
    at = np.searchsorted(value, votes[~none])
    total = np.bincount(at, weight[~none])
    mean = np.bincount(at, weight[~none] * model.labels[~none]) / total
    model.grid, model.chance = value, isotonic(mean, total)
    return model


# ---- the operator ------------------------------------------------------------------------

def _quotas(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """How many examples to draw of each (label, stratum): ``EXAMPLES`` of a label,
    shared evenly; what a small stratum leaves goes to the larger."""
    quotas = {}
    for label in {y for y, _ in counts}:
        left, open_ = EXAMPLES, sorted((n, stratum) for (y, stratum), n in counts.items() if y == label)
        for i, (n, stratum) in enumerate(open_):
            quotas[label, stratum] = min(n, left // (len(open_) - i))
            left -= quotas[label, stratum]
    return quotas


_HASHES = 1 << 31


def _draw(marks: DataFrame) -> dict[int, tuple[int, float]]:
    """doc_id -> (label, how many labelled rows it stands for) of the examples, from
    one row a document (doc_id, y, stratum): in each class and stratum those whose
    ids hash lowest, all strata in one pass, and only those that may be among
    them are collected."""
    marks = marks.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)))
    counts = {(r["y"], r["stratum"]): r["n"] for r in marks.groupBy("y", "stratum").agg(F.count("*").alias("n")).collect()}
    quotas = {key: size for key, size in _quotas(counts).items() if size}
    if not quotas:
        return {}
    # a fifth more than wanted and some: fewer than wanted would pass only rarely, and that is no harm
    limit = F.create_map(*[x for (y, stratum), size in quotas.items() for x in (
        F.lit(f"{y}:{stratum}"), F.lit(min(_HASHES, int(_HASHES * (1.2 * size + 50) / counts[y, stratum]))))])
    low = marks.where(F.col("h") < limit[F.concat_ws(":", "y", "stratum")]).collect()
    by: dict[tuple[int, int], list] = {}
    for r in sorted(low, key=lambda r: (r["h"], r["doc_id"])):
        by.setdefault((r["y"], r["stratum"]), []).append(r["doc_id"])
    drawn = {key: ids[:quotas[key]] for key, ids in by.items()}
    return {i: (key[0], counts[key] / len(ids)) for key, ids in drawn.items() for i in ids}


def train(docs: DataFrame, labels: DataFrame, usable: Column):
    """Examples (doc_id, label, terms, counts), how many labelled rows each stands for
    and the share of toxic rows, of the rows of ``labels`` (doc_id, y) that meet ``usable``."""
    marks = labels.where(usable & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(lang), F.lit(STRATA)).cast("int").alias("stratum"),
                        F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"))
    each = whole.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.max("size").alias("size"))
    marks = written(marks.join(each, "doc_id", "left"), "toxic-labels")
    share = marks.agg(F.avg("y")).first()[0] or 0.0
    chosen = _draw(marks.where(F.col("size") <= EXAMPLE_BYTES).select("doc_id", "y", "stratum"))
    if not chosen:
        return [], np.zeros(0), share
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("doc_id").isin(list(chosen)))
             .groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).collect())  # one bounded text an id
    rows = sorted((r["doc_id"], chosen[r["doc_id"]][0], *terms_of(r["text"].encode())) for r in texts)
    return rows, np.array([chosen[r[0]][1] for r in rows]), share


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of all places, and the number of documents: counted by partition first."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen[terms_of(text.as_py() or b"")[0]] += 1
                n += 1
        seen[-1] = n  # the last place counts the documents
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 1 << 16):
            some = found[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], ["place", "n"])

    counted = texts.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a place
    df = np.zeros(DIMENSIONS + 1, np.int64)
    df[counted["place"].to_numpy()] = counted["n"].to_numpy()
    return df[:-1], int(df[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """One row a document: doc_id, score, predicted, evidence."""
    examples, stands_for, share = train(docs, labels, usable)
    # read twice: all terms of all texts would be a table as large as the texts
    rows = for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    model = ToxicityModel(share)
    if len({e[1] for e in examples}) == 2 and any(len(e[2]) for e in examples):
        df, n = document_frequencies(rows.select("text"))
        model = _fit(examples, np.log((n + 1) / (df + 1)), share, stands_for)

    def scored(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.score(*terms_of(t or b"")) for t in pdf["text"]]
            score = np.array([f[0] for f in found], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score,
                                "predicted": (score >= THRESHOLD).astype(np.int32), "evidence": [f[1] for f in found]})

    return rows.mapInPandas(scored, "doc_id long, score double, predicted int, "
                                    "evidence array<struct<doc_id:long,label:int,cosine:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                   F.col("toxic").cast("int").alias("y"))
    held_out = crc_mod(F.col("doc_id"), HELD_OUT) == 1
    found = toxicity_scores(table(spark, sf_dir, "documents"), labels, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
