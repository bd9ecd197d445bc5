"""SimHash near-duplicates through pivot distance tables.

A fingerprint has bit i set when more than half of the text's shingle hashes
have it.  Fingerprints link at ``max_bits`` differing bits or fewer.  Equal
fingerprints are one node, so copies never form pairs.

Candidates meet in buckets: of 2 * max_bits blocks, linked fingerprints agree in
max_bits at least, so each fingerprint is filed under every choice of that many
blocks (20 tables of 31 to 33 bits for 3).  Inside a bucket the distances to a
table of fixed reference fingerprints (pivots) decide: by the triangle
inequality a linked pair's distances to any pivot differ by max_bits at most,
so pairs whose largest coordinate difference is higher are discarded, and the
survivors are verified bit by bit.  A bucket with more than ``BUCKET_ROWS``
fingerprints is first split by cells of pivot distances; cells overlap by
max_bits, so no pair is lost.  One that no pivot splits further (distinct
fingerprints that agree in a choice of blocks and in all their cells) is compared
in one task, in blocks of rows near in pivot distance: its memory grows with its
rows, its time with their square.  A bucket gives a spanning forest of its
links, not its pairs; components come from those.

A null or blank text has fingerprint zero, linked like any other.  Null ids
never name a component unless it has no other.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, keep_rows, row_key, table, written
from strata.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
BUCKET_ROWS = 4096  # a bucket with more is split by pivot cells
SMALL_RUN = 32  # runs up to this length are compared for a whole batch at once
N_PIVOTS = 16
CELL = 8  # width of a cell of pivot distances; at least twice max_bits
_SEED = 42

# Reference fingerprints: hashes of their own numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), _SEED) for i in range(N_PIVOTS)], np.uint64)
KEY = ["part", "bits", "cell"]


# ---- fingerprints ----------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, single spaces between; A-Z lower-cased."""
    words = text.lower().split()  # on bytes: ASCII letters and ASCII blanks only
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return [h(joined, _SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return [h(joined[a:b], _SEED) for a, b in zip((end - size)[: 1 - width or None].tolist(), end[width - 1:].tolist())]


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes, ones = bits.view(np.uint64), np.zeros(64, np.int64)
    for i in range(0, len(lanes), 255):  # eight one-byte counters in each sum of 64 bits
        ones += lanes[i:i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([0 if t is None else fingerprint(t, width) for t in pdf["text"]], np.uint64)
            yield pdf.drop(columns="text").assign(doc_id=pdf["doc_id"].astype("Int64"), fp=fps.view(np.int64))

    return run


# ---- buckets ---------------------------------------------------------------------------

def _masks(max_bits: int) -> list[int]:
    """Bit masks of every choice of max_bits out of 2 * max_bits blocks."""
    n = 2 * max_bits
    edges = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(pick) for pick in combinations(blocks, max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(fps: DataFrame, max_bits: int) -> DataFrame:
    places = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
              for i, m in enumerate(_masks(max_bits))]
    return (fps.select("fp", F.explode(F.array(*places)).alias("place"))
            .select("place.part", "place.bits", F.lit(0).cast("long").alias("cell"), "fp"))


def _cells(pivot: int, max_bits: int) -> Column:
    """The cells of a fingerprint: its own and, near the lower edge, the one below."""
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(pivot))))
    own = F.floor(distance / CELL)
    below = F.when(distance % CELL < max_bits, own - 1).otherwise(own)
    return F.explode(F.array_distinct(F.array(own, below)))


def _split_hot(filed: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """Buckets with more than ``bucket_rows`` rows dealt over pivot cells, again
    for each pivot while there are any."""
    done = None
    for i, pivot in enumerate(PIVOTS):
        hot = written(filed.groupBy(KEY).count().where(F.col("count") > bucket_rows).select(KEY), "hot-buckets")
        if hot.isEmpty():
            break
        rest = filed.join(hot, KEY, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        filed = written(
            filed.join(hot, KEY, "left_semi").withColumn("_c", _cells(int(pivot), max_bits))
            .withColumn("cell", F.xxhash64("cell", F.lit(i), "_c")).drop("_c"), "cells")
    return filed if done is None else done.unionByName(filed)


# ---- links inside buckets ----------------------------------------------------------------

def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _linked(fps: np.ndarray, distances: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (i, j) link: the largest coordinate difference first,
    then the differing bits of those it leaves."""
    ok = np.abs(distances[i] - distances[j]).max(axis=1) <= max_bits
    ok[ok] = np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= max_bits
    return ok


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of n rows by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def _long_run(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Row of the forest's root for each row of one long bucket; works row by
    row against the rows within max_bits of its first pivot distance."""
    distances = pivot_table(fps)
    order = np.argsort(distances[:, 0], kind="stable")
    fps, distances = fps[order], distances[order]
    end = np.searchsorted(distances[:, 0], distances[:, 0] + max_bits, side="right")
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.arange(i + 1, end[i])
        near = near[_linked(fps, distances, np.full(len(near), i), near, max_bits)]
        if len(near):
            merged = np.unique(label[np.append(near, i)])
            if len(merged) > 1:
                label[np.isin(label, merged[1:])] = merged[0]
    out = np.empty(len(fps), np.int64)
    out[order] = order[label]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each bucket.  ``keys`` are bucket numbers,
    equal ones adjacent; fingerprints of a bucket are distinct."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, len(keys)])
    a, b = [], []
    several = (length > 1) & (length <= SMALL_RUN)
    if several.any():
        rows = np.concatenate([np.arange(s, s + n) for s, n in zip(start[several], length[several])])
        sub, left = fps[rows], np.concatenate([np.arange(n, 0, -1) for n in length[several]])
        distances, i_all, j_all = pivot_table(sub), [], []
        for step in range(1, int(length[several].max())):
            i = np.flatnonzero(left > step)
            i = i[_linked(sub, distances, i, i + step, max_bits)]
            i_all.append(i)
            j_all.append(i + step)
        root = _lowest(len(sub), np.concatenate(i_all), np.concatenate(j_all))
        moved = root != np.arange(len(sub))
        a.append(sub[moved])
        b.append(sub[root[moved]])
    for s, n in zip(start[length > SMALL_RUN], length[length > SMALL_RUN]):
        run = fps[s:s + n]
        root = _long_run(run, max_bits)
        moved = root != np.arange(n)
        a.append(run[moved])
        b.append(run[root[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_batches(max_bits: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def found(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[KEY].to_numpy(np.int64)
        number = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
        a, b = bucket_links(number, rows["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last bucket so far; its end may be in a later batch
        for rows in batches:
            if not len(rows):
                continue
            key = rows[KEY].to_numpy(np.int64)
            cut = int(np.argmax((key == key[-1]).all(axis=1)))  # rows are sorted: the last bucket's first row
            if cut == 0 and held and (held[-1][KEY].to_numpy(np.int64)[-1] == key[0]).all():
                held.append(rows)
                continue
            yield found(pd.concat([*held, rows.iloc[:cut]], ignore_index=True)) if held or cut else rows.iloc[:0].rename(
                columns={"part": "a", "bits": "b"})[["a", "b"]].astype(np.int64)
            held = [rows.iloc[cut:]]
        if held:
            yield found(pd.concat(held, ignore_index=True))

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp): a spanning forest
    of each bucket, so all links' components."""
    if max_bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    filed = _split_hot(_filed(fps, max_bits), max_bits, bucket_rows)
    return (filed.repartition(*KEY).sortWithinPartitions(*KEY)
            .mapInPandas(_link_batches(max_bits), "a long, b long"))


# ---- the operator ------------------------------------------------------------------------

def _rooted(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` (fp, distinct) with ``root``, the smallest fingerprint of the component."""
    roots = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    return (nodes.join(roots, nodes["fp"] == roots["node"], "left")
            .select(*nodes.columns, F.coalesce("root", "fp").alias("root")))


def simhash_near_dedup(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links)."""
    rows = written(for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
                   .mapInPandas(_fingerprints(width), "doc_id long, fp long"), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    rooted = _rooted(nodes, max_bits)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = written(rooted.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stay(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest doc_id (a null id where there is no other).  Where rows of the
    component share that id, the one with the smallest digest of its text."""
    doc_id = F.col("doc_id").cast("long")
    rows = (for_workers(docs).select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"), _sha(F.col("text")).alias("sha"))
            .mapInPandas(_fingerprints(width), "doc_id long, fp long, sha string"))
    # components by their roots: null and shared ids don't tell them apart
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first), "nodes")
    kept = (_rooted(nodes, max_bits).groupBy("root").agg(F.min("first").alias("first"))
            .select(row_key(F.col("first.doc_id"), F.col("first.sha")).alias("_key")))
    return keep_rows(docs, row_key(doc_id, _sha(F.col("text"))), kept)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
