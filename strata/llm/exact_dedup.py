"""Exact deduplication against a history held in a minimal perfect hash.

The distinct digests of the history are dealt over shards.  Each shard is one
row of an index table: a minimal perfect hash (levels of bit arrays; a key sits
in the first level where no other key of the shard shares its bit, and its slot
is the rank of that bit) and one slot a digest with the full SHA-256, the
locator of the winner and the number of copies.  A lookup compares all 32 bytes
of the slot, so a digest that is not in the history can't pass for one.
Members are repeats of the winner; nonmembers form groups of their own.

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty.  Of equal texts the row with the largest doc_id stays (a null id only
where there is no other); of rows that share that id too, one stays.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, keep_rows, lower_az, row_key, table, written

KEYS_PER_SHARD = 4096  # bounds an index row: about 200 KB
ROWS_PER_LOOKUP = 4 * KEYS_PER_SHARD  # a shard with more different rows is looked up in several tasks
ROOM = 1.5  # bits of a level for each key that is still without a place

INDEX_SCHEMA = ("shard long, level_bits array<int>, bits binary, slots binary, "
                "winners array<long>, copies array<long>")
FOUND_SCHEMA = "doc_id long, text_sha256 string, same long, keep_id long, group_size long, winner boolean, member boolean"


def digest(text: Column) -> Column:
    return F.sha2(lower_az(F.coalesce(text, F.lit(""))), 256)


def _digest_words(hexes: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), dtype="<u8").reshape(-1, 4)


def _level_places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = words[:, level % 4] ^ (words[:, (level + 1) % 4] >> np.uint64(9)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(27))) % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits, for distinct 32-byte keys."""
    sizes, bits = [], []
    while len(words):
        size = 64 * math.ceil(max(1, ROOM * len(words)) / 64)
        place = _level_places(words, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words = words[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key (0 to n-1 for the built keys; -1 or any slot for others)."""
    rank = np.cumsum(bits) - 1
    out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = start + _level_places(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return out


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    words = _digest_words(pdf["text_sha256"])
    sizes, bits = build_hash(words)
    order = np.argsort(slots_of(words, sizes, bits))
    winners = [None if pd.isna(x) else int(x) for x in pdf["winner"].iloc[order]]
    return pd.DataFrame({"shard": [key[0]], "level_bits": [sizes], "bits": [np.packbits(bits).tobytes()],
                         "slots": [words[order].tobytes()], "winners": [winners],
                         "copies": [pdf["copies"].to_numpy()[order].tolist()]})


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(n_shards))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard from ``history`` (doc_id, text_sha256, same); a hot digest is
    counted before the shuffle, so no shard holds more than its distinct keys."""
    distinct = history.groupBy("text_sha256").agg(F.max("doc_id").alias("winner"), F.sum("same").alias("copies"))
    return distinct.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def _finder(own_history: bool):
    def find(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = rows[["doc_id", "text_sha256", "same"]].reset_index(drop=True)
        n = len(out)
        keep, size, member = np.full(n, None, object), np.ones(n, np.int64), np.zeros(n, bool)
        if n and len(index):
            entry = index.iloc[0]
            sizes = list(entry["level_bits"])
            bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
            slots = np.frombuffer(entry["slots"], "<u8").reshape(-1, 4)
            words = _digest_words(out["text_sha256"])
            slot = slots_of(words, sizes, bits)
            member = (slot >= 0) & (slots[slot] == words).all(axis=1)
            keep[member] = np.array([None if pd.isna(x) else int(x) for x in entry["winners"]], object)[slot[member]]
            size[member] = np.asarray(entry["copies"])[slot[member]]
        out["keep_id"] = pd.array(list(keep), dtype="Int64")
        out["group_size"] = size
        largest = out["doc_id"].isna() & out["keep_id"].isna() | (out["doc_id"].astype("Int64") == out["keep_id"]).fillna(False)
        out["winner"] = largest.to_numpy(bool) & member & own_history
        out["member"] = member
        return out

    return find


def look_up(rows: DataFrame, index: DataFrame, n_shards: int, own_history: bool) -> DataFrame:
    """Every row of ``rows`` (doc_id, text_sha256, same; distinct) against its
    shard's slots.  Shards with many rows (a hot digest) are dealt over several
    tasks, each with a copy of that shard's bounded index row; rows of one id
    are no more than the shard's digests."""
    rows = rows.withColumn("shard", _shard(n_shards))
    hot = (rows.groupBy("shard").agg(F.ceil(F.count("*") / ROWS_PER_LOOKUP).cast("long").alias("parts"))
           .where("parts > 1"))
    dealt = rows.join(hot, "shard", "left").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "shard"), F.coalesce("parts", F.lit(1))))
    copies = index.join(hot, "shard", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    return (dealt.select("doc_id", "text_sha256", "same", "shard", "part").groupBy("shard", "part")
            .cogroup(copies.drop("parts").groupBy("shard", "part"))
            .applyInPandas(_finder(own_history), FOUND_SCHEMA))


def _digests(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_sha256) with how many rows are the ``same``: repeats
    are counted before they are shuffled, however many there are."""
    rows = for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))
    return written(rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("same")), "digests")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, member.

    ``history`` has columns doc_id and text; without one, the documents are
    their own history and the winner of each group stays.  With one, a document
    whose text is in the history goes (keep_id and group_size are the
    history's), and the others are grouped among themselves.
    """
    own = history is None
    rows = _digests(docs)
    known = rows if own else _digests(history)
    n_shards = max(1, math.ceil(known.count() / KEYS_PER_SHARD))
    index = written(build_index(known, n_shards), "digest-index")
    found = written(look_up(rows, index, n_shards, own), "found")
    others = found.where("not member").select("doc_id", "text_sha256", "same")
    groups = others.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("same").alias("group_size"))
    apart = (others.join(groups, "text_sha256")
             .withColumn("winner", F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .withColumn("member", F.lit(False)))
    # the winner: one of the rows with the largest id
    return (found.where("member").unionByName(apart)
            .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "same")))
            .select("doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("nth") == 1)).alias("kept"),
                    "text_sha256", "member"))


def stay(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    return keep_rows(docs, row_key(F.col("doc_id").cast("long"), digest(F.col("text"))), kept)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("member")


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER (PARTITION BY k ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(k) AS text_sha256
FROM t
"""
