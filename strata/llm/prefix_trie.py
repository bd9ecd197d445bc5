"""Prefix trie of conversations in balanced parentheses, shard by shard.

A conversation is a path of turns (digests of role and text).  Equal paths are
one item with a weight; items are range-sorted by path, so a shard, a run of
neighbours, is a piece of the trie in depth-first order.  Its parentheses open
at a node and close after its subtree; a tree of minima over blocks of their
excess finds each node's close (findclose), and with it the subtree, whose
members, bytes and leaves (pairs "()", by rank) are differences of cumulative
arrays.

Nodes on the paths of a shard's first and last item, its spines, may go on in
other shards.  They leave the shard as items again, with what hangs off them
(members, savings, leaves, children of the subtrees that are whole), and are
merged by the same encoding over all shards' spines, in as many rounds as their
number asks for.

A null conv_id names no conversation: its rows are left out.  A null turn comes
first; rows of one turn go by role, then by the text's SHA-256; null role or
text is empty.  Repeated rows are turns each.  A path is held in one row, 24
bytes a turn, so a conversation must fit one; copies, common beginnings and
long texts may be of any size.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import crc32_sql, for_workers, table, written

GROUP, MOST_KEPT = 5, 9  # op13: the first h < 9 turns come from conversation c - c % 5
SHARD_NODES = 50_000  # nodes of a shard, and at least ...
SHARD_ITEMS = 64  # ... so many items
LAST_ITEMS = 20_000  # spines that the last round takes at once
IDS = 4096  # conv_ids put together before they are hashed in order
BLOCK = 64  # parentheses of a block of the minima
DIGEST = 16  # bytes of a turn's digest
NONE = np.iinfo(np.int64).max
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- balanced parentheses ------------------------------------------------------------------

class Parentheses:
    """A trie in depth-first order, from its nodes' depths (root first)."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        closes = np.append(depth[:-1] - depth[1:] + 1, depth[-1] - depth[0] + 1) if n else np.zeros(0, np.int64)
        self.open = np.arange(n) + np.cumsum(closes) - closes  # where each node opens
        bits = np.full(2 * n, -1, np.int64)
        bits[self.open] = 1
        self.excess = np.cumsum(bits)
        self.is_open = bits > 0
        leaf = self.is_open & np.append(~self.is_open[1:], False)
        self.leaf_rank = np.concatenate([[0], np.cumsum(leaf)])  # pairs "()" before a position
        self.open_rank = np.concatenate([[0], np.cumsum(self.is_open)])
        blocks = max(1, -(-2 * n // BLOCK))
        self.padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.padded[:2 * n] = self.excess
        levels = [self.padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(levels[-1]) > 1:  # range min tree, leaves first
            level = levels[-1]
            if len(level) % 2:
                level = levels[-1] = np.append(level, np.iinfo(np.int64).max)
            levels.append(np.minimum(level[::2], level[1::2]))
        self.minima = levels

    def findclose(self) -> np.ndarray:
        """For each node the position of its closing parenthesis: the first one
        after its opening where the excess falls below the opening's."""
        if not len(self.open):
            return self.open
        target = self.excess[self.open] - 1
        found = np.full(len(target), -1)
        at, left = self.open + 1, np.arange(len(target))

        def scan(left: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Looks through the rest of each position's block; what is not found."""
            lanes = np.arange(BLOCK)
            for part in np.array_split(np.arange(len(left)), max(1, len(left) // 4096)):
                block = self.padded.reshape(-1, BLOCK)[at[part] // BLOCK]
                hit = (block <= target[left[part], None]) & (lanes >= (at[part] % BLOCK)[:, None])
                any_, first = hit.any(axis=1), hit.argmax(axis=1)
                found[left[part][any_]] = (at[part] // BLOCK * BLOCK + first)[any_]
            return left[found[left] < 0]

        left = scan(left, at)
        # up while no right neighbour falls low enough, then down to the first block that does
        node, level = (self.open[left] + 1) // BLOCK, np.zeros(len(left), np.int64)
        climbing = np.ones(len(left), bool)
        for height, minima in enumerate(self.minima[:-1]):
            here = np.flatnonzero(climbing)
            if not len(here):
                break
            right = node[here] + 1
            hit = (node[here] % 2 == 0) & (minima[np.minimum(right, len(minima) - 1)] <= target[left[here]])
            node[here[hit]] += 1
            level[here[hit]] = height
            climbing[here[hit]] = False
            node[here[~hit]] //= 2
        for height in range(len(self.minima) - 1, 0, -1):
            here = np.flatnonzero((level >= height) & ~climbing)
            child = 2 * node[here]
            node[here] = np.where(self.minima[height - 1][child] <= target[left[here]], child, child + 1)
        scan(left, node * BLOCK)
        return found


@dataclass
class Subtrees:
    """Sums over subtrees as differences of cumulative arrays."""

    first: np.ndarray
    last: np.ndarray  # a node's subtree are the nodes first .. last - 1 in depth-first order
    leaves: np.ndarray

    @classmethod
    def of(cls, depth: np.ndarray) -> Subtrees:
        bp = Parentheses(depth)
        close = bp.findclose()
        return cls(np.arange(len(depth)), bp.open_rank[close + 1], bp.leaf_rank[close] - bp.leaf_rank[bp.open])

    def total(self, values: np.ndarray) -> np.ndarray:
        cumulative = np.concatenate([[0], np.cumsum(values)])
        return cumulative[self.last] - cumulative[self.first]


# ---- a shard -------------------------------------------------------------------------------

# What an item carries for each node of its path, root included, and how it adds up.
CARRIED = {"members": int.__add__, "least": min, "saved": int.__add__, "leaves": int.__add__, "children": int.__add__}
NODE_TYPES = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "parent_key": pa.binary(), "node_key": pa.binary(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
SPINE_TYPES = {"path": pa.binary(), "bytes": pa.list_(pa.int64()), "ends": pa.list_(pa.string()),
               **{c: pa.list_(pa.int64()) for c in CARRIED}}
OUT_TYPES = NODE_TYPES | SPINE_TYPES
OUT_SCHEMA = ", ".join(f"{c} " + {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>",
                                  pa.list_(pa.string()): "array<string>"}[t] for c, t in OUT_TYPES.items())


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in OUT_TYPES.items()],
                                      list(OUT_TYPES))


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def path_keys(path: bytes) -> list[bytes]:
    """Digests of all beginnings of a path, the empty one first."""
    digest, keys = hashlib.sha256(), [hashlib.sha256().digest()]
    for i in range(0, len(path), DIGEST):
        digest.update(path[i:i + DIGEST])
        keys.append(digest.digest())
    return keys


class Shard:
    """The trie of a run of sorted items (path, bytes, ends, and what is CARRIED)."""

    def __init__(self, items: list[tuple], keyed: bool):
        self.items, self.depth, self.parent, self.size, self.ends, self.keys = items, [], [], [], [], []
        carried: list[list[int]] = [[] for _ in CARRIED]
        previous, stack = None, []
        for path, nbytes, ends, *values in items:
            shared = -1 if previous is None else common_prefix(previous, path)
            for d in range(shared + 1) if keyed else ():  # an item of the corpus has nothing to add there
                at = stack[d]
                self.ends[at] = ends[d] or self.ends[at]
                for column, value, add in zip(carried, values, CARRIED.values()):
                    column[at] = add(column[at], value[d])
            fresh = range(shared + 1, len(nbytes))
            stack = stack[:shared + 1] + list(range(len(self.depth), len(self.depth) + len(fresh)))
            self.depth += fresh
            self.parent += [stack[d - 1] if d else -1 for d in fresh]
            self.size += [nbytes[d] for d in fresh]
            self.ends += [ends[d] for d in fresh]
            for column, value in zip(carried, values):
                column += [value[d] for d in fresh]
            if keyed:
                self.keys += path_keys(path)[shared + 1:]
            if previous is None:
                self.first = list(stack)
            previous = path
        self.last = stack
        n = len(self.depth)
        self.weight, least, self.saved, self.leaves, self.children = (np.array(c, np.int64) for c in carried)
        depth, size, up = np.array(self.depth), np.array(self.size, np.int64), np.array(self.parent)
        tree = Subtrees.of(depth)
        own_children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
        self.n_convs = tree.total(self.weight)
        self.n_children = own_children + self.children
        # a node without children here is no leaf if some hang off it
        self.n_leaves = tree.leaves + tree.total(self.leaves - ((own_children == 0) & (self.children > 0)))
        self.n_saved = tree.total(self.saved + (self.n_convs - 1) * size)
        self.least = least.tolist()
        for i in range(n - 1, 0, -1):  # children come after their parents
            self.least[self.parent[i]] = min(self.least[self.parent[i]], self.least[i])

    def finished(self, spine: set[int]) -> pa.RecordBatch:
        """All nodes but the spines'.  A spine's child names its parent by key."""
        done = [i for i in range(len(self.depth)) if i not in spine]
        keys = {i: k for nodes, item in ((self.first, self.items[0]), (self.last, self.items[-1])) for i, k in zip(nodes, path_keys(item[0]))}
        above = [self.parent[i] for i in done]
        at = np.array(done, int)
        return _batch({
            "conv_id": [self.least[i] for i in done], "depth": [self.depth[i] for i in done],
            "parent_conv_id": [None if p < 0 or p in spine else self.least[p] for p in above],
            "parent_key": [keys[p] if p in spine else None for p in above],
            "node_key": [self.keys[i] for i in done] if self.keys else [None] * len(done),
            "n_convs": self.n_convs[at], "n_children": self.n_children[at], "n_leaves": self.n_leaves[at], "saved_tokens": self.n_saved[at],
            "ends_sha256": [self.ends[i] or EMPTY_SHA for i in done]})

    def spines(self, spine: set[int]) -> pa.RecordBatch:
        """The first and the last path as items, with what hangs off their nodes."""
        for i, p in enumerate(self.parent):
            if p in spine and i not in spine:
                self.weight[p] += self.n_convs[i]
                self.saved[p] += self.n_saved[i]
                self.leaves[p] += self.n_leaves[i]
                self.children[p] += 1
        out: dict[str, list] = {c: [] for c in SPINE_TYPES}
        told: set[int] = set()
        for nodes, item in [(self.first, self.items[0]), (self.last, self.items[-1])][:2 if len(self.items) > 1 else 1]:
            new = [i not in told for i in nodes]  # shared nodes tell only once
            told.update(nodes)
            out["path"].append(item[0])
            out["bytes"].append([self.size[i] for i in nodes])
            out["ends"].append([self.ends[i] if x else None for i, x in zip(nodes, new)])
            out["least"].append([self.least[i] for i in nodes])
            for name, column in (("members", self.weight), ("saved", self.saved), ("leaves", self.leaves), ("children", self.children)):
                out[name].append([int(column[i]) if x else 0 for i, x in zip(nodes, new)])
        return _batch(out)


def _corpus_item(path: bytes, nbytes: list[int], n: int, least: int, ends: str) -> tuple:
    rest, none = [0] * (len(nbytes) - 1), [0] * len(nbytes)
    return path, nbytes, [None] * len(rest) + [ends], rest + [n], [NONE] * len(rest) + [least], none, none, none


def _shards(corpus: bool, last_round: bool):
    def out(items: list[tuple]) -> Iterator[pa.RecordBatch]:
        shard = Shard(items, not corpus)
        spine = set() if last_round else {*shard.first, *shard.last}
        yield shard.finished(spine)
        if spine:
            yield shard.spines(spine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, nodes = [], 0
        for batch in batches:
            for item in zip(*(column.to_pylist() for column in batch.columns)):
                items.append(_corpus_item(*item) if corpus else item)
                nodes += len(item[1])
                if not last_round and nodes >= SHARD_NODES and len(items) >= SHARD_ITEMS:
                    yield from out(items)
                    items, nodes = [], 0
        if items:
            yield from out(items)

    return run


# ---- the job -------------------------------------------------------------------------------

def paths(conversations: DataFrame) -> DataFrame:
    """Each conversation's own turns in order: conv_id, turns (array of struct
    with digest, 32 hexadecimal digits, and bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(F.sha2(content, 256), 1, 2 * DIGEST).alias("digest"),
                    F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def shared_heads(own: DataFrame) -> DataFrame:
    """``own`` paths with their first h = crc32(conv_id) mod 9 turns taken from
    conversation c - c mod 5: all it has if fewer, none if it isn't there."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_KEPT).cast("int")
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_KEPT - 1).alias("head"))
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


def _hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members, least conv_id and SHA-256 of the ids of each path, from sorted chunks."""
    now, digest, n, least = None, None, 0, 0
    for pdf in batches:
        done = []
        for key, count, first, ids in zip(pdf["key"], pdf["n"], pdf["least"], pdf["ids"]):
            if key != now:
                if now is not None:
                    done.append((now, n, least, digest.hexdigest()))
                now, digest, n, least = key, hashlib.sha256(), 0, first
            digest.update(("," if n else "").encode() + ids.encode())
            n += count
        if done:
            yield pd.DataFrame(done, columns=["key", "n", "least", "sha"])
    if now is not None:
        yield pd.DataFrame([(now, n, least, digest.hexdigest())], columns=["key", "n", "least", "sha"])


def _items(rebuilt: DataFrame) -> DataFrame:
    """Distinct paths in their order's partitions: path, bytes, members, least, ends."""
    path = F.unhex(F.array_join("turns.digest", ""))
    nbytes = F.concat(F.array(F.lit(0).cast("long")), F.col("turns.bytes"))
    rows = written(rebuilt.select("conv_id", path.alias("path"), nbytes.alias("bytes")).withColumn("key", F.sha2("path", 256)), "trie-paths")
    chunks = rows.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(  # IDS ids at most
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    ended = (chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "n", "least", "ids")
             .mapInPandas(_hashed, "key string, n long, least long, sha string"))
    # the path of its least member, so that copies' paths needn't be grouped
    same = (F.col("k") == F.col("key")) & (F.col("least") == F.col("conv_id"))
    return rows.join(ended.withColumnRenamed("key", "k"), same).select("path", "bytes", "n", "least", "sha")


def trie_nodes(paths_: DataFrame) -> DataFrame:
    """One row a node of the trie of ``paths_`` (conv_id, turns): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    def shards(items: DataFrame, corpus: bool, last_round: bool) -> DataFrame:
        return written(items.mapInArrow(_shards(corpus, last_round), OUT_SCHEMA), "trie-nodes")

    def ranges(items: DataFrame) -> DataFrame:
        return items.repartitionByRange("path").sortWithinPartitions("path")

    out = shards(ranges(_items(paths_)), True, False)
    nodes = [out.where("path IS NULL")]
    while True:
        spines = out.where("path IS NOT NULL").select(*SPINE_TYPES)
        last_round = spines.count() <= LAST_ITEMS
        out = shards(spines.repartition(1).sortWithinPartitions("path") if last_round else ranges(spines), False, last_round)
        nodes.append(out.where("path IS NULL"))
        if last_round:
            break
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    every = every.select(*NODE_TYPES)
    parents = every.where("node_key IS NOT NULL").select(F.col("node_key").alias("k"), F.col("conv_id").alias("above"))
    return every.join(parents, F.col("parent_key") == F.col("k"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(shared_heads(paths(for_workers(table(spark, sf_dir, "conversations")))))


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM turns GROUP BY conv_id),
headed AS (
  SELECT o.conv_id, o.turns, coalesce(b.turns, []) AS base, {crc32_sql("o.conv_id::VARCHAR")} % 9 AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
rebuilt AS (SELECT conv_id, list_concat(base[1:h], turns[h + 1:]) AS path FROM headed),
members AS (SELECT conv_id, path, d, path[1:d] AS prefix FROM rebuilt, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY prefix, d),
own_part AS (
  SELECT n.*, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(prefix[depth].text)) ELSE 0 END AS saved,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n),
above AS (  -- each node with each node on its path
  SELECT prefix[1:up] AS top, up, saved, n_children FROM own_part, LATERAL (SELECT unnest(range(depth + 1)) AS up)),
below AS (SELECT top, up, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY top, up)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own_part n JOIN below b ON b.top = n.prefix AND b.up = n.depth
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
