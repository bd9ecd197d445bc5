"""Document fingerprints of spot signatures.

Wherever a common word (anchor) stands in a text, the chain of the next
``CHAIN`` content words after it, common ones skipped, is a signature.  The
fingerprint is the set of the signatures' 32-bit hashes, so it follows the
running prose and ignores lists, menus and punctuation.  A text without any
signature has one of its whole word sequence, so equal texts always have equal
fingerprints and unequal short ones hardly ever.

Fingerprints are compared by Jaccard likeness.  Sets are partitioned by length
in classes such that sets more than one class apart cannot reach the least
likeness asked for; those pairs are pruned unseen, and within a class the
likeness that the lengths allow is tested before the sets are intersected.

``near_documents`` finds all documents that are alike.  Equal sets are one
node.  A set is posted under its rarest signatures, as many as any partner must
share one of; sets meet in the partition of a signature and a length class, long
posting lists in pairs of blocks; the rest of both sets bounds the likeness
before the sets themselves are joined and intersected.

A null text is empty.  Rows that share a doc_id stand in the order of their
texts' hashes; null ids come first.  The only document is its own successor.
An empty table gives an empty result.  Rows of one id are dealt over ranges by
their texts' hashes; equal rows share a range, which passes its task as a
sorted stream and is never held.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, table, written
from strata.llm.components import connected_components

CHAIN = 2  # content words of a signature
RANGES_PER_PARTITION = 4  # id ranges for each shuffle partition, or more by
RANGE_BYTES = 1 << 30  # text bytes of a range (sorted, never held); one limit a range goes to the driver and the tasks
LEAST = 0.8  # likeness of near documents
PLACES = 1 << 20  # counters of signatures, whatever the corpus: a byte each in the tasks
BLOCK_ROWS = 256  # postings of a block

# Common words of four languages, the anchors; fixed values.
ANCHORS = frozenset(w.encode() for w in """
the of and to a in is that for it was on are as with be this by at from or have an they which you were all there can
der die das und ist von zu den mit nicht ein eine im dem des auf für sich auch als an werden aus er hat dass sie nach
le la les de des et un une est en que pour dans qui sur pas au plus par ce il avec son se ne ou
el los las del y es por con para como más pero sus al lo no su una si o este
""".split())

# Word bytes are 0-9, a-z and all beyond ASCII; A-Z are lower-cased, the rest are blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COMPARED_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                   "near_edited double, near_next double, n_signatures long")


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The fingerprint: ascending distinct unsigned 32-bit hashes."""
    words = text.encode("utf-8", "replace").translate(_WORDS).split()
    content: list[bytes] = []
    spots: list[tuple[bytes, int]] = []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    h = xxhash.xxh32_intdigest
    found = {h(b" ".join((w, *content[i:i + chain]))) for w, i in spots if i + chain <= len(content)}
    if not found:
        found = {h(b"\0" + b" ".join(words))}
    return np.array(sorted(found), np.uint32)


def as_text(signature_set: np.ndarray) -> str:
    return signature_set.astype(">u4").tobytes().hex()


def length_class(n: int, least: float) -> int:
    """Class of a set's length: sets two classes apart are less alike than ``least``."""
    return int(math.log(n) / _class_width(least)) if 0 < least < 1 else 0


def _class_width(least: float) -> float:
    return -math.log(least) * (1 + 1e-9)  # so rounding never parts sets by two classes


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sets; 0 where their lengths alone keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if abs(length_class(small, least) - length_class(large, least)) > 1 or small < least * large:
        return 0.0
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    found = common / (len(a) + len(b) - common)
    return found if found >= least else 0.0


# ---- every document with its successor ----------------------------------------------------

def edited(text: str, successor: str) -> str:
    """The text with its last half replaced by as many of its successor's first characters."""
    half = len(text) // 2
    return text[:len(text) - half] + successor[:half]


def _compare_batches(least: float):
    def row(doc_id, text: str, own: np.ndarray, successor: str, following: np.ndarray) -> tuple:
        changed = edited(text, successor)
        other = signatures(changed)
        return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), as_text(own),
                as_text(other), likeness(own, other, least), likeness(own, following, least), len(own))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row, whose successor is the next row of its range
        for pdf in batches:
            out = []
            for range_, copy, doc_id, text in zip(pdf["range"], pdf["copy"], pdf["doc_id"], pdf["text"]):
                if held is not None and held[0] == range_ and not held[1]:
                    own = signatures(text)
                    out.append(row(*held[2:], text, own))
                elif not copy:
                    own = signatures(text)
                held = (range_, copy, None if pd.isna(doc_id) else int(doc_id), text, own)
            done = pd.DataFrame(out, columns=[c.split()[0] for c in COMPARED_SCHEMA.split(", ")])
            yield done.astype({"doc_id": "Int64"})

    return run


def _range_of(key: Column, limits: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``limits`` are at or below ``key``, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.get(limits, mid) <= key
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, halve)["lo"]


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (range, copy, doc_id, text) dealt by ranges of (id, text hash) and
    sorted: each row's successor is the next row of its range.  The first
    document of a range is also, as a copy, the last row of the range before."""
    spark = for_workers(docs).sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("hash"))
    places = written(docs.select(place.alias("place"), F.octet_length(text).alias("bytes")), "places")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(RANGES_PER_PARTITION * tasks, math.ceil((places.agg(F.sum("bytes")).first()[0] or 0) / RANGE_BYTES))
    firsts = sorted((r["first"]["key"], r["first"]["hash"]) for r in
                    places.repartitionByRange(ranges, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("first")).collect())
    # one literal, so the plan stays small however many ranges there are
    limits = F.from_json(F.lit(json.dumps([{"key": k, "hash": h} for k, h in firsts])), "array<struct<key:bigint,hash:bigint>>")
    rows = (docs.select(place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .withColumn("range", _range_of(F.col("place"), limits, len(firsts)) - 1))
    own = F.struct(F.col("range").cast("long").alias("range"), F.lit(0).alias("copy"))
    before = F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).cast("long")
    copy = F.struct(before.alias("range"), F.lit(1).alias("copy"))
    is_first = F.get(limits, F.col("range")) == F.col("place")
    dealt = rows.withColumn("at", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("at.range", "at.copy", "place", "doc_id", "text")
    dealt = dealt.repartition(ranges, "range") if ranges > RANGES_PER_PARTITION * tasks else dealt.repartition("range")
    return dealt.sortWithinPartitions("range", "copy", "place", "text").select("range", "copy", "doc_id", "text")


def fingerprints(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a document: the columns of COMPARED_SCHEMA."""
    return with_successors(docs).mapInPandas(_compare_batches(least), COMPARED_SCHEMA)


# ---- all documents that are alike ---------------------------------------------------------

def _print_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                            "print": [signatures(t or "").astype(">u4").tobytes() for t in pdf["text"]]})


def _place_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's counts of its sets' signatures by place."""
    for pdf in batches:
        counts = np.zeros(PLACES, np.int64)
        for p in pdf["print"]:
            np.add.at(counts, np.frombuffer(p, ">u4") % PLACES, 1)
        place = np.flatnonzero(counts)
        yield pd.DataFrame({"place": place, "n": counts[place]})


def prefix(signature_set: np.ndarray, commonness: np.ndarray, least: float) -> np.ndarray:
    """The set's rarest signatures, rarest first: a set that is ``least`` alike has one of them among its own."""
    order = np.lexsort((signature_set, commonness[signature_set % PLACES]))
    n = len(signature_set)
    return signature_set[order[:n - math.ceil(least * n - 1e-9) + 1]]


def _posting_batches(commonness: np.ndarray, least: float):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, p in zip(pdf["node"], pdf["print"]):
                found = np.frombuffer(p, ">u4").astype(np.int64)
                rare = prefix(found, commonness, least)
                yield pd.DataFrame({"signature": rare, "node": node, "n": len(found), "at": np.arange(len(rare)),
                                    "class": length_class(len(found), least)})

    return run


def _pairs(postings: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a posted signature and may be
    alike.  A set lies in the lists of its class and the next; a list of many
    blocks is compared block by block, each pair of blocks under a key of its own."""
    lists = postings.withColumn("list", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    key = ["signature", "list"]
    hot = (lists.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1"))
    lists = (lists.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    low = lists.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    high = lists.withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block"))))
    x, y = low.alias("x"), high.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    one_list = F.greatest("x.class", "y.class") == F.col("x.list")  # a pair of one class meets in two lists
    rest = F.least(nx - F.col("x.at"), ny - F.col("y.at"))  # shared signatures from here on, at most
    apart = (F.col("x.block") != F.col("x.other")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*key, "block", "other")])
    met = met.where(one_list & apart & (F.least(nx, ny) >= least * F.greatest(nx, ny) - 1e-9)
                    & (rest >= least / (1 + least) * (nx + ny) - 1e-9))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def links(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b, likeness) of different ``sets`` (node, print) at least ``least``
    alike (over 0, below 1)."""
    prints = for_workers(sets).select("node", "print")
    counts = prints.mapInPandas(_place_batches, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    commonness = np.zeros(PLACES, np.uint8)
    for place, n in counts.collect():  # PLACES rows at most
        commonness[place] = int(n).bit_length()
    postings = written(prints.mapInPandas(_posting_batches(commonness, least),
                                          "signature long, node long, n long, at long, class int"), "postings")

    def both(pairs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pairs:
            found = [likeness(np.frombuffer(p, ">u4"), np.frombuffer(q, ">u4"), least) for p, q in zip(pdf["p"], pdf["q"])]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "likeness": np.array(found, float)})

    a = prints.select(F.col("node").alias("a"), F.col("print").alias("p"))
    b = prints.select(F.col("node").alias("b"), F.col("print").alias("q"))
    return (_pairs(postings, least).join(a, "a").join(b, "b").select("a", "b", "p", "q")
            .mapInPandas(both, "a long, b long, likeness double").where("likeness > 0"))


def near_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id reachable over
    likenesses of ``least`` or more, its own included; null where all are null),
    n_links long (documents that are so alike to it, equal sets included)."""
    prints = written(for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .mapInPandas(_print_batches, "doc_id long, print binary"), "prints")
    # nodes are numbered once, in the written table
    sets = written(prints.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
                   .withColumn("node", F.monotonically_increasing_id()), "sets")
    linked = written(links(sets, least), "links")
    ends = linked.select("a", "b").union(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = (ends.join(sets.select(F.col("node").alias("b"), "copies"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("partners")))
    roots = connected_components(linked.select("a", "b"))
    rooted = (sets.join(roots, "node", "left").join(partners, "node", "left")
              .select("print", "first_id", F.coalesce("root", "node").alias("root"),
                      (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return prints.join(rooted.join(named, "root"), "print").select("doc_id", "class_id", "n_links")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
