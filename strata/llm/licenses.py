"""License scan: exact phrases, and short notices with a few wrong characters.

A text is lower-cased (A-Z), split into words and joined again with single
blanks, so punctuation and line breaks never count.  A phrase stands where its
words stand in a row.  A notice may differ from the text by up to one edit in
``EDIT_EVERY`` characters.  It is split into one piece more than it may have
edits; by the pigeonhole principle at least one piece stands in the text as it
is.  Exact occurrences of the pieces give candidate windows, and there the
regex library's bounded-error matching verifies the edits and gives the span.
Where spans of several notices overlap, those with the fewest edits count.

A null text is empty: no words, no labels, score 0.  Rows that repeat, or have
a null doc_id, are scanned like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, table

# Phrases of the contract and their labels; fixed values.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Short notices, as words, and their labels; fixed values.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("the gnu lesser general public license", "lgpl"),
    ("the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("released under the bsd license", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("released into the public domain", "public-domain"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("licensed under a creative commons attribution license", "cc-by"),
)
EDIT_EVERY = 14  # characters of a notice for each edit it may have

SCAN_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
               "labels string, score double, spans array<struct<label:string,text:string,start:long,edits:int>>")

# Word bytes are 0-9, a-z and all beyond ASCII; A-Z are lower-cased, the rest are blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_in_a_row(text: bytes) -> tuple[bytes, int]:
    """The words with single blanks between and around them, and their number."""
    words = text.translate(_WORDS).split()
    return b" %b " % b" ".join(words), len(words)


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase begins."""
    out, at, words, seen = [], line.find(b" %b " % phrase), 0, 0
    while at >= 0:
        words, seen = words + line.count(b" ", seen, at), at
        out.append(words)
        at = line.find(b" %b " % phrase, at + 1)
    return out


@lru_cache(maxsize=None)
def _notice(text: str) -> tuple[int, list[tuple[bytes, int]], "regex.Pattern"]:
    """Most edits, the pieces and their offsets, the bounded-error pattern."""
    edits = max(1, len(text) // EDIT_EVERY)
    cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
    pieces = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
    return edits, pieces, regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={edits}}}")


def _windows(line: bytes, edits: int, pieces: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """Where the notice may stand: around the exact places of its pieces, merged."""
    found = []
    for piece, offset in pieces:
        at = line.find(piece)
        while at >= 0:
            found.append((max(0, at - offset - edits), min(len(line), at - offset + length + edits)))
            at = line.find(piece, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def notice_spans(line: bytes, notices: Iterable[tuple[str, str]] = NOTICES) -> list[tuple[str, str, int, int]]:
    """(label, matched text, start in ``line``, edits) of the notices found."""
    spans = []
    for text, label in notices:
        edits, pieces, pattern = _notice(text)
        if not any(piece in line for piece, _ in pieces):
            continue
        for a, b in _windows(line, edits, pieces, len(text)):
            for m in pattern.finditer(line[a:b].decode("latin-1")):  # one character a byte: places stay places
                spans.append((sum(m.fuzzy_counts), a + m.start(), a + m.end(), label, text, m.group().encode("latin-1")))
    spans.sort()
    kept: list[tuple] = []
    for s in spans:  # fewest edits first; others that overlap one with fewer edits go
        if not any(k[0] < s[0] and k[1] < s[2] and s[1] < k[2] for k in kept):
            kept.append(s)
    return [(label, found.decode("utf-8", "replace"), start, edits) for edits, start, _, label, _, found in kept]


def scan(text: bytes) -> tuple:
    """One text's result, in the order of SCAN_SCHEMA after doc_id."""
    line, n = words_in_a_row(text)
    places, base = [], set()
    for phrase, label in PHRASES:
        at = phrase_places(line, phrase.encode())
        places += at
        if at:
            base.add(label)
    spans = notice_spans(line)
    score = 1.0 if places else max((1 - edits / len(found) for _, found, _, edits in spans), default=0.0)
    return (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {s[0] for s in spans})), score, [tuple(s) for s in spans])


def _scan_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for pdf in batches:
        out = pd.DataFrame([scan(t or b"") for t in pdf["text"]], columns=names)
        out["spans"] = [[dict(zip(("label", "text", "start", "edits"), s)) for s in spans] for spans in out["spans"]]
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object))
        yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: the columns of SCAN_SCHEMA.  ``spans`` are the notices
    found: label, text, start (bytes into the joined words) and edits."""
    return (for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInPandas(_scan_batches, SCAN_SCHEMA))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
