"""Packing tokenized documents into sequences by Karmarkar-Karp differencing.

A document's ids (its tokens and the end id) are cut into pieces: whole windows
while they last, then pieces of at most ``TAIL_CUT`` ids.  Whole windows are
sequences by themselves.  The other pieces are dealt by hash over groups of a
bounded number of pieces, and each group is divided into windows of nearly
equal length: every piece starts as a partial partition of its own, and the two
partial partitions with the largest imbalance are merged over and over, fullest
window onto emptiest.  If a window ends above the capacity, the group is
divided again with one window more.

Tokens come from a whole-text tokenizer, but are remembered by chunk: white
space never lies inside a token, so a text's ids are those of its blank-
separated chunks in a row, and most chunks repeat.  The chunks of many texts
are found in their bytes at once, each distinct one is looked up or learned
once, and the texts' ids are gathered from those.

A null text is empty; a document without tokens is one piece of the end id.
Rows that repeat are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import heapq
import json
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, table, written

WINDOW = 4096
TAIL_CUT = 1024  # ids: a document's rest beyond whole windows is cut to pieces of this size
GROUP_PIECES = 512  # pieces divided together, on average
LEARNED_AT_ONCE = 1000  # chunks; more slow the tokenizer down
CACHED_CHUNKS = 600_000  # chunks of a generation; a worker remembers two
SLICE_BYTES = 4_000_000  # texts whose chunks are looked up together
END_ID = 2

_BETWEEN = b"\x01"  # one token in every byte-level vocabulary; chunks that hold it are encoded alone
_SPECIAL = b"<|"  # may begin a special token, whose case counts
# Kinds of bytes: blanks, letters and digits, the rest of ASCII, beyond.
_BLANK, _ALNUM, _SIGN, _BEYOND = range(4)
_KINDS = np.array([_BLANK if c in b" \t\n\r\v\f" else _BEYOND if c > 127 else _ALNUM if chr(c).isalnum() else _SIGN
                   for c in range(256)], np.uint8)
_UP_TO_LATIN1 = bytes(c for c in range(256) if c < 0xC2 or c == 0xC3)
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # up to U+00FF
# Rules by which a chunk of _LETTERS is one word, in lower case, its bytes spelled as characters of _SPELLED.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = "".join(chr(c if c in _PRINTED else 256 + sum(x not in _PRINTED for x in range(c))) for c in range(256))

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ---- ids ---------------------------------------------------------------------------------

def _only_latin1_letters(text: bytes) -> bool:
    """Whether all characters beyond ASCII are those of U+00C0 to U+00FF that are letters."""
    return not text.translate(None, _UP_TO_LATIN1) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text


def _chunked(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The chunks of all texts in a row, and the place of each text's first (and of the end)."""
    joined = b" ".join([b"", *texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    kinds = _KINDS[raw]
    inked, sign = kinds != _BLANK, kinds == _SIGN
    first = inked.copy()
    first[1:] &= ~inked[:-1]
    # a letter or digit ends a token before signs, so signs between one and a blank are a chunk of
    # their own, unless they may close a special token
    edges = np.flatnonzero(sign[1:] != sign[:-1]) + 1  # blanks at both ends: a run of signs starts and ends
    start, end = edges[::2], edges[1::2]
    start = start[~inked[end]]
    before, lead = raw[start - 1], raw[start - 2]
    latin1 = (kinds[start - 1] == _BEYOND) & (lead == 0xC3) & (before != 0x97) & (before != 0xB7)
    first[start[((kinds[start - 1] == _ALNUM) | latin1) & (raw[start] != _SPECIAL[1])]] = True
    ink = raw[inked]
    offsets = np.append(np.flatnonzero(first[inked]), len(ink))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ink)])
    return words, np.searchsorted(np.flatnonzero(first), begins)


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        vocabulary = self.tokenizer.get_vocab()
        # the same vocabulary without the rules that only find and spell words, if they are these
        self.words = Tokenizer(self.tokenizer.model) if (
            (rules["normalizer"] or {}).get("normalizers") == _NORMALIZERS and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _WORDS} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and rules["model"].get("end_of_word_suffix") == _WORD_END
            and all(c in vocabulary and c + _WORD_END in vocabulary for c in _SPELLED)) else None
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.between = self._ids(_BETWEEN)[0]  # the id that stands between chunks

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def lowered(text: bytes) -> bytes:
        """A-Z in lower case, as in the vocabulary, where no mark may combine with them."""
        return text.lower() if _SPECIAL not in text and (text.isascii() or _only_latin1_letters(text)) else text

    def _keep(self, chunks: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        raw, start = ids.tobytes(), 0
        for chunk, end in zip(chunks, (4 * ends).tolist()):
            self.known[chunk] = raw[start:end]
            start = end + 4 * gap

    def _learn_letters(self, chunks: list[bytes]) -> None:
        """Ids from one list of words; a word's last token alone has the mark of an end."""
        lower = b" ".join(chunks).decode().lower().encode()
        words = codecs.charmap_decode(lower, "strict", _SPELLED)[0].split(_SPELLED[ord(" ")])
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        self._keep(chunks, ids, np.flatnonzero(self.ends_word[ids]) + 1, 0)

    def _learn_plain(self, chunks: list[bytes]) -> None:
        """Ids from one text, a known single token between each two chunks."""
        ids = self._ids((b" " + _BETWEEN + b" ").join([*chunks, _BETWEEN]))
        self._keep(chunks, ids, np.flatnonzero(ids == self.between), 1)

    def learn(self, chunks: list[bytes]) -> None:
        letters, plain = [], []
        for c in chunks:
            if self.words is not None and _LETTERS.fullmatch(c):
                letters.append(c)
            elif _BETWEEN in c or _SPECIAL in c:
                self.known[c] = self._ids(c).tobytes()
            else:
                plain.append(c)
        for learn, some in ((self._learn_letters, letters), (self._learn_plain, plain)):
            for i in range(0, len(some), LEARNED_AT_ONCE):
                learn(some[i:i + LEARNED_AT_ONCE])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        words, begins = _chunked([self.lowered(t) for t in texts])
        words = words.dictionary_encode()
        chunks = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_CHUNKS:  # a new generation; what the last one had in use moves over
            self.older, self.known = self.known, {}
        ids = list(map(self.known.get, chunks))
        missing = [i for i, known in enumerate(ids) if known is None]
        again = {c: self.older[c] for c in map(chunks.__getitem__, missing) if c in self.older}
        self.known.update(again)
        self.learn([c for c in map(chunks.__getitem__, missing) if c not in again])
        for i in missing:
            ids[i] = self.known[chunks[i]]
        found = pa.array(ids, pa.large_binary()).take(words.indices)
        at = np.frombuffer(found.buffers()[1], np.int64)[begins].tolist() if len(found) else [0] * len(begins)
        raw = memoryview(found.buffers()[2] or b"")
        for start, end in zip(at, at[1:]):
            yield bytes(raw[start:end])


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One for a worker process and all its tasks: what it has learned stays."""
    return ChunkTokenizer(path)


def _slices(texts: pd.Series) -> Iterator[list[bytes]]:
    """The texts in runs of about SLICE_BYTES, so that few chunks are held at once."""
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    yield held


def _cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole = n // WINDOW * WINDOW
    return ([(s, WINDOW) for s in range(0, whole, WINDOW)]
            + [(s, min(TAIL_CUT, n - s)) for s in range(whole, n, TAIL_CUT)])


def _piece_batches(path: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = worker_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            rows = []
            encoded = (ids for part in _slices(pdf["text"]) for ids in tokenizer.encode(part))
            for doc_id, ids in zip(pdf["doc_id"], encoded):
                ids += end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                view, n = memoryview(ids), len(ids) // 4
                rows += [(doc_id, s, m, zlib.crc32(view[4 * s:4 * (s + m)]), n) for s, m in _cuts(n)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return (for_workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInPandas(_piece_batches(tokenizer_path), PIECE_SCHEMA))


# ---- differencing ------------------------------------------------------------------------

def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """``sizes`` divided into k bins of nearly equal sums: lists of positions."""
    n = len(sizes)
    pair: dict[int, tuple[int, int]] = {}  # a bin made of two bins
    heap = []
    for tick, i in enumerate(np.argsort(-sizes, kind="stable")):
        total, bin_ = np.zeros(k, np.int64), np.full(k, -1)
        total[-1], bin_[-1] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, tick, total, bin_))
    heapq.heapify(heap)
    made, tick = n, n
    while len(heap) > 1:
        (_, _, total, bin_), (_, _, other, added) = heapq.heappop(heap), heapq.heappop(heap)
        total, added = total + other[::-1], added[::-1]  # both ascend: fullest onto emptiest
        merged = np.where(bin_ >= 0, bin_, added)
        for j in np.flatnonzero((bin_ >= 0) & (added >= 0)):
            pair[made] = (int(bin_[j]), int(added[j]))
            merged[j] = made
            made += 1
        order = np.argsort(total, kind="stable")
        total, tick = total[order], tick + 1
        heapq.heappush(heap, (-int(total[-1] - total[0]), tick, total, merged[order]))
    out = []
    for root in heap[0][3] if heap else []:
        members, todo = [], [int(root)] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x in pair:
                todo += pair[x]
            else:
                members.append(x)
        out.append(members)
    return out


def divide(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity`` (no size is above it)."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        windows = differencing(sizes, k)
        if max((int(sizes[w].sum()) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


def _pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
    size = pdf["length"].to_numpy(np.int64)
    rest = np.flatnonzero(size < WINDOW)
    windows = [[i] for i in np.flatnonzero(size == WINDOW)] + [rest[w].tolist() for w in divide(size[rest], WINDOW)]
    number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for i, window in enumerate(windows):
        window = sorted(window)
        number[window] = i
        offset[window] = np.cumsum(size[window]) - size[window]
    out = pdf.drop(columns=["group", "salt"])
    out["sequence_id"] = (int(key[0]) << 24) + number
    out["offset"] = offset
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, and its
    place: sequence_id and offset."""
    # equal pieces are told apart by a salt that is written with them, so that any number of them is dealt out
    salted = pieces(docs, tokenizer_path or default_tokenizer()).withColumn("salt", F.monotonically_increasing_id())
    rows = written(salted, "pieces")
    groups = max(1, math.ceil(rows.count() / GROUP_PIECES))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "salt"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack_group, PACKED_SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
