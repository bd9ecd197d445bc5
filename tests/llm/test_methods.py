"""The parts of the training-data operators that run without Spark, against
brute force."""

import json
import random
import re

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import exact_dedup, language, licenses, packing, quality, simhash, spotsigs, toxicity


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- minimal perfect hash ----------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
def test_hash_is_minimal_and_perfect(n):
    words = np.random.default_rng(n).integers(0, 2**64, (n, 4), dtype=np.uint64)
    sizes, bits = exact_dedup.build_hash(words)
    assert sorted(exact_dedup.slots_of(words, sizes, bits)) == list(range(n))
    others = np.random.default_rng(n + 1).integers(0, 2**64, (100, 4), dtype=np.uint64)
    slots = exact_dedup.slots_of(others, sizes, bits)
    assert ((slots >= -1) & (slots < max(n, 1))).all()


# ---- SimHash -----------------------------------------------------------------------------

def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAÄ b\t\x0b\n\x1c\x85 .é"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(random.Random(1).choices(["the", "cat", "sat", "on", "mats"], k=4000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def clusters(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("n", [2, 30, 300])  # pairs, a short run, a long run
def test_bucket_links_connect_what_brute_force_connects(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = centre[rng.integers(0, 3, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    a, b = simhash.bucket_links(np.zeros(len(fps), np.int64), fps, 3)
    assert (np.bitwise_count(a ^ b) <= 63).all() and len(a) < len(fps)
    at = {int(x): i for i, x in enumerate(fps)}
    got = clusters(len(fps), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)])
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 3]
    want = clusters(len(fps), near)
    assert [[i for i in range(len(fps)) if got[i] == g] for g in sorted(set(got))] == [
        [i for i in range(len(fps)) if want[i] == g] for g in sorted(set(want))]


def test_block_choices_cover_all_differences():
    masks = simhash._masks(3)
    assert len(masks) == 20
    for bits in ([0, 1, 2], [5, 30, 63], [10, 11, 33], [0, 21, 42]):
        change = sum(1 << b for b in bits)
        assert any(change & m == 0 for m in masks)


# ---- packing -----------------------------------------------------------------------------

def test_chunked_ids_are_the_whole_texts_ids():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    whole, chunked = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    pool = ["<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x1c", " ", "'s", "I'LL", "J̌", "İ", "Σ", "ß", "中文", "ﬁ",
            "é", "é", "12", "½", "<|", "\x01", "\x85", "　", "A", "word", "word.", "a.,", "!", "?!", ". ", "é. ", "×, ", "÷.", "ß,\n", "«. ", "…, ", "9. ", "\x1c. ", "œ. "]
    rng = random.Random(3)
    texts = ["", " ", "Plain words, twice. Plain words, twice."] + ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(1500)]
    for text, ids in zip(texts, chunked.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


SIGNED = ["É", "È,", "Ñ&&&", "ÿ!!", "ß", "œ", "Œ.", "Σ.", "ж!", "'", "'s", "'LL.", "it's", "<", "<|", "|>", "|", "<|endoftext|>", "&&&",
          "!!", "#1.", "12%%%", "word", "Word", "WORDÉ", "a\u0301.", "=\u0338", "\u0338", "\x01", "\x01.", "\x00", "\x7f.", "\x1c", "\x85",
          "×", "÷!", "\xa0", "½.", "\u0600.", " ", " ", " ", "\n", "\t", "\v"]


def rules_changed(tmp_path, change):
    rules = json.loads(open(packing.default_tokenizer(), encoding="utf-8").read())
    change(rules)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(rules))
    return str(path)


def digits_together(rules):
    pattern = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]
    pattern["Regex"] = pattern["Regex"].replace(r"[\p{N}]|", r"[\p{N}]+|")


@pytest.mark.parametrize("change", [lambda rules: None, digits_together])
def test_signs_and_letters_beyond_ascii_keep_the_whole_texts_ids(tmp_path, change):
    from tokenizers import Tokenizer
    path = rules_changed(tmp_path, change)
    whole, chunked = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    assert (chunked.words is None) == (change is digits_together)
    rng = random.Random(8)
    texts = ["", "&&& ", " &&&", ".", "É"] + ["".join(rng.choices(SIGNED, k=rng.randint(0, 14))) for _ in range(3000)]
    for some in ([], [""], ["", " \n"], texts, texts[::-1]):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in chunked.encode([t.encode() for t in some])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in some]


def test_each_distinct_chunk_is_looked_up_once():
    class Counted(dict):
        looked_up = 0

        def get(self, key, default=None):
            self.looked_up += 1
            return super().get(key, default)

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    tokenizer = packing.ChunkTokenizer(packing.default_tokenizer())
    tokenizer.known = Counted()
    text = "Some words, été and Été; these words&&& come again!! " * 500
    assert len(list(tokenizer.encode([text.encode()] * 4))) == 4
    assert tokenizer.known.looked_up < 50  # of 26,000 chunks
    assert b"words" in tokenizer.known and not {b"words,", b"words&&&", b"again!!"} & tokenizer.known.keys()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_divide_fits_and_loses_nothing(sizes):
    windows = packing.divide(np.array(sizes, np.int64), 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(5).integers(1, 1000, 300)
    sums = [sizes[w].sum() for w in packing.differencing(sizes, 20)]
    assert max(sums) - min(sums) < 0.02 * np.mean(sums)


def test_cuts():
    assert packing._cuts(1) == [(0, 1)]
    assert packing._cuts(4096) == [(0, 4096)]
    assert packing._cuts(4096 + 1500) == [(0, 4096), (4096, 1024), (5120, 476)]


# ---- toxicity ----------------------------------------------------------------------------

def test_search_is_exact():
    rng = np.random.default_rng(4)

    def draw():
        ids = np.sort(rng.choice(50, rng.integers(1, 9), replace=False))
        w = rng.uniform(0.1, 3, len(ids))
        return ids, w / np.linalg.norm(w)

    vectors = [draw() for _ in range(300)]
    telling = rng.uniform(1, 4, 50)
    index = toxicity.BlockMaxIndex(vectors, telling)
    dense = np.zeros((300, 50))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    for but in (-1, 7):
        for k in (1, 15, 290, 400):
            for _ in range(20):
                ids, w = draw()
                cosine = dense[:, ids] @ w
                if but >= 0:
                    cosine[but] = 0
                want = sorted((-c, i) for i, c in enumerate(cosine) if c > 0)[:k]
                found, got, votes = index.search(ids, w, k, but)
                assert but not in found
                assert np.allclose(got, [-c for c, _ in want]) and np.allclose(cosine[found], got)
                assert np.allclose(votes, (dense[found][:, ids] * telling[ids]) @ w)
    none, _, _ = toxicity.BlockMaxIndex([], np.zeros(0)).search(np.array([3]), np.ones(1))
    assert not len(none)


def test_term_places_and_counts():
    ids, n = toxicity.terms_of("Äh, the THE 7x; äh the".encode())
    want = Counter({zlib.crc32(w.encode()) % toxicity.DIMENSIONS: c for w, c in {"Äh": 1, "äh": 1, "the": 3, "7x": 1}.items()})
    assert dict(zip(ids.tolist(), n.tolist())) == want and sorted(ids) == ids.tolist()


# ---- spot signatures -----------------------------------------------------------------------

def test_signatures_and_likeness():
    a = spotsigs.signatures("The quick brown fox jumps over the lazy dog in a wide green field")
    assert spotsigs.as_text(a) == spotsigs.as_text(spotsigs.signatures("the QUICK brown fox -- jumps over the lazy dog in a wide green field!"))
    b = spotsigs.signatures("The quick brown fox jumps over the fence in a wide green field")
    assert spotsigs.likeness(a, b) == len(set(a) & set(b)) / len(set(a) | set(b)) > 0
    assert spotsigs.likeness(a, a) == 1 and len(spotsigs.signatures("")) == 1
    assert spotsigs.likeness(spotsigs.signatures(""), spotsigs.signatures("word")) == 0
    rng = np.random.default_rng(0)
    for _ in range(200):  # pruning by length never hides a pair that is alike enough
        x = np.unique(rng.integers(0, 40, rng.integers(1, 40)))
        y = np.unique(rng.integers(0, 40, rng.integers(1, 40)))
        whole = len(set(x) & set(y)) / len(set(x) | set(y))
        for least in (0.3, 0.5, 0.8):
            assert spotsigs.likeness(x, y, least) == (whole if whole >= least else 0)


def test_edited_text():
    assert spotsigs.edited("abcde", "xyz") == "abcxy"
    assert spotsigs.edited("abcdef", "x") == "abcx"
    assert spotsigs.edited("a", "x") == "a" and spotsigs.edited("", "x") == ""


# ---- license scan --------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "licence", "apache", "General", "public", "é", "x9", ", ", "\n", " "]), max_size=25),
       st.sampled_from([" ", "", "-"]))
def test_phrases(parts, joint):
    text = joint.join(parts)
    words = WORD.findall(lower_az(text))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    n, n_base, first, last, base, labels, score, _ = licenses.scan(text.encode())
    assert (n, n_base) == (len(words), len(places))
    assert (first, last) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
    assert base == ",".join(sorted({label for _, label in places})) and set(base.split(",")) <= set(labels.split(",")) | {""}
    assert 0 <= score <= 1 and (score == 1 if places else True)


def test_notices_with_wrong_characters():
    def found(text):
        return licenses.scan(text.encode())[5]

    assert found("Relesed under the MIT Licence") == "mit"
    assert found("licensed under CC-BY-NC 4.0!") == "cc-by-nc"
    assert found("licensed under CC-BY-ND 4.0") == "cc-by-nd"
    assert found("Permission is herby granted, free of charge, to any\nperson obtaining a copy") == "mit"
    assert found("a driving license is needed here") == ""
    label, text, start, edits = licenses.scan(b"x Relesed under the MIT license")[7][0]
    assert (label, text, edits) == ("mit", "relesed under the mit license", 1)


def test_notices_against_a_scan_without_seeds():
    rng = random.Random(7)
    for _ in range(150):
        notice, label = rng.choice(licenses.NOTICES)
        text = list(f"some words {notice} and more")
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(11, 11 + len(notice))] = rng.choice("abxyz")
        line, _ = licenses.words_in_a_row("".join(text).encode())
        edits, _, pattern = licenses._notice(notice)
        whole = pattern.search(line.decode()) is not None
        assert whole == (label in {s[0] for s in licenses.notice_spans(line, [(notice, label)])})


# ---- quality, language -----------------------------------------------------------------------

def test_statistics_are_finite():
    for text in (b"", b" ", b"\n\n", b"a", "ÄÖ ü".encode(), b"A!! B!! C!!", b"x" * 100000):
        x = quality.statistics(text)
        assert len(x) == len(quality.STATISTICS) and np.isfinite(x).all()


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0, 2]), np.ones(3)).tolist() == [0.5, 0.5, 2]
    assert quality.isotonic(np.array([3.0, 2, 1]), np.array([1.0, 1, 2])).tolist() == [1.75] * 3
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_language_hierarchy():
    texts = {"en": "the cat and the dog went into the house with the others", "de": "der Hund und die Katze gingen über die Straße",
             "fr": "le chat et le chien étaient dans la maison près de l'école", "es": "el perro y el gato estaban en la casa del niño",
             "it": "il cane e il gatto erano nella casa degli altri ragazzi"}
    rng = random.Random(2)
    data = [(lang, " ".join(rng.choices(t.split(), k=12))) for lang, t in texts.items() for _ in range(30)]
    model = language.train(data)
    assert model.families.names == ["germanic", "romance"] and model.within["romance"].names == ["es", "fr", "it"]
    right = sum(model.predict(t)[0] == lang for lang, t in data)
    assert right > 0.95 * len(data)
    assert model.predict(None) == ("und", 1.0) and model.predict("12 + 3!")[0] == "und" and model.predict("")[0] == "und"
    assert language.train([]).predict("word") == ("und", 0.0)
    assert language.train([("en", "one language only")]).predict("word")[0] == "en"
    assert all(0 <= model.predict(t)[1] <= 1 for t in ("é", "x", "word " * 50000))

