"""The registered queries on whole tables: against their SQL, brute force or
held-out labels; and the pipeline, stage by stage."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as ent
import corpus_pipeline
from conftest import SF001, SF01
from oracle_check import compare, duck
from strata.llm import packing, quality, spotsigs, toxicity
from test_methods import brute_fingerprint, lower_az


@pytest.fixture(scope="module")
def duck001():
    return duck(SF001)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def run(spark, key, sf=SF001):
    return ent.queries()[key](spark, sf).collect()


@pytest.mark.parametrize("key", ["op1_mixing", "op2_exact_dedup", "op10_url_filter"])
def test_against_sql(spark, duck001, key):
    assert compare(spark, duck001, key, ent.queries()[key], ent.oracle_sql()[key], SF001)


def check_packing(rows, documents):
    """``documents``: Counter of (doc_id, ids as a tuple)."""
    windows, pieces = defaultdict(list), defaultdict(Counter)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    used = padding = 0
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    want = defaultdict(Counter)
    for (doc_id, ids), times in documents.items():
        for start, length in packing._cuts(len(ids)):
            want[doc_id][start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()), len(ids)] += times
        assert sum(m for _, m in packing._cuts(len(ids))) == len(ids)
    assert pieces == want
    return padding / (used + padding)


def token_ids(documents):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return Counter((d, (*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID)) for d, t in documents)


def test_packing(spark, texts):
    assert check_packing(run(spark, "op3_packing"), token_ids(texts.items())) < 0.03


def components(fingerprints):
    """doc_id -> smallest doc_id reachable over fingerprints at most 3 bits apart."""
    parent = {d: d for d in fingerprints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in fingerprints.items():
        for b, y in fingerprints.items():
            if a < b and bin(x ^ y).count("1") <= 3:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in fingerprints}


def test_simhash(spark, texts):
    prints = {d: brute_fingerprint(t or "") for d, t in texts.items()}
    want = components(prints)
    got = run(spark, "op5_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        d: (f"{prints[d]:016x}", want[d]) for d in texts} and len(got) == len(texts)


def test_spotsigs(spark, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in run(spark, "op6_document_fingerprints")}
    assert sorted(got) == order
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (set(spotsigs.signatures(t).tolist()) for t in (text, edited, after))
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert set(re.findall("." * 8, r["fingerprint"])) == {f"{x:08x}" for x in a}
        assert np.isclose(r["near_edited"], len(a & b) / len(a | b)) and np.isclose(r["near_next"], len(a & c) / len(a | c))
    near = [r["near_edited"] for r in got.values()]
    assert np.median(near) > 0.25 > 0.05 > np.median([r["near_next"] for r in got.values()])


def test_license_scan(spark, texts):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in run(spark, "op7_license_scan", SF01)}
    documents = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(documents)
    for row in documents:
        words = word.findall(lower_az(row["text"]))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        r = got[row["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert "cc by nc" not in " ".join(words) or r["labels"] == "cc-by-nc" or places


@pytest.mark.parametrize("key,label,divisor,rest,accuracy", [
    ("op8_quality_classifier", "quality", 5, 0, 0.97), ("op4_toxicity", "toxic", 3, 1, 0.9)])
def test_held_out_labels(spark, key, label, divisor, rest, accuracy):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = run(spark, key, SF01)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= accuracy


def test_quality_against_a_dense_fit(spark, texts):
    order = sorted(texts)
    x = np.array([quality.statistics((texts[d] or "").encode()) for d in order])
    rng = np.random.default_rng(quality.SEED)
    waves, phases = rng.normal(size=(x.shape[1], 200)) / 3.0, rng.uniform(0, 2 * np.pi, 200)
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -4, 4)
    f = np.hstack([np.sqrt(2 / 200) * np.cos(z @ waves + phases), np.ones((len(x), 1))])
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect() if r["quality"] is not None}
    learn = [i for i, d in enumerate(order) if d in marks and zlib.crc32(str(d).encode()) % 5 != 0]
    y = np.array([marks[order[i]] for i in learn], float)
    damping = np.diag([1.0] * 200 + [1e-3])  # roots of the penalties
    raw = f @ np.linalg.lstsq(np.vstack([f[learn], damping]), np.concatenate([y, np.zeros(201)]), rcond=None)[0]
    cell = np.floor(np.clip(raw[learn], -1, 2) * 1000)
    cells = np.unique(cell)
    total, count = (np.concatenate([[0], np.cumsum([g(y[cell == c]) for c in cells])]) for g in (np.sum, len))
    fit = [max(min((total[k] - total[j]) / (count[k] - count[j]) for k in range(i + 1, len(total))) for j in range(i + 1))
           for i in range(len(cells))]  # least-squares monotone fit by its min-max formula
    want = dict(zip(order, np.interp(raw, (cells + 0.5) / 1000, fit)))
    got = {r["doc_id"]: r["score"] for r in run(spark, "op8_quality_classifier")}
    off = np.array([abs(got[d] - want[d]) for d in order])  # sums in another order may move a row over a cell's edge
    assert sorted(got) == order and off.max() < 0.05 and np.mean(off < 1e-6) > 0.9


def test_toxicity_against_dense_cosines(spark, texts):
    """The whole query again with dense vectors: every learnable row is an example at this size."""
    labels = defaultdict(int)
    for r in spark.read.parquet(f"{SF001}/labels.parquet").collect():
        if r["toxic"] is not None:
            labels[r["doc_id"]] = max(labels[r["doc_id"]], r["toxic"])
    words = {d: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", lower_az(t).encode())) for d, t in texts.items()}
    place = {w: zlib.crc32(w) % toxicity.DIMENSIONS for c in words.values() for w in c}
    column = {p: i for i, p in enumerate(sorted(set(place.values())))}
    counts = np.zeros((len(texts), len(column)))
    row = {d: i for i, d in enumerate(sorted(texts))}
    for d, c in words.items():
        for w, n in c.items():
            counts[row[d], column[place[w]]] += n
    df = (counts > 0).sum(axis=0)
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.log((len(texts) + 1) / (df + 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    examples = [d for d in sorted(texts) if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    assert max(len((texts[d] or "").encode()) for d in examples) <= toxicity.EXAMPLE_BYTES
    e, y = x[[row[d] for d in examples]], np.array([labels[d] for d in examples], float)
    has, n, p = counts[[row[d] for d in examples]] > 0, len(y), y.sum()
    a, m = (has * y[:, None]).sum(axis=0), has.sum(axis=0)
    chi2 = n * (a * (n - m - p + a) - (m - a) * (p - a)) ** 2 / np.maximum(m * (n - m) * p * (n - p), 1)
    tells = np.sqrt(1 + chi2)
    share = np.mean([v for d, v in labels.items() if zlib.crc32(str(d).encode()) % 3 != 1])

    def vote(v, but=None):
        cosine = e @ v
        near = sorted((-c, i) for i, c in enumerate(cosine) if c > 1e-12 and i != but)
        if not near:
            return None, None
        last = near[:toxicity.NEIGHBOURS][-1][0]
        clear = len(near) <= toxicity.NEIGHBOURS or near[toxicity.NEIGHBOURS][0] - last > 1e-9  # no tie at the last place
        weight = {i: (e[i] * tells) @ v for _, i in near[:toxicity.NEIGHBOURS]}
        return sum(w * y[i] for i, w in weight.items()) / sum(weight.values()), clear

    own = [vote(v, i)[0] for i, v in enumerate(e)]
    weight = np.where(y == 1, share / p, (1 - share) / (n - p)) * n
    seen = sorted({v for v in own if v is not None})
    total = [sum(w for v, w in zip(own, weight) if v == s) for s in seen]
    mean = [sum(w * t for v, w, t in zip(own, weight, y) if v == s) / q for s, q in zip(seen, total)]
    chance = quality.isotonic(np.array(mean), np.array(total))
    got = {r["doc_id"]: r["score"] for r in run(spark, "op4_toxicity")}
    compared = 0
    for d in texts:
        v, clear = vote(x[row[d]])
        if clear:
            compared += 1
            assert abs(got[d] - np.interp(v, seen, chance)) < 0.02, d  # equal votes may differ in their last digit
    assert compared > 100


def test_toxicity_finds_toxic_rows_and_leaves_clean_ones(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in run(spark, "op4_toxicity", SF01) if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert sum(toxic) >= 0.4 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def _byte_pairs(text):
    """Pairs of neighbouring bytes, straight from the rule: a-z and all beyond ASCII stay, others are blanks."""
    kept = [chr(b).lower() if b < 128 and chr(b).isalpha() else f"+{b}" if b >= 128 else " " for b in text.encode()]
    line = [" ", *kept, " "]
    return Counter((a, b) for a, b in zip(line, line[1:]) if (a, b) != (" ", " "))


def _exact_svm(x, y, cost=10.0):
    """Least 0.5 w.w + cost * sum of squared hinges, by Newton's steps on the support vectors' system."""
    kernel, active, seen = x @ x.T, np.ones(len(y), bool), 0
    while True:
        beta = np.zeros(len(y))
        beta[active] = np.linalg.solve(kernel[np.ix_(active, active)] + np.eye(active.sum()) / (2 * cost), y[active])
        again, seen = y * (kernel @ beta) < 1, seen + 1
        if (again == active).all() or seen == 100:
            assert seen < 100
            return x.T @ beta
        active = again


def test_language_against_dense_separators(spark, texts):
    """The whole query at sf0.001 against every separator solved exactly on dense rows."""
    from strata.llm.language import EXAMPLES, FAMILIES
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang", "text").collect()
    learned = [(r["lang"], _byte_pairs(r["text"])) for r in rows
               if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    learned = [(lang, pairs) for lang, pairs in learned if pairs]
    langs = [lang for lang, _ in learned]
    assert max(Counter(langs).values()) <= EXAMPLES  # all of them are the sample
    family = {lang: next((name for name, members in FAMILIES.items() if lang in members), lang) for lang in langs}
    place = {pair: i for i, pair in enumerate(sorted({p for _, pairs in learned for p in pairs}))}

    def shares(pairs):
        out = np.zeros(len(place) + 1)
        for pair, n in pairs.items():
            if pair in place:
                out[place[pair]] = n / sum(pairs.values())
        return out

    x = np.array([shares(pairs) for _, pairs in learned])
    mean = x.mean(axis=0)
    scale = np.append(1 / np.sqrt(mean[:-1] * len(place)), 1.0)
    x = x * scale
    x[:, -1] = 1.0
    of = np.array([family[lang] for lang in langs])
    names = sorted(set(of))
    assert len(names) > 1 and any(len({lang for lang in langs if family[lang] == name}) > 1 for name in names)
    outer = {name: _exact_svm(x, np.where(of == name, 1.0, -1.0)) for name in names}
    inner = {}
    for a, b in combinations(sorted(set(langs)), 2):
        if family[a] == family[b]:
            use = np.array([lang in (a, b) for lang in langs])
            inner[a, b] = _exact_svm(x[use], np.where(np.array(langs)[use] == a, 1.0, -1.0))
    got = {r["doc_id"]: r for r in run(spark, "op9_language_id", SF001)}
    assert len(got) == len(rows)
    for r in rows:
        pairs, found = _byte_pairs(r["text"] or ""), got[r["doc_id"]]
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (found["lang_pred"], found["score"]) == ("und", 1.0)
            continue
        z = shares(pairs) * scale
        z[-1] = 1.0
        by_family = {name: z @ w for name, w in outer.items()}
        best = max(names, key=lambda name: by_family[name])
        members = sorted({lang for lang in langs if family[lang] == best})
        against = {lang: [z @ w if a == lang else -(z @ w) for (a, b), w in inner.items() if lang in (a, b)] for lang in members}
        lang = max(members, key=lambda m: (sum(v >= 0 for v in against[m]), sum(against[m])))
        margin = min([by_family[best], *against[lang]])
        assert found["lang_pred"] == lang
        assert found["score"] == pytest.approx(1 / (1 + np.exp(-4 * margin)), abs=0.01)


def test_held_out_languages(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = run(spark, "op9_language_id", SF01)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.98


def brute_mix(documents):
    """The mix as a list of (doc_id, source, size) -> times, straight from the rule."""
    sizes = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in documents]
    total = sum(n for _, _, n in sizes)
    of = Counter()
    for _, s, n in sizes:
        of[s] += n
    names = sorted(of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:  # share anew what is above the caps
        level = (total - sum(3 * of[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if 3 * of[s] <= level * weight[s]}
        if over == full:
            break
        full = over
    target = {s: min(3.0 * of[s], level * weight[s]) for s in names}
    entries = []
    for i, s in enumerate(names):
        queue, seen = [], Counter()
        for (d, x, n), (_, _, text) in zip(sizes, documents):
            if x == s:
                name = f"mix:{'' if d is None else d}:{hashlib.md5((text or '').encode()).hexdigest()}"
                queue.append((int(hashlib.md5(f"{name}:{seen[name]}".encode()).hexdigest()[:15], 16), d, n))
                seen[name] += 1
        queue.sort(key=lambda e: e[0])
        for turn in range(3):
            sent = turn * of[s]
            for h, d, n in queue:
                sent += n
                if n and turn < np.ceil(target[s] / of[s]):
                    entries.append((sent / target[s], i, h, d, n, turn, s))
    times, used = Counter(), 0
    for e in sorted(entries):
        used += e[4]
        if used > total:
            break
        times[e[3]] += 1
    return times


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    rejected = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 0").collect()}
    want = [r for r in docs.collect() if r["doc_id"] not in rejected]
    last = {}
    for r in want:
        k = lower_az(r["text"])
        last[k] = max(last.get(k, r), r, key=lambda x: x["doc_id"])
    want = list(last.values())
    component = components({r["doc_id"]: brute_fingerprint(r["text"]) for r in want})
    want = [r for r in want if component[r["doc_id"]] == r["doc_id"]]
    times = brute_mix([(r["doc_id"], r["source"], r["text"]) for r in want])
    mixed = [(r["doc_id"], r["text"]) for r in want for _ in range(times[r["doc_id"]])]
    ids = Counter({(d, t): 0 for d, t in mixed})
    ids.update(mixed)
    tokens = Counter()
    for (d, t), n in ids.items():
        (one,) = token_ids([(d, t)])
        tokens[one] = n
    check_packing(corpus_pipeline.run(spark, SF001).collect(), tokens)
