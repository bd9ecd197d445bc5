"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, through every operator and every pipeline stage."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strata.llm import (
    exact_dedup, language, licenses, mixing, packing, quality, simhash, spotsigs, toxicity, url_filter,
)
from strata.session import scratch_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, score string, fp string, "
          "part string, kept string")  # the last five clash with names the operators use
LONG = "The sentence goes on and on with words of every kind. " * 4000

TEXTS = [
    (1, "The same text, with THE same words in it again and again."),
    (2, "the same text, with the same words in it again and again."),
    (3, "Der Hund und die Katze gingen zusammen über die lange Straße nach Hause."),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (8, "one"),
    (9, "one two"),
    (10, "12 34 !!"),
    (None, "A text whose id is missing stands here with the others."),
    (None, None),
    (11, "A row that is there twice, the same in all columns."),
    (11, "A row that is there twice, the same in all columns."),
    (12, "Un texte avec le même identifiant que celui de la ligne suivante."),
    (12, "Otro texto con el mismo identificador que el de la fila anterior."),
    (13, "A tie of ids and texts, but the sources are not the same."),
    (13, "A tie of ids and texts, but the sources are not the same."),
]


def rows():
    out = []
    for i, (doc_id, text) in enumerate(TEXTS):
        lang = ["en", "de", "fr", None][i % 4]
        source = ["a", "b", None, "ß", "A"][i % 5] if doc_id != 11 else "a"
        lang = lang if doc_id != 11 else "en"
        out.append((doc_id, text, lang, source, None if text is None else len(text), "s", "s", "s", "s", "s"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(3, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 0)],
        "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def sf_dir(spark, labels):
    path = scratch_path(spark, "edge-tables")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


ALL = Counter(d for d, _ in TEXTS)


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_mixing(docs, none):
    got = mixing.weighted_fair_mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == ALL
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["size"] == len((dict(TEXTS).get(r["doc_id"]) or "").split()) for r in got if ALL[r["doc_id"]] == 1)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert mixing.weighted_fair_mix(none).count() == 0
    blank = docs.where("doc_id IN (4, 5, 6)")
    assert [(r["target"], r["taken"]) for r in mixing.weighted_fair_mix(blank).collect()] == [(0.0, 0)] * 3


@pytest.mark.parametrize("ids", ["CAST(NULL AS LONG)", "IF(id % 3 = 0, NULL, id)", "IF(id % 3 = 0, 7L, id)", "id"])
def test_mixing_meets_targets_whatever_repeats(spark, ids):
    docs = spark.range(6000).selectExpr(
        f"{ids} AS doc_id", "IF(id % 3 = 0, 'ten words of text that are the same in all', concat('ten words of text that are the same but ', id)) AS text",
        "IF(id % 2 = 0, 'a', 'b') AS source", "'en' AS lang")
    got = mixing.weighted_fair_mix(docs).collect()
    assert len(got) == 6000 and sum(r["size"] for r in got) == 60_000 >= sum(r["taken"] for r in got) > 59_980
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * 10 and all(r["taken"] <= 3 * r["size"] for r in mine)
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    count = Counter(r["source"] for r in rows.collect())
    assert count == Counter({s: sum(r["times"] for r in got if r["source"] == s) for s in "ab"})


def test_packing_deals_equal_rows_over_groups(spark):
    docs = spark.range(3000).repartition(4).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id % 3 = 0, '', 'a repeated row of text') AS text")
    rows = packing.pack(docs).collect()
    groups = Counter(r["sequence_id"] >> 24 for r in rows)
    assert len(rows) == 3000 and max(groups.values()) < 2 * packing.GROUP_PIECES and len(groups) > 3


def test_exact_dedup(docs, none, spark):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for d, t in TEXTS:
        groups[hashlib.sha256(lower_az(t).encode()).hexdigest()].append(d)
    assert len(got) == len(TEXTS) and all(r["member"] for r in got)
    for r in got:
        group = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (max((d for d in group if d is not None), default=None), len(group))
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(groups, 1))
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_against_another_history(docs, none, spark):
    history = spark.createDataFrame([(70, "ONE"), (71, "one"), (72, "unseen"), (None, "one two")], "doc_id long, text string")
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(docs, history).collect()}
    sha = {t: hashlib.sha256(lower_az(t).encode()).hexdigest() for _, t in TEXTS}
    one, two = got[8, sha["one"]], got[9, sha["one two"]]
    assert (one["member"], one["kept"], one["keep_id"], one["group_size"]) == (True, False, 71, 2)
    assert (two["member"], two["kept"], two["keep_id"], two["group_size"]) == (True, False, None, 1)
    same = [r for r in exact_dedup.exact_dedup(docs, history).collect() if r["text_sha256"] == sha[TEXTS[12][1]]]
    assert [(r["member"], r["keep_id"], r["group_size"]) for r in same] == [(False, 11, 2)] * 2
    assert sum(r["kept"] for r in same) == 1
    assert exact_dedup.exact_dedup(docs, none.select("doc_id", "text")).where("member").count() == 0


def test_exact_dedup_with_a_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_SHARD", 16)
    monkeypatch.setattr(exact_dedup, "ROWS_PER_LOOKUP", 20)
    docs = spark.range(300).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id)) AS text")
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    assert all((r["keep_id"], r["group_size"]) == ((297, 100) if r["doc_id"] % 3 == 0 else (r["doc_id"], 1)) for r in got)
    assert sum(r["kept"] for r in got) == 201


def test_exact_dedup_counts_repeats_before_the_lookup(spark, monkeypatch):
    looked = []
    look_up = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda rows, *rest: looked.append(rows.collect()) or look_up(rows, *rest))
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, '', concat('t', id)) AS text")
    got = exact_dedup.exact_dedup(docs).collect()
    assert [len(rows) for rows in looked] == [2001] and len(got) == 3000
    hot = [r for r in got if r["doc_id"] is None]
    assert [r["group_size"] for r in hot] == [1000] * 1000 and sum(r["kept"] for r in hot) == 1
    assert sum(r["kept"] for r in got) == 2001


def test_kept_rows_are_one_a_key(spark):
    docs = spark.range(900).selectExpr(
        "IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'Hot', concat('t', id)) AS text", "IF(id = 6, 'b', 'a') AS source",
        "map('k', id) AS `a.b`", "'x' AS __key")
    rows = exact_dedup.stay(docs)
    assert rows.schema.names == docs.columns
    kept = rows.collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([None, *(i for i in range(900) if i % 3)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t in TEXTS:
        want[d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    got = packing.pack(docs).collect()
    pieces, windows = defaultdict(Counter), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"]] += 1
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: v for k, v in want.items()} == {k: next(iter(p.values())) for k, p in pieces.items()}
    for (_, n), p in pieces.items():
        at = 0
        for (start, length), _ in sorted(p.items()):
            assert start == at
            at += length
        assert at == n
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(none).count() == 0


def test_toxicity(docs, none, labels):
    marks = labels.selectExpr("doc_id", "toxic AS y")
    import pyspark.sql.functions as F
    got = toxicity.toxicity_scores(docs, marks, F.lit(True))
    assert ids(got) == ALL and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.toxicity_scores(none, marks, F.lit(True)).count() == 0
    unlabelled = toxicity.toxicity_scores(docs, marks.where("false"), F.lit(True)).collect()
    assert {(r["score"], r["predicted"]) for r in unlabelled} == {(0.0, 0)}


def test_toxicity_finds_marked_words(spark):
    import pyspark.sql.functions as F
    docs = spark.range(400).selectExpr("id AS doc_id", """concat('some plain words number ', id, IF(id % 4 = 0,
        concat(' you awful', id % 3, 'ness fool and dreadful person'), ' and a kind remark about the weather')) AS text""")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS y").where("doc_id < 300")
    got = toxicity.toxicity_scores(docs, labels, F.col("doc_id") % 10 != 3).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    some = next(r for r in got if r["doc_id"] == 360)
    assert len(some["evidence"]) == 3 and all(e["label"] == 1 and e["doc_id"] % 4 == 0 for e in some["evidence"])


def test_simhash(docs, none):
    got = simhash.simhash_near_dedup(docs).collect()
    assert Counter(r["doc_id"] for r in got) == ALL
    by_text = {hashlib.md5((t or "").encode()).digest(): simhash.fingerprint((t or "").encode()) for _, t in TEXTS}
    assert Counter(r["fingerprint"] for r in got) == Counter(
        f"{by_text[hashlib.md5((t or '').encode()).digest()]:016x}" for _, t in TEXTS)
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert (component[1], component[2], component[4], component[5], component[6]) == (1, 1, 4, 4, 4)
    assert component[11] == 11 and component[13] == 13
    blank = "0" * 16
    assert all(r["component_id"] == 4 for r in got if r["fingerprint"] == blank)  # a null id never names one
    assert simhash.simhash_near_dedup(none).count() == 0


def test_simhash_splits_hot_buckets_without_losing_links(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 40, 60).astype(np.uint64))
                    ^ (np.uint64(1) << rng.integers(0, 40, 60).astype(np.uint64)))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(table, bucket_rows=8).collect()
    label = {int(x): int(x) for x in fps.view(np.int64)}

    def join(label, pairs):
        for a, b in pairs:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    near = [(int(a), int(b)) for a in fps.view(np.int64) for b in fps.view(np.int64)
            if a < b and bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 3]
    assert join(label, [(r["a"], r["b"]) for r in links]) == join(label, near)


def test_spotsigs(docs, none):
    got = spotsigs.fingerprints(docs).collect()
    assert Counter(r["doc_id"] for r in got) == ALL
    by_id = {r["doc_id"]: r for r in got}
    first = by_id[1]  # ids 1 and 2 follow each other and differ in case only
    assert first["near_next"] == 1 and first["n_chars"] == len(TEXTS[0][1])
    edited = spotsigs.edited(TEXTS[0][1], TEXTS[1][1])
    assert first["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[7]["n_chars"] == len(LONG) and by_id[4]["n_chars"] == 0
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"] == by_id[6]["fingerprint"]
    last = by_id[13]  # wraps around to the first: a null id
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got) and last is not None
    assert spotsigs.fingerprints(none).count() == 0
    alone = spotsigs.fingerprints(docs.where("doc_id = 3")).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, len(TEXTS[2][1]))]


def alike(rows, least):
    """Class (least id) and links of each row of (id, text), by all pairs."""
    sets = [set(spotsigs.signatures(t or "").tolist()) for _, t in rows]
    near = [[j for j, y in enumerate(sets) if j != i and len(x & y) >= least * len(x | y)] for i, x in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(near[i])))
    return Counter(out)


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_near_documents_against_all_pairs(spark, docs, none, monkeypatch, least):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(d, t) for d, t in TEXTS]
    for family in range(12):
        base = ["the" if i % 3 == 0 else words[rng.integers(400)] for i in range(int(rng.integers(20, 300)))]
        for _ in range(int(rng.integers(1, 25))):
            text = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, max(2, len(base) // 12)))):
                text[at] = words[rng.integers(400)]
            rows.append((100 + len(rows) if rng.random() > 0.1 else None, " ".join(text)))
    rows += [(None, "a hot row of the one text")] * 60
    got = spotsigs.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least).collect()
    assert Counter(map(tuple, got)) == alike(rows, least)
    assert len({r["class_id"] for r in got}) > 10 and max(r["n_links"] for r in got) >= 59
    assert spotsigs.near_documents(none).count() == 0


def test_hot_ids_are_dealt_over_ranges(spark):
    docs = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "concat('the text of number ', id) AS text")
    rows = spotsigs.with_successors(docs).where("copy = 0").groupBy("range").count().collect()
    assert sum(r["count"] for r in rows) == 3000 and max(r["count"] for r in rows) < 600
    order = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in docs.collect())
    got = spotsigs.fingerprints(docs).collect()
    after = {text: order[(i + 1) % 3000][1] for i, (_, text) in enumerate(order) if i >= 1500}  # null ids follow by hash
    want = Counter(hashlib.sha256(spotsigs.edited(t, a).encode()).hexdigest() for t, a in list(after.items())[:-1])
    assert not want - Counter(r["edited_sha256"] for r in got) and len(got) == 3000


def test_license_scan(docs, none):
    got = licenses.license_scan(docs)
    assert ids(got) == ALL
    assert {r["n_words"] for r in got.where("doc_id IN (4, 5, 6)").collect()} == {0}
    assert licenses.license_scan(none).count() == 0


def test_quality(docs, none, labels, spark):
    got = quality.quality_scores(docs, labels)
    assert ids(got) == ALL and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.quality_scores(none, labels).count() == 0
    unlabelled = quality.quality_scores(docs, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in unlabelled} == {(0.5, 1)}


def test_language(docs, none):
    import pyspark.sql.functions as F
    model = language.learn(docs, F.lit(True))
    got = language.identify(docs, model)
    assert ids(got) == ALL
    assert {r["lang_pred"] for r in got.where("doc_id IN (4, 5, 6, 10)").collect()} == {"und"}
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "de", "fr", "und"}
    assert language.identify(none, language.learn(none, F.lit(True))).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "a://b.net/es/q",
            "a://b.net/es", "a://net/fr/", "http://x.com", "http://x.com?/y", "http://com/", "http://evilcom/", "http://a.com/#b",
            "http://example.com.net/en/", "http://É.Com/x", "h://u://w.com/", "http://" + "a." * 3000 + "com/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, keys string, word string")
    got = url_filter.filter_urls(pages, url_filter.RULES).orderBy("page_id").collect()
    for r, url in zip(got, urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = lower_az(rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, url_filter.DEFAULT)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want[1:]), url
    assert url_filter.filter_urls(pages.where("false"), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_url_rules_start_no_python(spark, monkeypatch):
    pages = spark.range(50).selectExpr("id AS page_id", "concat('https://a', id % 3, '.example.com/en/', id) AS url")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: pytest.fail("rows from Python"))
    got = url_filter.filter_urls(pages, url_filter.RULES)
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    assert {(r["rule"], r["verdict"]) for r in got.collect()} == {("example.com/en/", "block")}


def test_cascade_is_exact_for_the_whole_universe(spark):
    universe = spark.range(3000).selectExpr("concat('key', id) AS key")
    listed = universe.where("key LIKE '%7'")
    cascade = url_filter.build_cascade(listed, universe)
    import pyspark.sql.functions as F
    wrong = universe.where(cascade.member(F.col("key")) != F.col("key").like("%7")).count()
    assert wrong == 0 and len(cascade.levels) > 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_and_clean_rows(spark, docs, none, sf_dir, name, stage):
    got = stage(spark, docs, sf_dir)
    if name != "packing":
        assert got.columns == docs.columns
    rows_out = got.collect()
    if name == "exact dedup":
        texts = [lower_az(r["text"]) for r in rows_out]
        assert len(texts) == len(set(texts)) == len({lower_az(t) for _, t in TEXTS})
        assert sum(r["doc_id"] == 13 for r in rows_out) == 1
    if name == "simhash near-dedup":
        assert len(rows_out) == len(linked_components([t for _, t in TEXTS]))
    if name == "mixing sources to target weights":
        taken = sum(len((r["text"] or "").split()) for r in rows_out)
        assert taken == sum(r["taken"] for r in mixing.weighted_fair_mix(docs).collect())
    assert stage(spark, none, sf_dir).count() == 0


def linked_components(texts):
    """Positions of ``texts`` in components of brute-force fingerprint links."""
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    left, components = set(range(len(texts))), []
    while left:
        reached, todo = set(), {min(left)}
        while todo:
            i = todo.pop()
            reached.add(i)
            todo |= {j for j in left - reached if bin(prints[i] ^ prints[j]).count("1") <= 3}
        components.append(reached)
        left -= reached
    return components


def test_near_dedup_keeps_one_row_of_each_linked_component(docs, spark):
    unlinked = ["Bread is baked in the early morning before the village wakes up.",
                "Rivers carry sand and stones from the mountains down to the sea.",
                "Der Zug nach Norden fährt heute wegen des Sturms nicht mehr ab.",
                "Une vieille horloge sonne encore chaque soir dans la tour de pierre."]
    more = [(None, t, "en", "a", len(t), *"sssss") for t in unlinked] + [(12, unlinked[0] + " So it goes.", "en", "a", 1, *"sssss")]
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    every = [(r["doc_id"], r["text"]) for r in table.collect()]
    components = linked_components([t for _, t in every])
    rows_of = [(d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), d) for d, t in every]
    firsts = [min(rows_of[i][:3] + (i,) for i in c)[3] for c in components]
    want = Counter((every[i][0], rows_of[i][2]) for i in firsts)
    got = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in simhash.stay(table).collect())
    assert got == want and sum(d is None for d, _ in got) >= 5 and sum(d == 12 for d, _ in got) >= 2


def test_toxicity_learns_terms_of_a_rare_language(spark):
    import pyspark.sql.functions as F
    # 3 of 243 toxic examples are in a language of their own
    docs = spark.range(600).selectExpr("id AS doc_id", """CASE
        WHEN id IN (2, 12, 22, 32) THEN concat('tyhmä ilkeä roisto valehtelija ', id)
        WHEN id % 5 < 2 THEN concat('you awful dreadful person number ', id)
        ELSE concat('a kind remark about the weather number ', id) END AS text""", "IF(id IN (2, 12, 22, 32), 'fi', 'en') AS lang")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 5 < 2 OR lang = 'fi' AS INT) AS y")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels, F.col("doc_id") != 32).collect()}
    assert got[32]["predicted"] == 1 and {e["doc_id"] for e in got[32]["evidence"]} == {2, 12, 22}
    counts = {(1, 3): 5000, (1, 9): 5000, (1, 0): 7, (0, 3): 3}
    assert toxicity._quotas(counts) == {(1, 0): 7, (1, 3): 496, (1, 9): 497, (0, 3): 3}


def test_toxicity_collects_one_bounded_text_an_id(spark, monkeypatch):
    import pyspark.sql.functions as F
    docs = spark.range(9000).selectExpr(
        "IF(id % 3 = 0, 7L, id) AS doc_id", "IF(id = 1, repeat('longer than any example ', 5000), concat('idiot words ', id, ' and ', id * 7)) AS text",
        "concat('l', id % 60) AS lang")
    labels = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 5 = 0 OR id = 7 AS INT) AS y")
    collected, collect = [], type(docs).collect

    def counting(self):
        rows = collect(self)
        collected.append((len(rows), sum(len(str(r)) for r in rows)))
        return rows

    monkeypatch.setattr(type(docs), "collect", counting)
    examples, stands_for, _ = toxicity.train(docs, labels, F.lit(True))
    assert len(collected) == 4 and all(n <= 2.4 * toxicity.EXAMPLES + 100 * toxicity.STRATA for n, _ in collected)
    ids = [e[0] for e in examples]
    assert len(ids) == len(set(ids)) <= 2 * toxicity.EXAMPLES and 1 not in ids and len(stands_for) == len(ids)
    assert collected[-1][0] == len(ids)


def test_toxicity_index_travels_without_its_lists():
    import pickle

    import numpy as np
    rng = np.random.default_rng(6)
    vectors = [(np.sort(rng.choice(5000, 50, replace=False)), rng.uniform(0, 0.2, 50)) for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, np.ones(len(np.unique(np.concatenate([t for t, _ in vectors])))))
    packed = pickle.dumps(index)
    assert len(packed) < 2 * sum(t.nbytes + w.nbytes for t, w in vectors)
    for terms, w in vectors[::50]:
        for a, b in zip(index.search(terms, w), pickle.loads(packed).search(terms, w)):
            assert np.array_equal(a, b)


def test_language_learns_from_one_text_an_id(spark, monkeypatch):
    import pyspark.sql.functions as F
    docs = spark.range(8000).selectExpr("IF(id % 3 = 0, 7L, id) AS doc_id", "concat('l', id % 200) AS lang",
                                        "IF(id = 1, repeat('long ', 20000), concat('words of ', id)) AS text")
    collected, examples, collect = [], [], type(docs).collect

    def counting(self):
        rows = collect(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", counting)
    monkeypatch.setattr(language, "train", examples.extend)
    language.learn(docs, F.lit(True))
    assert collected[0] == 200 and len(examples) == 8000 - 2667 - 1  # one for the id that many rows share; not the long one
    assert max(len(t) for _, t in examples) <= language.EXAMPLE_BYTES and len({lang for lang, _ in examples}) == 200
