"""Conversation repair, prefix trie and HTML extraction: against models of our
own, on the registered tables and on rows of every awkward kind."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as ent
from conftest import SF001
from oracle_check import compare, duck
from strata.llm import html_extract, prefix_trie, repair

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, seg long, path string, key string, label string"  # four names clash
LONG = "word after word, and so on. " * 20_000


def conversations():
    """conv_id, turn, role, text."""
    rows = [
        (None, 0, "user", "A conversation without a number."), (None, 1, "assistant", "It is one of its own."), (0, None, "system", "Rules."),
        (0, 0, "user", "Hello?"), (0, 1, "assistant", None), (0, 1, "assistant", "Two rows of one turn."), (0, 1, "assistant", "Two rows of one turn."),
        (1, 0, None, "No role here."), (1, 5, "", "An empty role."), (1, 6, "tool", "Another role"), (1, 7, "assistant", " \t\n"),
        (2, 0, "user", LONG), (2, 1, "assistant", LONG[:-3]), (3, None, "user", "Nothing known of the turn."), (3, None, "user", "Nor of this."),
        (4, 0, "assistant", "Begins with the answer!"), (4, 9, "user", "and ends open \n"), (-7, -3, "user", "Below zero."), (-7, 2**40, "assistant", "Far away."),
    ]
    rng = random.Random(5)
    for c in range(5, 60):  # long enough for several segments, copies of whole conversations among them
        source = random.Random(c // 3 if c % 2 else c)
        for t in range(rng.choice([0, 1, 2, 4, 9, 40])):
            rows.append((c, t, source.choice(["user", "assistant", "user", "assistant", "system"]), source.choice(
                ["One.", "Two!", "Three?", "four", "", "One.", f"{t} of them."])))
    rows += [(99, 4, "user", "The same row, over and over.")] * 300
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "k", "l") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, conversations())


# ---- repair --------------------------------------------------------------------------------

def damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 1:
            text = ""
        elif how == 2:
            text = re.sub("[.!?]", "", text)
        elif how == 4:
            role = "user"
        out[c] += [(t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def repaired(rows):
    """Best way to each state, row by row."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def better(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                new = 3 if state == 2 else 2
                better(ways, new, (cost + 3, audit + "I", (*lines, ("user:", "assistant:")[new - 2])))
        return ways

    ways = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in ways.items():
            better(after, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 if fault else 0
            new = 3 if state == 2 else 2
            better(after, new, (cost + 3, audit + "R", (*lines, ("user:", "assistant:")[new - 2] + text)))
            kept = {"s": 1, "u": 2, "a": 3}.get(role[:1])
            if kept == new or (kept == 1 and state == 0):
                better(after, kept, (cost, audit + "K", (*lines, f"{role}:{text}")))
        ways = inserted(after)
    cost, audit, lines = min(ways[s] for s in (0, 3) if s in ways)
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("bits", [repair.SEGMENT_BITS, 1])
def test_repair_against_dynamic_programming(spark, table, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(table)).collect()}
    want = {c: repaired(rows) for c, rows in damage(conversations()).items() if rows}
    assert got == want
    assert want[99][2] >= 299  # the repeated row, in one count


def test_repair_of_nothing(spark, table):
    assert repair.repair(repair.damaged(table.where("false"))).count() == 0
    only = [(c, t, "user", "Gone.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert only and repair.repair(repair.damaged(frame(spark, only))).count() == 0


def test_auction_by_segments_gives_the_whole_rows_result(monkeypatch):
    monkeypatch.setattr(repair, "BORDERS", 2)
    rng = random.Random(1)
    for _ in range(150):
        rows = [(*repair.CODES[rng.choice("suaoSUAOwxyzuauaua")], rng.choice([0, 0, 0, 2])) for _ in range(rng.randint(1, 15))]
        whole = repair.Segment(rows, repair.ACCEPT)
        labels, _ = whole.trace(repair.START)
        size = rng.choice([1, 2, 3])
        parts = [rows[i:i + size] for i in range(0, len(rows), size)]
        state, audit, cost = repair.START, "", 0
        for part, ends in zip(parts, repair.border_prices([repair.border_costs(p) for p in parts], repair.ACCEPT)):
            some, state = repair.Segment(part, tuple(ends)).trace(state)
            audit += repair.audit_of(part, some)
            cost += repair.edits_cost(part, some)
        assert (audit, cost) == (repair.audit_of(rows, labels), whole.price[repair.START])
        for i, arcs in enumerate(whole.arcs):  # prices are feasible duals
            assert all(whole.price[i] <= c + whole.price[j] for _, c, j in arcs)


# ---- prefix trie ---------------------------------------------------------------------------

def trie(paths):
    members, children, memo = defaultdict(list), defaultdict(set), {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        memo[node] = (saved + sum(memo[x][0] for x in children[node]), sum(memo[x][1] for x in children[node]) or 1)
    out = Counter()
    for node, m in members.items():
        ends = sorted(c for c in m if len(paths[c]) == len(node))
        out[min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), memo[node][1], memo[node][0],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()] += 1
    return out


def own_paths(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            pair = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            out[c].append(((t is not None, t or 0, role, pair), (role, text)))
    return {c: tuple(x for _, x in sorted(turns)) for c, turns in out.items()}


def headed(own):
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, ())[:h] + path[h:]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_prefix_sets(spark, table, monkeypatch, small):
    if small:  # many shards, several rounds of spines, chunks of few ids
        for name, value in (("SHARD_NODES", 8), ("SHARD_ITEMS", 3), ("LAST_ITEMS", 6), ("IDS", 2)):
            monkeypatch.setattr(prefix_trie, name, value)
    own = own_paths(conversations())
    plain = prefix_trie.paths(table)
    assert Counter(map(tuple, prefix_trie.trie_nodes(plain).collect())) == trie(own)
    assert Counter(map(tuple, prefix_trie.trie_nodes(prefix_trie.shared_heads(plain)).collect())) == trie(headed(own))
    assert () in headed(own).values()  # a rebuilt conversation without turns


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "hot" if c % 3 == 0 else f"text {c}") for c in range(600) for t in range(3)]
    table = frame(spark, rows)
    assert Counter(map(tuple, prefix_trie.trie_nodes(prefix_trie.paths(table)).collect())) == trie(own_paths(rows))
    assert prefix_trie.trie_nodes(prefix_trie.shared_heads(prefix_trie.paths(table.where("false")))).count() == 0
    one = prefix_trie.trie_nodes(prefix_trie.paths(table.where("conv_id = 1 AND turn = 0"))).collect()
    assert [tuple(r)[:7] for r in sorted(one, key=lambda r: r["depth"])] == [(1, 0, None, 1, 1, 1, 0), (1, 1, 1, 1, 0, 1, 0)]


def test_findclose_on_random_tries():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 50, 700, 3000]:
        depth = [0]
        while len(depth) < n:
            depth.append(int(rng.integers(1, depth[-1] + 2)) if rng.random() < 0.5 else depth[-1] + 1)
        bp = prefix_trie.Parentheses(np.array(depth))
        close, stack, want = bp.findclose(), [], {}
        for i, is_open in enumerate(bp.is_open):
            if is_open:
                stack.append(i)
            else:
                want[stack.pop()] = i
        assert [want[o] for o in bp.open] == close.tolist() and not stack


# ---- HTML ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages())


def main_text(model, page):
    blocks = html_extract.leaf_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def test_extraction_of_the_pages_table(spark):
    """The pages' article elements, their tags taken out by plain replacing."""
    got = {r["page_id"]: r for r in ent.queries()["op12_html_extraction"](spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", article))).split())
        row = got[r["page_id"]]
        assert (row["url"], row["text"], row["n_chars"]) == (r["url"], want, len(want))


def test_field_on_pages_held_out(model):
    wrong = blocks = 0
    for page in html_extract.labelled_pages(200, seed=77):
        found = html_extract.leaf_blocks(page)
        marks = [int(any("data-main" in a for _, a in b.path)) for b in found]
        wrong += sum(a != b for a, b in zip(marks, model.decode(found)))
        blocks += len(found)
    assert wrong < 0.01 * blocks and blocks > 3000


def test_viterbi_and_sums_against_all_labelings():
    rng = np.random.default_rng(4)
    model = html_extract.FieldModel({}, rng.normal(size=(2, 2)))
    for n in range(1, 7):
        scores = rng.normal(size=n)
        blocks = [html_extract.Block(str(i), (), 0) for i in range(n)]
        model.emission = lambda b: scores[int(b.text)]
        total = {}
        for code in range(2 ** n):
            y = [code >> i & 1 for i in range(n)]
            total[tuple(y)] = sum(s for s, l in zip(scores, y) if l) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))
        assert tuple(model.decode(blocks)) == max(total, key=total.get)
        chance = np.exp(list(total.values()))
        chance /= chance.sum()
        emit = np.stack([np.zeros((1, n)), scores[None]], axis=2)
        got = html_extract._expected(emit, model.pairs, np.ones((1, n), bool), np.eye(n))
        want = [sum(p for y, p in zip(total, chance) if y[i]) for i in range(n)]
        want += [sum(p * sum(ab == (a, b) for ab in zip(y, y[1:])) for y, p in zip(total, chance)) for a in (0, 1) for b in (0, 1)]
        assert np.allclose(got, want)


def test_blocks_of_awkward_markup():
    def texts(page):
        return [b.text for b in html_extract.leaf_blocks(page)]

    assert texts("") == texts("<p>") == texts("<!-- a <p>b") == texts("<script>var a='</p>'; <b>") == []
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<b>b</b>c<br>d<p>e</div>f") == ["abc d", "ef"]
    assert texts("<P CLASS='x>y'>a</P>b < c<i>d") == ["a", "b < cd"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul>more</ul>out") == ["one", "two", "in", "more", "out"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<style>p{}</style>x<svg><text>no</text></svg>y<textarea><p>no</textarea>") == ["xy"]
    assert texts("<p>&amp;amp; &#65;&#x42; &eacute &nosuch; &a") == ["&amp; AB é &nosuch; &a"]
    assert texts("a&nbsp;\t\n b<!-- c -->d<?php e ?>f") == ["a bdf"]
    assert texts("<head><title>t</title><meta x><body><p>a") == ["a"]
    path = html_extract.leaf_blocks('<div id="main"><p><b>a<p>b')[1].path
    assert [t for t, _ in path] == ["div", "p"]


def test_layouts_of_other_kinds(model):
    story = "<h1>A title of some words</h1><p>It began, as these things do, on a morning. Nobody knew why.</p><p>Why?</p><p>It went on and on.</p>"
    want = "A title of some words It began, as these things do, on a morning. Nobody knew why. Why? It went on and on."
    around = ("<header><a href=/>Home</a></header><nav><a href=/a>News</a> <a href=/b>Sport</a></nav><div class='cookie-notice'><p>We use cookies, "
              "as all do. Do you agree?</p></div>{}<section id='comments'><h3>Comments</h3><div class='comment'><p>Well said, I liked it very much.</p></div>"
              "</section><aside class=sidebar><p>Also of interest to you, our readers.</p></aside><form class=search><p>Search for words</p></form>"
              "<footer><p>&copy; 2020 The paper. All rights reserved.</p></footer>")
    for container in ("<main>{}</main>", "<article>{}</article>", "<div class='article-body'>{}</div>", "<main><article>{}<div class='ad'>Buy this, it is good.</div></article></main>"):
        assert main_text(model, around.format(container.format(story))) == want


def test_extraction_edges(spark, model):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, None, "<p>", "x"), (3, "u", "<article><p>" + LONG + "</p></article>", "x"),
            (3, "u", "<article><p>" + LONG + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, model).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    assert {r["text"] for r in got if r["page_id"] in (None, 1, 2)} == {""}
    assert all(r["text"] == LONG.strip() and r["n_chars"] == len(LONG) - 1 for r in got if r["page_id"] == 3)
    assert html_extract.extract(pages.where("false"), model).count() == 0
    assert html_extract.train([]).decode(html_extract.leaf_blocks("<p>a<p>b")) in ([0, 0], [1, 1])


@pytest.mark.parametrize("key", ["op11_conversation_repair", "op13_prefix_trie"])
def test_against_sql(spark, key):
    assert compare(spark, duck(SF001), key, ent.queries()[key], ent.oracle_sql()[key], SF001)
