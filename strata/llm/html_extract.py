"""Main text of web pages by a linear-chain conditional random field.

A page is read as the sequence of its leaf blocks: runs of text between the
tags that start or end a block.  A block's features are the tags, class, id and
role words of its ancestors, and its own text's size, links and marks.  The
field labels all blocks of a page together: a weight a feature, one a pair of
neighbouring labels, trained on labelled pages by maximum likelihood (forward
and backward sums over all pages at once), decoded by Viterbi.

``labelled_pages`` makes the training pages by rule: layouts with main text in
containers of many kinds, or in none, among menus, headers, adverts, notices,
forms, sidebars, comments and footers; any other pages whose main elements
carry ``data-main`` may be given instead.

Scripts, styles, the head and the like are no text.  Character references are
decoded, white space becomes one space, ``br`` counts as one; blocks are joined
by one space.  Tags left open are closed as browsers do it, and a page may end
anywhere.  A null html is empty, and an empty page has an empty text; repeated
rows are rows of their own; a null page_id or url stays.  Whole pages are read,
one at a time.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import for_workers, table

TRAINING_PAGES = 400
SEED = 12
ROUNDS, STEP, RIDGE = 200, 0.3, 0.02  # of the training

# Kinds of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("canvas head iframe math noscript object script select style svg template textarea title".split())
# An element that a new one of some kinds closes, and what stops the search for it.
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("article aside body button dl fieldset footer form header html main menu nav ol section table td th ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple  # (tag, attributes) of its ancestors, outermost first
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append(Block(text, tuple(stack), linked))
        pieces.clear()
        linked = 0

    def close(names: set, scopes: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        start = token.start() if token else end
        if start > at:
            piece = html.unescape(page[at:start])
            pieces.append(piece)
            if any(name == "a" for name, _ in stack):
                linked += len(piece)
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            opened = any(name == n for n, _ in stack)
            if name in BLOCKS and (opened or name == "p"):  # other ends of nothing are passed over
                flush()
            if opened:
                close({name}, frozenset())
            continue
        if name in SILENT:
            ended = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if name == "head" and not ended:  # a head left open ends where the body begins
                ended = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
            if not token[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                at = ended.end() if ended else end
            continue
        if name in BLOCKS:
            flush()
            close({"p"}, SCOPES)
            if name in CLOSED_BY:
                close(CLOSED_BY[name], SCOPES - {"td", "th"} if name == "tr" else SCOPES)
        elif name == "br":
            pieces.append(" ")
        if name not in VOID:
            stack.append((name, token[3].strip()))
    flush()
    return blocks


# ---- features ------------------------------------------------------------------------------

def path_features(path: tuple) -> list[str]:
    """Ancestors' tags and the words of their class, id and role, and the nearest block tag."""
    found = {f"in {name}" for name, _ in path if name != "data"}  # labelled pages mark their main text by it
    for name, attributes in path:
        if attributes:
            for key, *value in _ATTRIBUTE.findall(attributes):
                if key.lower() != "data-main":
                    found |= {f"named {w.lower()}" for w in _NAME_WORD.findall("".join(value))}
    for name, _ in reversed(path):
        if name in BLOCKS:
            found.add(f"tag {name}")
            break
    return sorted(found)


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    size = next((n for n in (1, 3, 8, 20, 50) if words <= n), "many")
    link = block.linked / len(text)
    out = [f"words {size}", f"links {'all' if link > 0.8 else 'some' if link > 0.2 else 'none'}",
           "ends" if text[-1] in ".!?\"'”»" else "open"]
    if "," in text:
        out.append("comma")
    if text[0] in "©®" or "©" in text:
        out.append("copyright")
    return out


@dataclass
class FieldModel:
    """Weights for the label main (the other label's are 0) and of label pairs."""

    weights: dict[str, float]
    pairs: np.ndarray  # [before, after]
    bias: float = 0.0
    known: dict[tuple, float] = field(default_factory=dict)  # scores of paths seen

    def emission(self, block: Block) -> float:
        score = self.known.get(block.path)
        if score is None:
            if len(self.known) > 20_000:
                self.known.clear()
            score = self.known[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return score + self.bias + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The labels of greatest joint score (Viterbi); the label other wins ties."""
        (oo, om), (mo, mm) = self.pairs.tolist()
        other, main, came = 0.0, 0.0, []
        for i, block in enumerate(blocks):
            e = self.emission(block)
            if not i:
                other, main = 0.0, e
                continue
            came.append((main + mo > other + oo, main + mm > other + om))
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + e
        labels = [int(main > other)] if blocks else []
        for step in reversed(came):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


# ---- training ------------------------------------------------------------------------------

def train(pages: Iterable[str]) -> FieldModel:
    """From pages whose main elements carry ``data-main``."""
    data = [leaf_blocks(p) for p in pages]
    data = [blocks for blocks in data if blocks]
    marks = [[int(any("data-main" in a for _, a in b.path)) for b in blocks] for blocks in data]
    feats = [[path_features(b.path) + text_features(b) for b in blocks] for blocks in data]
    names = sorted({f for page in feats for b in page for f in b})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(data), max(map(len, data), default=0)
    x = np.zeros((n, longest, len(names) + 1))
    y = np.zeros((n, longest), int)
    real = np.zeros((n, longest), bool)
    for i, page in enumerate(feats):
        for t, b in enumerate(page):
            x[i, t, [number[f] for f in b]] = 1
            x[i, t, -1] = 1
            y[i, t], real[i, t] = marks[i][t], True
    theta = np.zeros(len(names) + 1 + 4)
    size, last = np.full(len(theta), STEP), np.zeros(len(theta))
    flat = x.reshape(-1, x.shape[2])
    counts = np.append(flat.T @ (y * real).ravel(), [
        np.sum(real[:, 1:] & (y[:, :-1] == a) & (y[:, 1:] == b)) for a in (0, 1) for b in (0, 1)])
    for _ in range(ROUNDS if n else 0):
        emit = np.stack([np.zeros((n, longest)), (flat @ theta[:-4]).reshape(n, longest)], axis=2)
        gradient = counts - _expected(emit, theta[-4:].reshape(2, 2), real, flat) - RIDGE * theta
        same = np.sign(gradient) * np.sign(last)  # resilient steps: by sign, longer while it stays
        size = np.clip(size * np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0)), 1e-5, 1.0)
        last = np.where(same < 0, 0.0, gradient)
        theta += np.sign(last) * size
    return FieldModel(dict(zip(names, theta.tolist())), theta[-4:].reshape(2, 2), float(theta[len(names)]))


def _expected(emit: np.ndarray, pairs: np.ndarray, real: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Expected feature and pair counts under the field (all pages at once)."""
    n, longest, _ = emit.shape
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(ahead[:, t - 1, :1] + pairs[0], ahead[:, t - 1, 1:] + pairs[1]) + emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        after = emit[:, t + 1] + back[:, t + 1]
        step = np.logaddexp(pairs[:, 0] + after[:, :1], pairs[:, 1] + after[:, 1:])
        back[:, t] = np.where(real[:, t + 1, None], step, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    main = np.exp(ahead[..., 1] + back[..., 1] - total[:, None]) * real
    both = np.exp(ahead[:, :-1, :, None] + pairs + (emit + back)[:, 1:, None, :] - total[:, None, None, None])
    return np.append(flat.T @ main.ravel(), (both * real[:, 1:, None, None]).sum(axis=(0, 1)).ravel())


# Names that layouts give to containers of each kind.
_MAIN = ['article', 'main', 'div class="post-content"', 'div id="content"', 'section class="entry-content"', 'div class="article-body"',
         'div class="story"', 'div itemprop="articleBody" class="text"', 'section id="main"', 'div role="main"']
_ASIDES = {
    "menu": ['nav', 'div class="menu"', 'div id="navigation"', 'ul class="nav-links"', 'div class="breadcrumbs"', 'div role="navigation"',
             'div class="pagination"', 'div class="related-links"', 'div class="tags"', 'div class="toc"'],
    "header": ['header', 'div class="site-header"', 'div id="header"', 'div class="masthead"', 'div class="topbar"', 'div role="banner"'],
    "footer": ['footer', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"'],
    "sidebar": ['aside', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'div role="complementary"'],
    "notice": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="newsletter"', 'div class="popup"',
               'div class="consent"', 'div class="alert"', 'div class="banner"', 'div role="dialog"', 'div class="paywall"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div id="ad-top"', 'ins class="adsbygoogle"', 'div class="advert"', 'div class="sponsored"',
               'div class="promo"', 'aside class="advertisement"', 'section class="promotion"'],
    "form": ['form', 'form class="search"', 'div class="form"', 'form id="subscribe"', 'form class="login"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="replies"',
                 'section id="discussion"', 'div class="user-comment"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="share-buttons"'],
}


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages made by rule, their main elements marked ``data-main``."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(["an", "be", "co", "du", "e", "fi", "go", "ha", "in", "le", "mo", "ou", "re", "sta", "ti"]) for _ in range(rng.randint(1, 4)))

    def sentence(least: int, most: int) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(least, most))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence(1, 14) for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))

    def wrap(kind: str, inner: str) -> str:
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{rng.choice([word(), sentence(1, 4)])}</a></li>' for _ in range(k))

    def aside(kind: str) -> str:
        name = rng.choice(_ASIDES[kind])
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>" if rng.random() < 0.8 else " | ".join(f'<a href="#">{word()}</a>' for _ in range(4))
        elif kind == "header":
            inner = rng.choice([f"<h1>{sentence(1, 4)}</h1>", f"<h2>{word()}</h2><p>{sentence(2, 6)}</p>", f'<a href="/">{word()}</a>'])
        elif kind == "footer":
            inner = rng.choice([f"&copy; {word()}.example &middot; {prose()}", f"<p>&copy; 2020 {word()}</p>", prose(), f"<ul>{links(3)}</ul>"])
        elif kind == "sidebar":
            inner = f"<h3>{sentence(1, 3)}</h3>" + rng.choice([f"<ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<div>{prose()}</div>"])
        elif kind == "form":
            inner = f"<label>{sentence(1, 4)}</label><input name=q><p>{sentence(2, 8)}</p><button>{word()}</button>"
        elif kind == "comments":
            one = [f"<p>{prose()}</p>", f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f"<article><h4>{word()}</h4><p>{prose()}</p></article>"]
            inner = f"<h3>{sentence(1, 3)}</h3>" + "".join(rng.choice(one) for _ in range(rng.randint(1, 5)))
        elif kind == "share":
            inner = links(3)
        else:
            inner = rng.choice([prose(), f"<p>{prose()}</p>", f"{sentence(2, 9)} <a href='#'>{word()}</a>"])
        return wrap(name, inner)

    def body(marked: bool) -> str:
        mark = "" if marked else " data-main"
        parts = [f"<{h}{mark}>{sentence(1, 10)}</{h}>" for h in rng.choice([["h1"], ["h1"], ["h1", "h2"], []])]
        if parts and rng.random() < 0.1:
            parts = [f"<header>{p}</header>" for p in parts]
        for _ in range(rng.randint(1, 12)):
            kind, inner = rng.random(), prose()
            if kind < 0.7:
                parts.append(f"<p{mark}>" + rng.choice([inner, f"<b>{inner}</b>", f"<b>{inner}<br>", f"<i>{word()}</i> {inner} <a href='/x'>{word()}</a> {prose()}"])
                             + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.76:
                h = rng.choice(["h2", "h2", "h3", "h4"])
                parts.append(f"<{h}{mark}>{sentence(1, 6)}</{h}>")
            elif kind < 0.8:
                h = rng.choice(["ul", "ol"])
                parts.append(f"<{h}{mark}>" + "".join(f"<li>{sentence(1, 9)}</li>" for _ in range(rng.randint(1, 5))) + f"</{h}>")
            elif kind < 0.82:
                parts.append(rng.choice([f"<figure{mark}><img src=x><figcaption>{inner}</figcaption></figure>",
                                         f"<dl{mark}><dt>{word()}<dd>{inner}</dl>", f"<section{mark}>{inner}</section>"]))
            elif kind < 0.86:
                parts.append(f"<blockquote{mark}><p>{inner}</p></blockquote>")
            elif kind < 0.9:
                parts.append(f"<table{mark}><tr><td>{word()}</td><td>{word()}</td></tr></table>")
            elif kind < 0.92:
                parts.append(f"<pre{mark}>{inner}</pre>")
            elif kind < 0.96:  # text that is in no element of its own
                parts.append(f"<data data-main>{inner}</data>")
            else:
                parts.append(f"<div{mark}>{inner}</div>")
        if marked and rng.random() < 0.4:  # something in the container that isn't main text
            place = rng.randint(1, len(parts)) if parts else 0
            parts[place:place] = ["</data>" + aside(rng.choice(["advert", "share", "menu", "sidebar", "comments", "form", "notice", "footer"])) + "<data data-main>"]
        return "".join(parts)

    pages = []
    for _ in range(n):
        before = [aside(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "sidebar", "share"], rng.randint(1, 5))]
        after = [aside(k) for k in rng.sample(["menu", "sidebar", "advert", "comments", "share", "form", "notice"], rng.randint(0, 4))]
        after += [aside("footer")] if rng.random() < 0.9 else []
        if rng.random() < 0.85:
            name = rng.choice(_MAIN[:2] * 3 + _MAIN)
            middle = wrap(name, f"<data data-main>{body(True)}</data>")
        else:
            middle = body(False)
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(["container", "wrapper", "row", "page", "layout"])}">{middle}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>")
    return pages


# ---- the operator --------------------------------------------------------------------------

def extract(pages: DataFrame, model: FieldModel) -> DataFrame:
    """One row a page: page_id, url, text (main text), n_chars, n_blocks, n_main."""
    types = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64(), "n_blocks": pa.int64(), "n_main": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"text": [], "n_chars": [], "n_blocks": [], "n_main": []}
            for page in batch.column("html"):
                blocks = leaf_blocks(page.as_py() or "")
                main = [b.text for b, label in zip(blocks, model.decode(blocks)) if label]
                text = " ".join(main)
                for column, value in zip(out.values(), (text, len(text), len(blocks), len(main))):
                    column.append(value)
            columns = [batch.column("page_id"), batch.column("url"), *[pa.array(v, types[c]) for c, v in out.items()]]
            yield pa.RecordBatch.from_arrays(columns, list(types))

    rows = for_workers(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                     F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train(labelled_pages()))
