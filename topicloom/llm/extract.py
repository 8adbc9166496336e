"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is walked once; text between block-level boundaries is a leaf block, with the
elements it lies in. Scripts, styles and the like are no text. Blocks get features of
their ancestors (tags, words of class and id) and of their text (length, links, end
marks, place, neighbours), hashed into a table of weights. The field scores every block
as article or not and every pair of adjacent blocks; Viterbi finds the best sequence.

It is trained in numpy by the gradient of the likelihood (forward-backward) on labelled
pages: ``labelled_pages`` lays out invented articles in the usual page designs, with
menus, banners, adverts, forms, sidebars, notices, comments and footers around them.

Null and empty html gives an empty text. Broken markup (elements never closed, a tag or
reference cut off at the end, stray quotes in a tag) is read like browsers do: block
elements end open paragraphs, whatever is open ends with the page. Pages of any length are read whole.
Repeated rows are read alike; other columns play no part.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
PAGES, EPOCHS = 400, 12

# Elements whose start and end separate blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page, up to their end tag.
RAW_TAGS = frozenset("script style template noscript svg textarea title iframe".split())
# An element that is closed when one of the following starts.
CLOSED_BY = {"p": BLOCK_TAGS - {"button", "caption", "option", "summary", "legend", "body", "html", "head"},
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

# An attribute as browsers read it: a quote opens a value only right after the equals sign.
# Possessive, so that no other reading of a long tag is tried.
_ATTRIBUTE = (r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?>[ \t\n\f\r]*+=[ \t\n\f\r]*+"
              r"(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+")
_attribute = re.compile(_ATTRIBUTE)
_token = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    rf"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[ \t\n\f\r/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.DOTALL)
_name = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_hidden = re.compile(r"\shidden(?=[\s=]|$)|display\s*:\s*none", re.IGNORECASE)
_words = re.compile(r"[^\W_]+").findall


@dataclass
class Block:
    """Text of one leaf block and the elements around it, outermost first."""

    text: str
    path: tuple[tuple[str, str], ...]
    links: int = 0
    chars: int = 0


def _closes_itself(attrs: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    return attrs.rstrip().endswith("/") and _attribute.sub("x", attrs).rstrip().endswith("/")


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, character references decoded, white space single."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, at, skip = 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(t for t in stack if t[0] in BLOCK_TAGS or t[1]), linked, len(text)))
        parts.clear()
        linked = 0

    while at < len(page):
        found = _token.search(page, at)
        if found is None:
            text, at_next = page[at:], len(page)
        else:
            text, at_next = page[at : found.start()], found.end()
        if text and not skip:
            parts.append(text)
            if any(tag == "a" for tag, _ in stack[-4:]):
                linked += len(text)
        at = at_next
        tag = found and found["tag"] and found["tag"].lower()
        if not tag:
            continue
        if found["end"]:
            if tag in BLOCK_TAGS:
                flush()
            if any(open_tag == tag for open_tag, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            closers = [k for k, (open_tag, _) in enumerate(stack) if tag in CLOSED_BY.get(open_tag, ())]
            if closers and not any(t in ("table", "ul", "ol", "dl", "article", "section", "div", "aside")
                                   for t, _ in stack[closers[-1] + 1 :]):
                del stack[closers[-1] :]
        if tag == "br":
            parts.append(" ")
        if tag not in VOID_TAGS and not _closes_itself(found["attrs"]):
            names = " ".join(next(filter(None, m), "") for m in _name.findall(found["attrs"])).lower()
            stack.append((tag, names + (" hidden" if _hidden.search(found["attrs"]) else "")))
    flush()
    return out


def _signs(blocks: list[Block], at: int) -> Iterator[str]:
    block = blocks[at]
    tags = [tag for tag, _ in block.path if tag not in ("html", "body")]
    yield "bias"
    for tag in set(tags):
        yield f"in:{tag}"
    yield f"leaf:{tags[-1] if tags else 'body'}"
    for tag, names in block.path:
        for word in _words(names):
            yield f"name:{word}"
            yield f"name:{tag}:{word}"
    size = len(block.text)
    yield f"size:{min(size.bit_length(), 10)}"
    yield f"links:{4 * block.links // max(block.chars, 1)}"
    yield f"ends:{block.text[-1] if block.text[-1] in '.!?:;' else '-'}"
    yield f"heading:{bool(tags) and tags[-1] in ('h1', 'h2', 'h3')}"
    first = block.text.lower()
    if first[:1] in "©":
        yield "copyright"
    for word in _words(first)[:3] if size < 90 else ():
        yield f"starts:{word}"


def block_features(blocks: list[Block]) -> list[np.ndarray]:
    """Hashed features of every block: its own and, marked, its neighbours' leaf and size."""
    own = [list(_signs(blocks, k)) for k in range(len(blocks))]
    out = []
    for k, signs in enumerate(own):
        near = [f"{side}{s}" for side, j in (("<", k - 1), (">", k + 1))
                for s in (own[j] if 0 <= j < len(own) else ["none"]) if s.startswith(("leaf:", "size:", "none", "in:"))]
        out.append(np.unique([zlib.crc32(s.encode()) % BUCKETS for s in signs + near]))
    return out


@dataclass
class Field:
    """Weights of the two labels: 0 surroundings, 1 article."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def node_scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for f in features]).reshape(-1, 2)

    def decode(self, features: list[np.ndarray]) -> np.ndarray:
        """The most probable labels, by Viterbi; ties go to label 0."""
        scores = self.node_scores(features)
        if not len(scores):
            return np.empty(0, np.int64)
        best, back = scores[0], []
        for score in scores[1:]:
            ways = best[:, None] + self.pairs
            back.append(ways.argmax(0))
            best = ways.max(0) + score
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return np.array(labels[::-1])

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels and expected pairs, by forward-backward in logarithms."""
        n = len(scores)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for k in range(1, n):
            ahead[k] = np.logaddexp.reduce(ahead[k - 1][:, None] + self.pairs, axis=0) + scores[k]
        for k in range(n - 2, -1, -1):
            behind[k] = np.logaddexp.reduce(self.pairs + scores[k + 1] + behind[k + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        joint = ahead[:-1, :, None] + self.pairs + (scores[1:] + behind[1:])[:, None] - total
        return np.exp(ahead + behind - total), np.exp(joint).sum(0)


def train(pages: list[tuple[list[Block], list[int]]], *, epochs: int = EPOCHS, rate: float = 0.2,
          decay: float = 1e-4) -> Field:
    """Stochastic gradient ascent on the likelihood of labelled pages."""
    crf = Field()
    data = [(block_features(blocks), np.array(labels)) for blocks, labels in pages if blocks]
    rng = np.random.default_rng(3)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in rng.permutation(len(data)):
            features, labels = data[k]
            chance, joint = crf.marginals(crf.node_scores(features))
            gold = np.eye(2)[labels]
            for f, g in zip(features, gold - chance, strict=True):
                crf.weights[f] += step * g
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            crf.pairs += step * (seen - joint)
        crf.weights *= 1 - decay
    return crf


# --- labelled pages -----------------------------------------------------------------

_SYLLABLES = "an ber ca del en for gra hin is jo ka lor mi nu os per qua ri sto ter un ve wil xa yor zen".split()
_MENU = "Home News About Contact Shop Login Help Blog Archive Search Team Prices".split()
_ARTICLE = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry-content"),
            ("div", "article-text"), ("article", "post"), ("div", "story")]
_AROUND = [("nav", ""), ("div", "menu"), ("header", ""), ("div", "site-header"), ("aside", ""), ("div", "sidebar"),
           ("div", "ad"), ("div", "advert banner"), ("div", "promo sponsored"), ("div", "cookie-notice"),
           ("div", "notice alert"), ("form", ""), ("form", "newsletter signup"), ("div", "comments"),
           ("section", "comment-list"), ("div", "related"), ("div", "share social"), ("footer", ""),
           ("div", "footer"), ("div", "breadcrumbs")]
_INSIDE = [("div", "ad"), ("aside", ""), ("div", "comments"), ("form", "subscribe"), ("nav", "toc"),
           ("div", "share"), ("section", "comments"), ("div", "notice"), ("footer", ""), ("header", "meta")]


class _Writer:
    """Writes a page and notes which leaf blocks are article."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def sentence(self, low: int, high: int) -> str:
        rng = self.rng
        words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
                 for _ in range(rng.randint(low, high))]
        if rng.random() < 0.2:  # lists, tables and noise have other marks, or none
            mark = rng.choice(["", " |", "***", "&amp;&amp;", "!!", "%", ","])
            return mark.join([" ".join(words[:3]), " ".join(words[3:])]) + mark
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def leaf(self, tag: str, text: str, label: int) -> None:
        self.html.append(f"<{tag}>{text}" + ("" if tag == "p" and self.rng.random() < 0.2 else f"</{tag}>"))
        self.labels.append(label)

    def element(self, kind: tuple[str, str], fill) -> None:
        tag, name = kind
        self.html.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
        fill(kind)
        self.html.append(f"</{tag}>")

    def around(self, kind: tuple[str, str]) -> None:
        rng, name = self.rng, " ".join(kind)
        if "comment" in name:
            for _ in range(rng.randint(1, 4)):
                self.leaf(rng.choice(["p", "div", "li"]), self.sentence(5, 40), 0)
        elif any(w in name for w in ("nav", "menu", "breadcrumbs", "share", "related", "toc")) or rng.random() < 0.2:
            self.html.append("<ul>")
            for _ in range(rng.randint(2, 7)):
                word = rng.choice([rng.choice(_MENU), self.sentence(1, 3)[:-1]])
                self.leaf("li", f'<a href="/{word}">{word}</a>', 0)
            self.html.append("</ul>")
        elif "form" in name:
            self.leaf("p", self.sentence(2, 8) + ' <input name="q">', 0)
            self.leaf("button", rng.choice(["Send", "Sign up", "Search"]), 0)
        elif "footer" in name:
            self.leaf("p", "&copy; " + self.sentence(2, 25), 0)
        else:
            for _ in range(rng.randint(1, 2)):
                self.leaf(rng.choice(["p", "div"]), self.sentence(3, 30), 0)

    def article(self, kind: tuple[str, str]) -> None:
        rng = self.rng
        if rng.random() < 0.8:
            self.leaf("h1", self.sentence(1, 9)[:-1], 1)
        for _ in range(rng.randint(1, 9)):
            chance = rng.random()
            if chance < 0.68:
                text = self.sentence(1, 14) if rng.random() < 0.3 else " ".join(
                    self.sentence(3, 16) for _ in range(rng.randint(1, 5)))
                if rng.random() < 0.3:
                    text = rng.choice(["<b>{}</b>", "{} <a href='/x'>" + self.sentence(1, 3) + "</a>", "{}<br>"]).format(text)
                self.leaf("p", text, 1)
            elif chance < 0.76:
                self.leaf(rng.choice(["h2", "h3"]), self.sentence(1, 7)[:-1], 1)
            elif chance < 0.84:
                self.html.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.leaf("li", self.sentence(1, 15), 1)
                self.html.append("</ul>")
            elif chance < 0.9:
                self.leaf(rng.choice(["blockquote", "pre"]), self.sentence(3, 20), 1)
            else:
                self.element(rng.choice(_INSIDE), self.around)


def labelled_pages(count: int = PAGES, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Pages in the usual designs with a label for each leaf block."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        page = _Writer(rng)
        page.html.append("<!DOCTYPE html><html><head><title>t</title><script>x</script></head><body>")
        before, after = rng.randint(0, 4), rng.randint(0, 4)
        for _ in range(before):
            page.element(rng.choice(_AROUND), page.around)
        page.element(rng.choice(_ARTICLE), page.article)
        for _ in range(after):
            page.element(rng.choice(_AROUND), page.around)
        page.html.append("</body></html>" if rng.random() < 0.8 else "")
        blocks = leaf_blocks("".join(page.html))
        if len(blocks) == len(page.labels):
            out.append((blocks, page.labels))
    return out


def main_text(page: str | None, crf: Field) -> str:
    blocks = leaf_blocks(page)
    labels = crf.decode(block_features(blocks))
    return "\n\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def main_texts(html_col: Column, crf: Field) -> Column:
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page, crf) for page in batch.to_pylist()], pa.string())

    return F.arrow_udf(extract, "string").asNondeterministic()(html_col)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              crf: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    crf = crf or train(labelled_pages())
    texts = pages.select(F.col(id_col), F.col(url_col), main_texts(F.col(html_col), crf).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
