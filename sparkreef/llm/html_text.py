"""Main text of web pages: a recurrent network labels every block of a page in the context of all others.

A page's blocks go as one sequence through a bidirectional LSTM written in numpy. A block's input is the
bag of tags and names on its path of elements, the bag of its hashed words, and what it measures (length,
share of links, punctuation, place). The blocks that the network takes for the article are the text.

No table labels blocks. So the network learns from pages that are put together from parts whose kind
is known (menus, notices, adverts, comments, articles and so on, under many names and nestings), with
text from a sample of the table's own pages, and from the sample itself where a page has exactly one
article element. The sample is bounded: the SAMPLE pages with the least hashes, none over MOST_CHARS.
Extraction covers every page as a whole, and all of a block's words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkreef.llm.blocks import PATH, Block, Reader

SAMPLE = 200
MOST_CHARS = 100_000
MADE_PAGES = 2600
EPOCHS = 10
SEED = 17

WORDS = 64
MEASURES = 16
INPUT, DENSE, HIDDEN = PATH + WORDS + MEASURES, 24, 16

#: Blocks whose vectors stand in memory at once, and steps a batch of pages takes together.
MOST_ROWS = 20_000
MOST_STEPS = 60_000


# Vectors


def word_bags(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for the hashed words of each text, and of the log of how often where oftener."""
    out = np.zeros((len(texts), WORDS), np.float32)
    rows, words = [], []
    for i, text in enumerate(texts):
        found = text.lower().split(" ")
        rows.append(np.full(len(found), i))
        words.append(pa.array(found, pa.string()))
    if texts:
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        bucket = np.array([hash_word(w) for w in kinds])
        cells = np.concatenate(rows) * WORDS + bucket[coded.indices.to_numpy()]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    return np.log1p(out) / 3


def hash_word(word: str) -> int:
    return zlib.crc32(word.strip(".,;:!?()[]\"'").encode()) % WORDS


def measures(blocks: list[Block]) -> np.ndarray:
    """What a block measures, all between 0 and about 1."""
    out = np.zeros((len(blocks), MEASURES), np.float32)
    last = max(len(blocks) - 1, 1)
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        ends = sum(b.text.count(c) for c in ".!?")
        out[i] = (
            np.log1p(n) / 8, np.log1p(words) / 6, b.linked / n, b.linked > 0.8 * n, b.heading, min(ends / words * 4, 1), b.text[-1] in ".!?:",
            min(sum(map(b.text.count, "0123456789")) / n * 4, 1), "©" in b.text, "|" in b.text or "·" in b.text or "»" in b.text, i / last,
            min(i, 20) / 20, min(last - i, 20) / 20, min(b.depth, 16) / 16, b.text[0].islower(), words < 4,
        )
    return out


# The network


@dataclass
class Network:
    """Weights of the dense layer, of both directions' cells (stacked), and of the last layer."""

    dense: np.ndarray
    cell: np.ndarray
    again: np.ndarray
    bias: np.ndarray
    last: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.dense, self.cell, self.again, self.bias, self.last]


def fresh(rng: np.random.Generator) -> Network:
    norm = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
    bias = np.zeros((2, 1, 4 * HIDDEN))
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # a cell that remembers at first
    return Network(norm(INPUT + 1, DENSE) * 3, norm(2, DENSE, 4 * HIDDEN), norm(2, HIDDEN, 4 * HIDDEN), bias, norm(2 * HIDDEN + DENSE + 1, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _both(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(2, steps, pages, width): each page forwards, and backwards from its own last block."""
    steps = np.arange(x.shape[0])[:, None]
    back = np.where(steps < lengths, lengths - 1 - steps, steps)
    return np.stack([x, np.take_along_axis(x, back[:, :, None], 0)])


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The second direction of ``_both`` back in page order, and both side by side."""
    return np.concatenate([x[0], _both(x[1], lengths)[1]], -1)


def run(net: Network, dense: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Logits (steps, pages) from the dense layer's output; with ``keep``, what learning needs besides."""
    steps, pages, _ = dense.shape
    gates_in = _both(dense, lengths) @ net.cell[:, None] + net.bias[:, None]
    h, c = np.zeros((2, pages, HIDDEN)), np.zeros((2, pages, HIDDEN))
    hs, kept = np.empty((2, steps, pages, HIDDEN)), []
    for t in range(steps):
        gates = gates_in[:, t] + h @ net.again
        i, f, o = (_sigmoid(gates[..., k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[..., 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        hs[:, t] = h
        if keep:
            kept.append((i, f, o, g, before, tanh_c, h_before))
    top = np.concatenate([_turned(hs, lengths), dense, np.ones((steps, pages, 1))], -1)
    logits = (top @ net.last)[..., 0]
    return (logits, top, kept) if keep else logits


def gradients(net: Network, x: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of a padded batch: x (steps, pages, INPUT + 1), wanted (steps, pages) of 0 and 1."""
    dense = np.tanh(x @ net.dense)
    logits, top, kept = run(net, dense, lengths, keep=True)
    here = (np.arange(x.shape[0])[:, None] < lengths) / lengths.sum()
    p = _sigmoid(logits)
    loss = float(-(here * np.log(np.where(wanted > 0.5, p, 1 - p) + 1e-12)).sum())
    d_logit = (here * (p - wanted))[..., None]
    d_last = np.einsum("tpk,tpo->ko", top, d_logit)
    d_top = d_logit @ net.last.T
    d_hs = np.stack([d_top[..., :HIDDEN], _both(d_top[..., HIDDEN : 2 * HIDDEN], lengths)[1]])
    d_dense = d_top[..., 2 * HIDDEN : -1].copy()
    d_gates = np.empty((2, x.shape[0], x.shape[1], 4 * HIDDEN))
    d_h, d_c = np.zeros_like(d_hs[:, 0]), np.zeros_like(d_hs[:, 0])
    d_again = np.zeros_like(net.again)
    for t in range(x.shape[0] - 1, -1, -1):
        i, f, o, g, before, tanh_c, h_before = kept[t]
        d_h = d_h + d_hs[:, t]
        d_c = d_c + d_h * o * (1 - tanh_c**2)
        d = d_gates[:, t]
        d[..., :HIDDEN] = d_c * g * i * (1 - i)
        d[..., HIDDEN : 2 * HIDDEN] = d_c * before * f * (1 - f)
        d[..., 2 * HIDDEN : 3 * HIDDEN] = d_h * tanh_c * o * (1 - o)
        d[..., 3 * HIDDEN :] = d_c * i * (1 - g**2)
        d_again += h_before.swapaxes(1, 2) @ d
        d_h = d @ net.again.swapaxes(1, 2)
        d_c = d_c * f
    both = _both(dense, lengths)
    d_cell = np.einsum("dtpi,dtpo->dio", both, d_gates)
    d_in = d_gates @ net.cell[:, None].swapaxes(-1, -2)
    d_dense += d_in[0] + _both(d_in[1], lengths)[1]
    d_pre = d_dense * (1 - dense**2)
    grads = [np.einsum("tpi,tpo->io", x, d_pre, optimize=True), d_cell, d_again, d_gates.sum((1, 2))[:, None], d_last]
    return loss, grads


def batches_of(lengths: list[int]) -> Iterator[list[int]]:
    """Places of pages of like lengths, so many that padded steps stay bounded; a longer page goes alone."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    batch: list[int] = []
    for k in order:
        if batch and (len(batch) + 1) * lengths[k] > MOST_STEPS:
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def learn(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """A network for pages of (vectors, labels), by Adam over batches of 32 pages of like lengths."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
    groups = [order[i : i + 32] for i in range(0, len(order), 32)]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for g in rng.permutation(len(groups)):
            group = groups[g]
            lengths = np.array([len(pages[k][1]) for k in group])
            x = np.zeros((lengths.max(), len(group), INPUT + 1))
            wanted = np.zeros((lengths.max(), len(group)))
            for i, k in enumerate(group):
                vectors, labels = pages[k]
                # now and then a page's names mean nothing, so that context has to do
                x[: len(labels), i, :INPUT] = vectors * (rng.random(INPUT) > 0.05)
                x[: len(labels), i, INPUT] = 1
                wanted[: len(labels), i] = labels
            _, grads = gradients(net, x, lengths, wanted)
            step += 1
            for w, d, m, v in zip(weights, grads, first, second, strict=True):
                d = np.clip(d, -1, 1)
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def vectors(reader: Reader, blocks: list[Block]) -> np.ndarray:
    """The input of each block of a page; ``reader`` has read it last, or others since without clearing."""
    path = np.stack([reader.paths[b.path] for b in blocks])
    return np.concatenate([path, word_bags([b.text for b in blocks]), measures(blocks)], 1)


# Pages to learn from


#: What the parts of pages are called. Fixed values.
CALLED = {
    "header": "header site-header masthead top topbar banner page-header branding logo head",
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs toc subnav tabs pagination pager site-nav topnav links",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert message popup modal newsletter subscribe overlay paywall warning toast info-bar disclaimer",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot ad-container banner-ad commercial teaser-ad affiliate",
    "sidebar": "sidebar side aside widget widgets related related-posts rail right-column secondary recommended popular trending more-stories tags author-box",
    "share": "share social sharing share-buttons social-links follow tools",
    "form": "form search search-form login signup contact-form comment-form subscribe-form poll",
    "comments": "comments comment comment-list discussion replies responses reader-comments user-comments feedback disqus thread respond",
    "footer": "footer site-footer bottom copyright legal colophon page-footer imprint foot",
    "article": "article content post entry post-content entry-content article-body story text main-content body-text hentry single blog-post page-content main",
}
TAGGED = {
    "header": ["header", "div", "div"], "menu": ["nav", "nav", "div", "ul"], "notice": ["div", "section", "aside", "dialog", "p"], "advert": ["div", "div", "aside", "section", "p", "figure"],
    "sidebar": ["aside", "aside", "div", "section"], "share": ["div", "ul", "section"], "form": ["form"], "comments": ["section", "div", "div", "ol", "ul"],
    "footer": ["footer", "footer", "div"], "article": ["article", "article", "main", "div", "div", "section"],
}
SAYINGS = {
    "notice": "We use cookies to improve your experience.|By continuing you accept our privacy policy.|Subscribe to our newsletter today!|Your trial ends soon.|Accept all cookies|This site uses cookies, read more.|Sign up to read on.|Nous utilisons des cookies.|Diese Seite verwendet Cookies.|Usamos cookies.",
    "advert": "Advertisement|Sponsored|Buy one, get one free!|Best prices, only today.|Click here for a special offer.|Save 50% now|Anzeige|Publicité|Publicidad",
    "form": "Search|Your name|E-mail|Send|Log in|Password|Submit|Leave a reply|Message",
    "comments": "Reply|Leave a comment|3 comments|says:|Posted by|Great post!|I don't agree with this.|Thanks for sharing.|Comments|Report|2 hours ago",
    "footer": "© 2024 All rights reserved.|Privacy|Terms of use|Contact|Imprint|Powered by|Copyright|Impressum",
    "menu": "Home|About|News|Contact|Archive|Next|Previous|Sports|World|Login", "sidebar": "Related|Most read|Tags|Recent posts|You may also like|Popular|See also|Read more", "share": "Share|Tweet|Print|Follow us|E-mail this", "header": "Welcome|The daily site|Your source|Menu",
}
TITLES = "title headline entry-title post-title article-title heading".split()
NEUTRAL = "wrap wrapper container row col inner outer page block box section grid module layout region panel group item cell".split()


class Maker:
    """Makes pages of parts; what belongs to the article is known."""

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts
        self.words = [w for t in texts[:500] for w in t.split()[:50]] or ["word"]

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """HTML, and whether its parts belong to the article, by their order."""
        rng, self.plain = self.rng, self.rng.random() < 0.12
        self.out: list[str] = []
        self.kept: list[bool] = []
        some = lambda p, *kinds: [k for k in kinds if rng.random() < p]
        before = some(0.25, "notice", "advert") + some(0.6, "header", "menu") + some(0.2, "form", "share", "sidebar", "menu", "advert")
        after = some(0.3, "comments", "sidebar", "share", "advert", "form", "comments") + some(0.65, "footer") + some(0.15, "notice", "menu", "sidebar")
        if rng.random() < 0.5:
            rng.shuffle(before)
        self.say("<!DOCTYPE html><html><head><title>", "", "x</title><style>p{}</style></head><body>")
        self.wrapped(lambda: [self.part(k) for k in before] + [self.article()] + [self.part(k) for k in after], 0.4)
        self.say("</body></html>")
        return "".join(self.out), self.kept

    def say(self, *html: str) -> None:
        self.out += html

    def block(self, text: str, keep: bool = False) -> None:
        if text.strip():
            self.out.append(text.replace("&", "&amp;").replace("<", "&lt;"))
            self.kept.append(keep)

    def called(self, kind: str, tag: str) -> str:
        """The attributes of a part, which name it unless its tag does, or a page's names say nothing."""
        rng = self.rng
        told = tag in ("nav", "header", "footer", "aside", "article", "main", "form")
        if self.plain and kind in ("menu", "header", "footer", "sidebar", "article"):
            return "" if rng.random() < 0.5 else f' class="{self.nothing()}"'
        if told and rng.random() < 0.6:
            return "" if rng.random() < 0.6 else f' class="{self.nothing()}"'
        name = rng.choice(CALLED[kind].split())
        if rng.random() < 0.15:
            name = f"{rng.choice(CALLED[kind].split())}-{name}"
        if rng.random() < 0.1:
            name = name.title().replace("-", "")
        elif rng.random() < 0.15:
            name = name.replace("-", "_")
        extra = f" {self.nothing()}" if rng.random() < 0.3 else ""
        return f" {rng.choice(['class', 'class', 'class', 'id'])}={rng.choice(['{0}{1}{0}'.format(chr(34), name + extra), chr(39) + name + extra + chr(39)])}"

    def nothing(self) -> str:
        rng = self.rng
        return rng.choice(NEUTRAL) + (f"-{rng.randint(1, 12)}" if rng.random() < 0.4 else "") if rng.random() < 0.7 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def wrapped(self, inner, p: float) -> None:
        tags = []
        while self.rng.random() < p and len(tags) < 4:
            tags.append(self.rng.choice(["div", "div", "div", "section"]))
            self.say(f"<{tags[-1]}" + (f' class="{self.nothing()}"' if self.rng.random() < 0.7 else "") + ">")
        inner()
        for tag in reversed(tags):
            self.say(f"</{tag}>")

    def few(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def text(self) -> str:
        return self.rng.choice(self.texts) if self.texts else self.few(3, 80).capitalize() + "."

    def line(self, kind: str) -> str:
        known = SAYINGS.get(kind, "").split("|")
        return self.rng.choice(known) if known[0] and self.rng.random() < 0.5 else self.text() if self.rng.random() < 0.4 else self.few(1, 12)

    def links(self, n: int) -> None:
        rng = self.rng
        style = rng.choice(["li", "li", "li", "bare", "p"])
        self.say("<ul>" if style == "li" else "")
        bare = []
        for _ in range(n):
            text = self.line("menu") if rng.random() < 0.4 else self.few(1, 4)
            if style == "bare":
                bare.append(text)
                continue
            end = "</li>" if rng.random() < 0.8 else ""
            self.say("<li>" if style == "li" else "<p>", '<a href="/x">')
            self.block(text)
            self.say("</a>", end if style == "li" else "</p>")
        if bare:
            self.kept.append(False)
            self.say(rng.choice([" ", " | ", " · ", ""]).join(f"<a href=/y>{t.replace('<', '&lt;')}</a>" for t in bare))
        self.say("</ul>" if style == "li" else "")

    def lines(self, kind: str, n: int) -> None:
        for _ in range(n):
            tag = self.rng.choice(["p", "p", "div", "", "h3", "span"]) if n > 1 else self.rng.choice(["p", "", "div"])
            if tag in ("", "span") and n > 1:
                tag = "div"
            self.say(f"<{tag}>" if tag else "")
            self.block(self.line(kind))
            self.say(f"</{tag}>" if tag else "")

    def part(self, kind: str) -> None:
        rng = self.rng
        tag = rng.choice(TAGGED[kind])
        if self.plain and kind != "form":
            tag = "div"
        self.say(rng.choice(["", "", "\n", "<!-- x -->", "<script>var a='<p>';</script>"]), f"<{tag}{self.called(kind, tag)}>")
        if tag in ("p", "ul", "ol"):
            if tag == "p":
                self.block(self.line(kind))
            else:
                for _ in range(rng.randint(1, 6)):
                    self.say("<li>")
                    self.block(self.line(kind))
                    self.say("</li>")
        elif kind == "menu":
            self.links(rng.randint(2, 9))
        elif kind == "header":
            name = rng.choice(["h1", "div", "h2", "p"])
            self.say(f"<{name}>")
            self.block(self.few(1, 4))
            self.say(f"</{name}>")
            if rng.random() < 0.5:
                self.lines(kind, 1)
            if rng.random() < 0.4:
                self.part("menu")
        elif kind in ("notice", "advert", "share"):
            self.lines(kind, rng.choice([1, 1, 1, 2, 3]))
            if rng.random() < 0.3:
                self.say("<button>")
                self.block(rng.choice(["OK", "Accept", "Close", "X", "More"]))
                self.say("</button>")
        elif kind == "sidebar":
            for _ in range(rng.randint(1, 3)):
                self.say("<h3>")
                self.block(self.line(kind))
                self.say("</h3>")
                if rng.random() < 0.5:
                    self.links(rng.randint(1, 6))
                else:
                    self.lines(kind, rng.randint(1, 3))
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.say("<label>")
                self.block(self.line("form"))
                self.say("</label><input name=q>")
            if rng.random() < 0.3:
                self.lines("form", 1)
            self.say("<button>")
            self.block("Send")
            self.say("</button>")
        elif kind == "comments":
            if rng.random() < 0.6:
                self.say("<h2>")
                self.block(self.line(kind))
                self.say("</h2>")
            inner = rng.choice(["div", "div", "li", "article", "p", "section"])
            for _ in range(rng.randint(1, 6)):
                self.say(f"<{inner}" + (' class="comment"' if rng.random() < 0.5 else "") + ">")
                if inner == "p":
                    self.block(self.line(kind))
                else:
                    if rng.random() < 0.6:
                        self.say("<div>")
                        self.block(self.few(1, 3) + rng.choice([" says:", "", " 2 days ago"]))
                        self.say("</div>")
                    self.lines(kind, rng.randint(1, 2))
                self.say(f"</{inner}>")
            if rng.random() < 0.2:
                self.part("form")
        else:
            self.lines(kind, 1) if rng.random() < 0.7 else self.links(rng.randint(1, 5))
            if rng.random() < 0.3:
                self.lines(kind, rng.randint(1, 2))
        self.say(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        around = rng.random() < 0.35
        tag = "div" if self.plain else rng.choice(TAGGED["article"])
        if around:
            outer = "div" if self.plain else rng.choice(["main", "div", "section"])
            self.say(f"<{outer}{self.called('article', outer)}>")
            if rng.random() < 0.25:
                self.part(rng.choice(["menu", "notice", "advert", "share"]))
        self.say(f"<{tag}{self.called('article', tag)}>")
        if rng.random() < 0.85:
            h = rng.choice(["h1", "h1", "h1", "h1", "h2", "div", "p"])
            self.say(f"<{h}" + (f' class="{rng.choice(TITLES)}"' if rng.random() < 0.3 or h in ("div", "p") else "") + ">")
            self.block(self.few(1, 14) if rng.random() < 0.5 else self.text()[:60], True)
            self.say(f"</{h}>")
        n = rng.choice([1, 2, 3, 4, 6, 9, 14])
        for k in range(n):
            if k and rng.random() < 0.06:
                self.part(rng.choice(["advert", "advert", "share", "notice", "sidebar", "form"]))
            kind = rng.random()
            if kind < 0.72 or n < 3:
                self.say(rng.choice(["<p>", "<p>", "<p>", '<p class="x1">', "<div>", "<p><b>"]))
                self.block(self.text(), True)
                self.say("<br>" if self.out[-2] == "<p><b>" else "</div>" if self.out[-2] == "<div>" else rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.8:
                self.say("<h2>")
                self.block(self.few(1, 7), True)
                self.say("</h2>")
            elif kind < 0.88:
                self.say("<ul>")
                for _ in range(rng.randint(1, 5)):
                    self.say("<li>")
                    self.block(self.few(1, 20), True)
                self.say("</ul>")
            elif kind < 0.93:
                self.say("<blockquote><p>")
                self.block(self.text(), True)
                self.say("</p></blockquote>")
            elif kind < 0.97:
                self.say("<table>")
                for _ in range(rng.randint(1, 3)):
                    self.say("<tr>")
                    for _ in range(2):
                        self.say("<td>")
                        self.block(self.few(1, 4), True)
                    self.say("</tr>")
                self.say("</table>")
            else:
                self.say("<figure><img src=a><figcaption>")
                self.block(self.few(2, 12), True)
                self.say("</figcaption></figure>")
        if rng.random() < 0.12:
            self.part(rng.choice(["comments", "share", "sidebar", "form"]))
        self.say(f"</{tag}>")
        if around:
            if rng.random() < 0.3:
                self.part(rng.choice(["comments", "share", "sidebar", "advert", "form"]))
            self.say(f"</{outer}>")


#: Elements that part an article from what surrounds it, in pages of the sample. Fixed values.
BESIDE = re.compile(r"/(nav|header|footer|aside|form|dialog|noscript|button)\b")


def examples(sample: list[str], made: int = MADE_PAGES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of pages that are put together and of the sample's pages with one article element."""
    reader, rng = Reader(), random.Random(seed)
    pages, texts, own = [], [], []
    for html in sample:
        blocks, inside = reader.read(html)
        if not blocks:
            continue
        texts += [b.text for b in blocks if b.linked == 0 and len(b.text) < 3000]
        if len(re.findall(r"<article\b", html, re.I)) == 1:
            labels = np.array(["/article" in x and not BESIDE.search(x) for x in inside], float)
            own.append((vectors(reader, blocks), labels))
    maker = Maker(rng, texts)
    for _ in range(made):
        html, kept = maker.page()
        blocks, _ = reader.read(html)
        if len(blocks) == len(kept) > 0:
            pages.append((vectors(reader, blocks), np.array(kept, float)))
    return pages + own


def sampled(pages: DataFrame, most: int = SAMPLE) -> list[str]:
    """The html of the pages with the least hashes, at most ``most`` different ones, none over MOST_CHARS.

    The hashes are found first, so that tasks send the driver nothing but the pages it takes.
    """
    rows = pages.select("html", F.xxhash64("html").alias("h")).where(f"length(html) <= {MOST_CHARS}")
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]
    taken = rows.where(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.min("html").alias("html"))
    return [r.html for r in taken.orderBy("h").collect()]


def train(pages: DataFrame, most: int = SAMPLE, made: int = MADE_PAGES) -> Network:
    """A network for the blocks of ``pages`` (html), learnt on the driver from bounded examples."""
    return _trained(tuple(sampled(pages, most)), made)


@lru_cache(maxsize=4)
def _trained(sample: tuple[str, ...], made: int) -> Network:
    return learn(examples(list(sample), made))


# Extraction


def label_pages(net: Network, reader: Reader, pages: list[str | None]) -> list[list[Block]]:
    """The blocks of each page that belong to its article."""
    read: list[list[Block]] = []
    dense: list[np.ndarray] = []
    for html in pages:
        blocks, _ = reader.read(html or "")
        read.append(blocks)
        parts = []
        for i in range(0, len(blocks), MOST_ROWS):
            path = np.stack([reader.paths[b.path] for b in blocks[i : i + MOST_ROWS]])
            parts.append(path @ net.dense[:PATH])
        dense.append(np.concatenate(parts) if parts else np.zeros((0, DENSE)))
    everything = [b.text for blocks in read for b in blocks]
    bags = np.concatenate([word_bags(everything[i : i + MOST_ROWS]) @ net.dense[PATH : PATH + WORDS] for i in range(0, len(everything), MOST_ROWS)] or [np.zeros((0, DENSE))])
    lengths = [len(b) for b in read]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    kept: list[list[Block]] = [[] for _ in pages]
    for batch in batches_of(lengths):
        n = np.array([lengths[k] for k in batch])
        if not n.max():
            continue
        x = np.zeros((n.max(), len(batch), DENSE))
        for i, k in enumerate(batch):
            if lengths[k]:
                x[: lengths[k], i] = np.tanh(dense[k] + bags[starts[k] : starts[k + 1]] + measures(read[k]) @ net.dense[PATH + WORDS : INPUT] + net.dense[INPUT])
        logits = run(net, x, n)
        for i, k in enumerate(batch):
            kept[k] = [b for b, z in zip(read[k], logits[:, i], strict=False) if z >= 0]
    return kept


def extract_text(pages: DataFrame, net: Network) -> DataFrame:
    """(row, text, n_chars): each row of ``pages`` as a struct, its main text, and that text's code points.

    Blocks that the network takes for the article are joined by spaces, in page order. A null or empty
    html, or a page without an article, gives an empty text. Rows are judged one by one, so repeated
    rows and null ids are as good as others; all other columns, whatever their names, travel in row.
    """
    row = F.struct(*(pages[f"`{c}`"] for c in pages.columns if c != "html")).alias("row")
    rows = pages.select(row, F.col("html"))
    schema = StructType([rows.schema["row"], StructField("text", StringType())])
    kept = rows.mapInArrow(lambda batches: _extracted(net, batches), schema)
    return kept.select("row", "text", F.length("text").cast("long").alias("n_chars"))


def _extracted(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        htmls = batch.column(1)
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            kept = label_pages(net, reader, htmls.slice(at, 256).to_pylist())
            texts = pa.array([" ".join(b.text for b in blocks) for blocks in kept], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), texts], ["row", "text"])
