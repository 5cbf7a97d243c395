"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with its tag path (tags and words of class, id and role) and its words.
Both are hashed into vectors, with length and share of linked text beside them. A bidirectional LSTM in numpy reads the
whole sequence and labels every block as main text or not. It is trained, each time anew and always alike, on pages
that a generator writes with known labels in several layouts (named sections, plain bodies, divs without names, tables);
no table is read for it. Formulas and embedded objects count as text; templates, drawings and what stands in for scripts
don't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, rows_of

#: Fixed sets of tag names.
BLOCK_TAGS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video audio".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript svg".split())
SILENT_END = re.compile(rf"</({'|'.join(sorted(SILENT_TAGS))})[\s/>]", re.I)
CLOSES_P = BLOCK_TAGS - frozenset("body head html option optgroup button label".split())
PATH_DIMS, WORD_DIMS, EXTRA = 256, 320, 6
HIDDEN = 24
#: Blocks of a page from which its inputs are made in slices of that size.
SLICE = 4096
PART = re.compile(r"[a-z]+")


class Leaves(HTMLParser):
    """Leaf blocks of a page: (path words, text, share of linked characters)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Ends of silent elements still to come; an element without an end isn't silent, or it would take the rest of the page.
        self.ends = Counter(m.group(1).lower() for m in SILENT_END.finditer(html))
        self.open: Counter[str] = Counter()
        self.stack: list[tuple[str, list[str]]] = []
        self.text: list[str] = []
        self.linked = self.links = 0
        self.blocks: list[tuple[list[str], str, float]] = []

    @property
    def silent(self) -> bool:
        return any(self.open.values())

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append(([w for _, words in self.stack for w in words], text, min(1.0, self.linked / len(text))))
            self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            if self.ends[tag] > self.open[tag]:
                self.open[tag] += 1
            return
        if self.silent:
            return
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in CLOSES_P and any(t == "p" for t, _ in self.stack):
                self.close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
                self.close(tag)
            if tag not in VOID_TAGS:
                named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
                self.stack.append((tag, [f"<{tag}", *PART.findall(named)]))
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        elif tag not in SILENT_TAGS:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.ends[tag] -= 1
            if self.open[tag]:
                self.open[tag] -= 1
        elif not self.silent:
            if tag in BLOCK_TAGS:
                self.flush()
                self.close(tag)
                self.links = 0
            elif tag == "a":
                self.links = max(0, self.links - 1)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaves(html: str) -> list[tuple[list[str], str, float]]:
    parser = Leaves(html)
    parser.feed(html)
    HTMLParser.close(parser)
    parser.flush()
    return parser.blocks


def vectors(blocks: list[tuple[list[str], str, float]], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block: hashed path, hashed words, length, links, and its place among the page's total."""
    x = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + EXTRA), np.float32)
    total = total or len(blocks)
    for i, (path, text, links) in enumerate(blocks):
        for w in path:
            x[i, crc32(w.encode()) % PATH_DIMS] = 1
        words = text.split()
        for w in words:
            x[i, PATH_DIMS + crc32(w.lower().encode("utf-8", "replace")) % WORD_DIMS] += 1
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= len(words) + 3  # one word alone says little
        x[i, -EXTRA:] = (min(np.log1p(len(words)) / 5, 1.5), links, (first + i) / total, text[-1:] in ".!?", min(len(path), 40) / 20, min(total, 200) / 200)
    return x


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class BiLSTM:
    """Two LSTMs, one from either end, and a logistic layer over both states of each block."""

    def __init__(self, seed: int = 5):
        rng, d = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + EXTRA
        self.p = {}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 0.15, (d, 4 * HIDDEN))
            self.p["u" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"], self.p["d"], self.p["k"] = rng.normal(0, 0.15, 2 * HIDDEN), rng.normal(0, 0.05, d), np.zeros(1)

    def states(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: (blocks, pages, inputs); mask: (blocks, pages, 1)."""
        return self.run(x @ self.p["w" + side] + self.p["c" + side], mask, side, keep)

    def run(self, pre: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        u = self.p["u" + side]
        h = c = np.zeros((pre.shape[1], HIDDEN))
        out = np.zeros((*pre.shape[:2], HIDDEN))
        for t in range(len(pre)) if side == "f" else range(len(pre) - 1, -1, -1):
            z = pre[t] + h @ u
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            c1 = f * c + i * g
            h1 = o * np.tanh(c1)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, c1))
            h, c = np.where(mask[t], h1, h), np.where(mask[t], c1, c)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.states(x, mask, "f"), self.states(x, mask, "b")], axis=2)
        return _sigmoid(h @ self.p["o"] + x @ self.p["d"] + self.p["k"][0])

    def long_scores(self, blocks: list) -> np.ndarray:
        """Scores of one page of very many blocks, whose inputs are made in slices: nothing as wide as they are is held for all."""
        rows = {"f": [], "b": [], "d": []}
        for lo in range(0, len(blocks), SLICE):
            x = vectors(blocks[lo : lo + SLICE], lo, len(blocks)).astype(float)
            rows["d"].append(x @ self.p["d"])
            for side in "fb":
                rows[side].append((x @ self.p["w" + side] + self.p["c" + side]).astype(np.float32))
        mask = np.ones((len(blocks), 1, 1))
        out = np.concatenate(rows["d"]) + self.p["k"][0]
        for n, side in enumerate("fb"):
            out += self.run(np.concatenate(rows.pop(side))[:, None], mask, side)[:, 0] @ self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
        return _sigmoid(out)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        steps = {"f": [], "b": []}
        h = np.concatenate([self.states(x, mask, s, steps[s]) for s in "fb"], axis=2)
        e = (_sigmoid(h @ self.p["o"] + x @ self.p["d"] + self.p["k"][0]) - y) * mask[:, :, 0] / mask.sum()
        g = {"o": np.einsum("tb,tbh->h", e, h), "d": np.einsum("tb,tbd->d", e, x), "k": np.array([e.sum()])}
        for n, s in enumerate("fb"):
            u, dz = self.p["u" + s], np.zeros((*x.shape[:2], 4 * HIDDEN))
            du, dh, dc = np.zeros_like(u), np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h0, c0, i, f, o, gg, c1 in reversed(steps[s]):
                dh = dh + e[t][:, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
                m, th = mask[t], np.tanh(c1)
                own, cell = dh * m, dc * m + dh * m * o * (1 - th * th)
                z = np.concatenate([cell * gg * i * (1 - i), cell * c0 * f * (1 - f), own * th * o * (1 - o), cell * i * (1 - gg * gg)], axis=1)
                dz[t] = z
                du += h0.T @ z
                dh, dc = dh * (1 - m) + z @ u.T, dc * (1 - m) + cell * f
            g |= {"w" + s: x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, dz.shape[2]), "u" + s: du, "c" + s: dz.sum((0, 1))}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, batch: int = 32, rate: float = 0.01) -> BiLSTM:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        rng, n = np.random.default_rng(3), 0
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)  # ever smaller steps
            # Pages of about one length go together, so that little is padded; groups come in any order.
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[i][1]) // 4 for i in order], kind="stable")]
            for lo in rng.permutation(np.arange(0, len(order), batch)).tolist():
                x, mask, y = padded([pages[i][0] for i in order[lo : lo + batch]], [pages[i][1] for i in order[lo : lo + batch]])
                n += 1
                for k, v in self.gradients(x, mask, y).items():
                    a, b = moments[k]
                    a[:], b[:] = 0.9 * a + 0.1 * v, 0.999 * b + 0.001 * v * v
                    self.p[k] -= step * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
        return self


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None):
    longest = max(map(len, xs))
    x, mask, y = np.zeros((longest, len(xs), xs[0].shape[1])), np.zeros((longest, len(xs), 1)), np.zeros((longest, len(xs)))
    for i, one in enumerate(xs):
        x[: len(one), i], mask[: len(one), i] = one, 1
        if ys:
            y[: len(one), i] = ys[i]
    return x, mask, y


class Writer:
    """Writes pages with known labels: what stands around an article, the article, and what interrupts it.

    Pages have one of several layouts: sections with names, plain bodies, divs without names, and tables. Prose is
    invented by drawn alphabets of syllables or strung together from common words; what stands around it says what such
    places say, or is invented as well.
    """

    #: Words of class, id and role by part, which the labeller learns.
    NAMES = {"menu": "nav navbar navigation menu topmenu breadcrumb breadcrumbs toolbar tabs pagination links", "head": "header masthead banner top branding logo sitehead", "foot": "footer foot bottom copyright colophon legal sitefoot", "side": "sidebar side aside related widget trending recommended popular more teaser", "ad": "ad ads advert advertisement sponsored promo banner adslot adbox", "notice": "cookie consent notice alert modal popup gdpr banner overlay message", "form": "form search login signup newsletter subscribe contact", "comments": "comments comment responses discussion reply replies thread disqus respond feedback", "main": "article content main post entry story body text page hentry"}
    #: What such places say.
    SAYS = {
        "menu": ("Home", "About", "About us", "Contact", "News", "Products", "Services", "Blog", "Archive", "Sports", "Politics", "Next", "Previous", "Log in", "Sign up", "Start", "Über uns", "Kontakt", "Accueil", "Inicio", "Help", "FAQ", "Shop", "Sitemap", "Events"),
        "head": ("The Daily Post", "My Blog", "News and views since 1998", "Example Company", "Your source for local news", "Welcome to our site", "A blog about everything"),
        "foot": ("Copyright 2020 Example Inc. All rights reserved.", "© 2019 The Company. All rights reserved", "Privacy policy", "Terms of use", "Powered by WordPress", "Copyright (c) 2015 by the authors.", "Impressum", "All rights reserved.", "Contact us | Privacy | Terms", "Designed by us. Hosted there.", "© 2021 Tous droits réservés"),
        "side": ("Related articles", "Most read", "Popular posts", "You may also like", "Recent posts", "Archives", "Tags", "Follow us on Twitter", "Share this", "Read more", "More from this section"),
        "ad": ("Advertisement", "Sponsored", "Buy now and save 50 percent today!", "Sponsored content: the best deals of the week.", "Limited offer. Shop now.", "Get the best price. Click here.", "Anzeige", "Try it free for 30 days."),
        "notice": ("We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our policy.", "Accept all cookies", "Please enable JavaScript.", "You have 3 free articles left this month.", "Subscribe to read the full story.", "Breaking: follow our live coverage."),
        "form": ("Search", "Your e-mail address", "Subscribe to our newsletter", "Sign up for updates", "Name", "Password", "Leave a comment", "Send"),
        "comments": ("Great article, thanks!", "I do not agree with this at all.", "First!", "Posted by anonymous on Monday", "3 comments", "Leave a reply", "Reply", "Thanks for sharing, very helpful.", "Says: I had the same problem last year and nobody helped me.", "John says:", "Comments (12)", "Nice post. I will try that."),
    }
    COMMON = "the of and to in a is that it was for on are with as they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know city year river house work school old world mountain road bridge small great early late morning winter village market children music history summer study paper result number energy light system".split()

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.syllables = ["th"]
        self.real, self.telling = False, 0.5

    def pick(self, seq):
        return seq[int(self.rng.integers(len(seq)))]

    def speak(self) -> None:
        """The language of one page: common words, or syllables of drawn consonants and vowels."""
        self.real = self.rng.random() < 0.5
        self.telling = self.pick([0.0, 0.5, 0.9])  # how often what stands around says so
        consonants, vowels = ["b", "ch", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "z", "ñ", "ß", "д", "к", "л", "н"], ["a", "e", "i", "o", "u", "ä", "é", "ou", "ie", "ó", "а", "и"]
        self.syllables = [self.pick(consonants) + self.pick(vowels) + self.pick(["", "", "n", "r", "s"]) for _ in range(40)]

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        out = [self.pick(self.COMMON) if self.real else "".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(n)]
        return " ".join(out).capitalize() + self.pick([".", ".", ".", "", "!", "?"])

    def said(self, part: str, low: int, high: int) -> str:
        return self.pick(self.SAYS[part]) if self.rng.random() < self.telling else self.words(low, high)

    def wrap(self, tag: str, part: str, inner: str, named: float = 0.4) -> str:
        attr = f' {self.pick(["class", "class", "id", "role"])}="{self.pick(self.NAMES[part].split())}"' if self.rng.random() < (named if tag != "div" or named < 0.4 else 1) else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def listed(self) -> str:
        links = [f'<a href="/x">{self.said("menu", 1, 3)}</a>' for _ in range(int(self.rng.integers(2, 8)))]
        kind = self.rng.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind < 0.6 else " | ".join(links) if kind < 0.8 else " ".join(links) if kind < 0.9 else "<br>".join(links)

    def comment(self) -> str:
        inner = f"<p>{self.said('comments', 3, 60)}</p>"
        return self.pick(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 3)}</h4>"]) + inner

    def around(self, part: str, named: float = 0.4) -> str:
        tag = {"menu": ["nav", "div"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside"], "notice": ["div", "dialog", "section"], "form": ["form", "div"], "comments": ["section", "div", "div"]}[part]
        own = self.said
        body = {
            "menu": self.listed,
            "head": lambda: self.pick([f"<h1>{own('head', 1, 4)}</h1><p>{own('head', 2, 8)}</p>", self.listed(), f"<div>{own('head', 1, 4)}</div>"]),
            "foot": lambda: self.pick([f"&copy; {own('foot', 2, 14)}", f"<p>{own('foot', 3, 30)}</p>", own("foot", 3, 20), self.listed(), f"<p>{own('foot', 2, 9)}</p><p>{own('foot', 2, 9)}</p>"]),
            "side": lambda: f"<h3>{own('side', 1, 4)}</h3>" + self.pick([self.listed(), f"<p>{own('side', 4, 40)}</p>"]),
            "ad": lambda: self.pick([own("ad", 2, 15), f"<p>{own('ad', 3, 20)}</p>", f'<a href="/a">{own("ad", 2, 6)}</a>']),
            "notice": lambda: f"<p>{own('notice', 5, 30)}</p><button>{self.words(1, 2)}</button>",
            "form": lambda: f"<label>{own('form', 1, 3)}</label><input><button>{own('form', 1, 2)}</button>",
            "comments": lambda: f"<h3>{own('comments', 1, 2)}</h3>" + "".join(self.wrap(self.pick(["div", "li", "article"]), "comments", self.comment()) for _ in range(int(self.rng.integers(1, 5)))),
        }[part]()
        if part == "form" and self.rng.random() < 0.5:
            return f"<form>{body}</form>"
        return self.wrap(self.pick(tag), part, body, named)

    def passage(self) -> str:
        """A piece of an article: all of its blocks are main text."""
        w, kind = self.words, self.rng.random()
        if kind < 0.08:
            return f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{w(1, 6)}</{h}>"
        if kind < 0.14:
            return self.pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{w(2, 20)}</li>" for _ in range(int(self.rng.integers(1, 5)))))
        if kind < 0.18:
            return f"<blockquote>{self.pick([f'<p>{w(5, 40)}</p>', w(5, 40)])}</blockquote>"
        if kind < 0.23:
            return f'<figure><img src="/i.png">{self.pick([f"<figcaption>{w(2, 15)}</figcaption>", f"<figcaption><p>{w(2, 15)}</p></figcaption>"])}</figure>'
        if kind < 0.27:
            return f"<p>{w(2, 20)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {w(2, 20)}</p>"
        if kind < 0.3:
            return f"<pre>{w(3, 20)}</pre>"
        if kind < 0.33:
            return f"<dl><dt>{w(1, 3)}</dt><dd>{w(3, 20)}</dd></dl>"
        if kind < 0.41:
            return f"<p><b>{w(5, 80)}<br><p>{w(3, 40)}</p>"
        if kind < 0.49:
            return f"<p>{w(1, self.pick([1, 2, 4]))}</p>"
        if kind < 0.52:
            return f"<table><tr><th>{w(1, 3)}</th><th>{w(1, 3)}</th></tr><tr><td>{w(1, 5)}</td><td>{w(1, 5)}</td></tr></table>"
        if kind < 0.62:
            return f'<p>{w(4, 40)} <a href="/l">{w(1, 3)}</a> {w(4, 60)}</p>'
        return f"<p>{w(5, 120)}</p>"

    def some(self, parts: list[str], most: int, named: float) -> list[tuple[str, int]]:
        return [(self.around(self.pick(parts), named), 0) for _ in range(int(self.rng.integers(0, most + 1)))]

    def article(self, named: float, interrupted: float = 0.1, quoting: float = 0.0) -> list[tuple[str, int]]:
        """quoting: how often a passage says what else stands around articles; where the article has a name, it is text all the same."""
        body: list[tuple[str, int]] = []
        said = self.words(2, 12) if self.rng.random() < 0.9 else " ".join([self.words(1, 1)] * int(self.rng.integers(3, 40)))
        title = f"<{(h := self.pick(['h1', 'h1', 'h1', 'h2']))}>{said}</{h}>"
        if self.rng.random() < 0.8:
            body.append((f"<header>{title}</header>" if self.rng.random() < 0.15 else title, 1))
        for _ in range(int(self.pick([1, 2, 3, *range(1, 12)]))):
            body.append((self.passage(), 1))
            if self.rng.random() < quoting:
                body.append((f"<p>{self.pick(self.SAYS[self.pick(list(self.SAYS))])}</p>", 1))
            if self.rng.random() < 0.06:  # short lines, one after the other, often alike
                line = self.words(1, 4)
                body.append(("".join(f"<p>{line if self.rng.random() < 0.7 else self.words(1, 4)}</p>" for _ in range(int(self.rng.integers(2, 24)))), 1))
            if self.rng.random() < interrupted:
                body.append((self.around(self.pick(["ad", "side", "form", "notice", "menu"]), max(named, 0.4)), 0))
        return body

    def sections(self) -> list[tuple[str, int]]:
        """An article in an element of its own."""
        outer = self.pick(["<article>", "<article>", "<main><article>", "<main>", f'<div class="{self.pick(self.NAMES["main"].split())}">', f'<main><div id="{self.pick(self.NAMES["main"].split())}">', f'<article class="{self.pick(self.NAMES["main"].split())}">', "<div><article>"])
        body = [(outer, 1), *self.article(0.4, quoting=0.12)]
        if self.rng.random() < 0.25:
            body.append((self.around("comments"), 0))
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", outer)))
        return [*self.some(["menu", "head", "ad", "notice", "form", "side"], 3, 0.4), *body, (closing, 1), *self.some(["comments", "side", "foot", "ad", "foot", "menu", "form"], 3, 0.4)]

    def plain(self) -> list[tuple[str, int]]:
        """Paragraphs, or text alone, in the body."""
        if self.rng.random() < 0.3:
            text = "<br><br>".join(self.words(5, 80) for _ in range(int(self.rng.integers(1, 4))))
            body = [(self.pick([text, f"<div>{text}</div>", f"<p>{text}"]), 1)]
        else:
            body = self.article(0.4, 0.03)
        return [*self.some(["menu", "head", "notice"], 1, 0.2), *body, *self.some(["foot", "foot", "comments", "menu"], 2, 0.2)]

    def divs(self) -> list[tuple[str, int]]:
        """Nested elements of few names."""
        opening, closing = ("<div>", "</div>") if self.rng.random() < 0.5 else ("<div><div>", "</div></div>")
        return [(opening, 1), *self.some(["menu", "head", "menu", "form"], 2, 0.15), (closing + opening, 1), *self.article(0.2, 0.05), (closing, 1), *self.some(["side", "comments"], 1, 0.4), *self.some(["foot", "foot", "menu"], 2, 0.15)]

    def tables(self) -> list[tuple[str, int]]:
        """A page laid out in a table: a row of links, the article beside a column of links, and a last row."""
        links = lambda: self.pick([self.listed(), "".join(f'<a href="/x">{self.said("menu", 1, 3)}</a><br>' for _ in range(int(self.rng.integers(2, 7))))])
        out: list[tuple[str, int]] = [("<table>", 1)]
        if self.rng.random() < 0.6:
            out.append((f'<tr><td colspan="2">{self.pick([links(), self.said("head", 1, 5), f"<h1>{self.said("head", 1, 5)}</h1>"])}</td></tr>', 0))
        before = self.rng.random() < 0.6
        out.append((f"<tr><td>{links()}</td><td>" if before else "<tr><td>", 0))
        out += self.article(0.2, 0.02)
        out.append(("</td></tr>" if before else f"</td><td>{links()}</td></tr>", 0))
        if self.rng.random() < 0.7:
            out.append((f"<tr><td>{self.pick([self.said('foot', 3, 12), links()])}</td></tr>", 0))
        return [*out, ("</table>", 1), *self.some(["foot"], 1, 0.2)]

    def page(self) -> tuple[str, list[int]]:
        """The page and the label of each of its blocks."""
        self.speak()
        kind = self.rng.random()
        if kind >= 0.5:
            self.telling = max(self.telling, 0.8)
        body = self.sections() if kind < 0.5 else self.plain() if kind < 0.67 else self.divs() if kind < 0.84 else self.tables()
        parts = [(f"<title>{self.words(2, 9)}</title>", 0), *body] if self.rng.random() < 0.9 else body
        opening, closing = self.pick([("<html><head><style>p{}</style></head><body>", "</body></html>"), ("<html><body>", "</body></html>"), ("<!DOCTYPE html><html><head><script>a()</script></head><body>", ""), ("<body>", "</body>"), ("", "")])
        html, labels = opening, []
        for piece, label in parts:
            before = len(leaves(html))
            html += piece
            labels += [label] * (len(leaves(html)) - before)
        return html + closing, labels


def train(pages: int = 1300, seed: int = 11) -> BiLSTM:
    writer, rows = Writer(seed), []
    for _ in range(pages):
        html, labels = writer.page()
        blocks = leaves(html)
        if blocks:
            rows.append((vectors(blocks), np.array(labels[: len(blocks)], float)))
    return BiLSTM().fit(rows)


def labelled(model: BiLSTM, pages: list[list]) -> list[np.ndarray]:
    """Whether each block of each page is main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        if len(pages[order[lo]]) > SLICE:  # the rest is as long
            for i in order[lo:]:
                out[i] = model.long_scores(pages[i]) > 0.5
            break
        longest = len(pages[order[min(len(order), lo + 64) - 1]])
        own = order[lo : lo + max(1, min(64, 200_000 // longest))]
        x, mask, _ = padded([vectors(pages[i]) for i in own])
        s = model.scores(x, mask)
        for n, i in enumerate(own):
            out[i] = s[: len(pages[i]), n] > 0.5
        lo += len(own)
    return out


def extract(pages: DataFrame, model: BiLSTM) -> DataFrame:
    """page_id, url, text (main blocks joined by line ends) and blocks: array of struct(path, text, main).

    A null or empty html gives an empty text and no blocks. Broken markup is read as far as it goes: a silent element
    (but a script or style) without an end is read as if its tag weren't there. Pages of any length are labelled whole.
    Repeated rows stay, further columns go; an empty table gives an empty result.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("main", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                read = [leaves(h or "") for h in batch.column("html").to_pylist()]
                main = labelled(model, read)
                texts = ["\n".join(b[1] for b, ok in zip(blocks, own) if ok) for blocks, own in zip(read, main)]
                blocks = [[{"path": " ".join(b[0]), "text": b[1], "main": bool(ok)} for b, ok in zip(one, own)] for one, own in zip(read, main)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(blocks, kinds)], names=["page_id", "url", "text", "blocks"])

    return mapped(rows_of(pages, page_id="long", url="string", html="string"), run, "page_id bigint, url string, text string, blocks array<struct<path:string,text:string,main:boolean>>")


def op6_html(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
