"""Main text of web pages: a recurrent labeller of the page's blocks, read in page order.

A page is read into leaves: stretches of text between the borders of block elements, references decoded, white space made one
space. Each leaf becomes a vector: the hashed tags, classes, ids and roles on its path, its hashed words, and a few numbers
(length, share of linked text, punctuation, place). A bidirectional LSTM in numpy reads the vectors of the whole page and gives
each leaf the probability of belonging to the article, so that what a leaf is may follow from what stands around it.

The model is trained anew for a table of pages, in one task, on a bounded sample (`sample` pages, by hash): pages that mark
their article by an element or role for it give labels themselves, and texts of the sample are set into `made` pages of other
build, with the containers' names, order and depth drawn and names left out at random, whose labels are known. Nothing else
reads the labels: prediction sees the html alone.
"""

from __future__ import annotations

import functools
import io
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.bpe import Memory
from cohortloom.llm.common import cut, texts

#: Elements that stand on lines of their own, have no end tag, or hold no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("audio button canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
#: What a start tag ends, if it is open: the elements, and those beyond which it does not look.
LISTS, TABLE = frozenset("ol ul menu dir".split()), frozenset(["table"])
ENDS = {"li": (frozenset(["li"]), LISTS), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"]))}
ENDS |= {"tr": (frozenset(["tr"]), TABLE), "td": (frozenset(["td", "th"]), TABLE | {"tr"}), "th": (frozenset(["td", "th"]), TABLE | {"tr"})}
ENDS |= {t: (frozenset(["thead", "tbody", "tfoot"]), TABLE) for t in ("thead", "tbody", "tfoot")}
PARAGRAPH = (frozenset(["p"]), frozenset("article aside body button caption div footer form header html li main nav section table td th".split()))

PATH, WORDS, NUMBERS = 64, 32, 8
WIDTH = PATH + WORDS + NUMBERS


#: Elements whose content is not markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noembed noframes noscript xmp".split()}
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|=)""")
TAG_END = re.compile(r"[\s/]*>")


@dataclass(slots=True)
class Element:
    tag: str
    path: np.ndarray
    inside: str
    block: Element | None


@dataclass
class Leaf:
    text: str
    linked: float
    path: np.ndarray
    inside: str = ""


def _slot(token: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % size


_word_slot = Memory(lambda w: _slot(w, WORDS), most=100_000)
_tag_slot = Memory(lambda w: _slot(w, PATH), most=100_000)

#: Elements and roles that say what is the article, and what within or beside it is not.
SAYS_MAIN = frozenset(["article", "main", "role=main", "role=article", "itemprop=articlebody"])
SAYS_OTHER = frozenset("nav aside footer form role=navigation role=banner role=contentinfo role=complementary role=search ad ads advert comment comments".split())


class Reader:
    """Reads a page into leaves. `inside` of a leaf is "main", "other" or "", by the innermost ancestor that says so; for training only.

    The time is in proportion to the page, whatever it holds: a tag, comment or quote that never ends is given up once.
    """

    def __init__(self):
        self.leaves: list[Leaf] = []
        self.open = [Element("", np.zeros(PATH, np.float32), "", None)]
        self.counts: Counter[str] = Counter()
        self.silent = self.links = 0
        self.said: list[str] = []
        self.chars = self.linked = 0

    def read(self, html: str) -> list[Leaf]:
        at, n = 0, len(html)
        while at < n:
            mark = html.find("<", at)
            if mark < 0:
                mark = n
            if mark > at:
                self.text(html[at:mark])
            if mark == n:
                break
            at = self.markup(html, mark)
        self.end_leaf()
        return self.leaves

    def markup(self, html: str, at: int) -> int:
        """What starts with the < at `at`; the place after it, or the page's end if it never ends."""
        tag = TAG.match(html, at)
        if tag is None:
            after = html[at + 1 : at + 2]
            if after not in ("!", "?", "/") or not after:
                self.text("<")
                return at + 1
            mark = "-->" if html.startswith("<!--", at) else ">"
            end = html.find(mark, at + 2)
            return len(html) if end < 0 else end + len(mark)
        name, given, at = tag.group(1).lower(), {}, tag.end()
        while not (end := TAG_END.match(html, at)):
            found = ATTRIBUTE.match(html, at)
            if found is None:
                return len(html)
            if found.group(1):
                given.setdefault(found.group(1).lower(), found.group(2) or found.group(3) or found.group(4) or "")
            at = found.end()
        at = end.end()
        if html.startswith("</", tag.start()):
            self.end_tag(name)
            return at
        self.start_tag(name, given)
        if name in RAW:
            close = RAW[name].search(html, at)
            return close.start() if close else len(html)
        return at

    def end_leaf(self) -> None:
        if self.said:
            text = " ".join("".join(self.said).split())
            if text:
                block = self.open[-1].block or self.open[0]
                self.leaves.append(Leaf(text, self.linked / max(1, self.chars), block.path, block.inside))
            self.said.clear()
        self.chars = self.linked = 0

    def close_to(self, tags: frozenset[str], beyond: frozenset[str]) -> None:
        if not any(self.counts[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                self.pop(k)
                return
            if tag in beyond:
                return

    def pop(self, k: int) -> None:
        for e in self.open[k:]:
            self.silent -= e.tag in SILENT
            self.links -= e.tag == "a"
            self.counts[e.tag] -= 1
        del self.open[k:]

    def start_tag(self, tag: str, given: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.end_leaf()
            if tag in ENDS:
                self.close_to(*ENDS[tag])
            self.close_to(*PARAGRAPH)
        elif tag == "br":
            self.said.append("\n")
        if tag in VOID:
            return
        top, names = self.open[-1], ()
        if given:
            names = tuple(x.lower() for key in ("class", "id") for x in given.get(key, "").split())
            names += tuple(f"{key}={x.lower()}" for key in ("role", "itemprop") for x in given.get(key, "").split())
        path, inside = top.path, top.inside
        if tag in BLOCKS or names:
            path = path.copy()
            for token in (tag, *names):
                path[_tag_slot[token]] += 1
            for token in (tag, *names):
                inside = "main" if token in SAYS_MAIN else "other" if token in SAYS_OTHER else inside
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.counts[tag] += 1
        self.open.append(Element(tag, path, inside, top.block))
        if tag in BLOCKS:
            self.open[-1].block = self.open[-1]

    def end_tag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_leaf()
        if not self.counts[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.pop(k)
                return
            if tag not in BLOCKS and self.open[k].tag in BLOCKS and tag not in SILENT:
                return  # an inline end tag does not end the block it stands in

    def text(self, data: str) -> None:
        if self.silent:
            return
        data = unescape(data)
        self.said.append(data)
        self.chars += len(data)
        self.linked += len(data) if self.links else 0


def leaves(html: str) -> list[Leaf]:
    return Reader().read(html)


def vectors(page: Sequence[Leaf]) -> np.ndarray:
    """One row per leaf."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for k, leaf in enumerate(page):
        words = leaf.text.lower().split()
        out[k, :PATH] = leaf.path
        out[k, PATH : PATH + WORDS] = np.bincount(np.fromiter(map(_word_slot.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        n, last = len(leaf.text), leaf.text[-1]
        out[k, PATH + WORDS :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, leaf.linked, last in ".!?…。", last.isalnum(), n / len(words) / 10, k / len(page), min(k, 20) / 20)
    out[:, :PATH] = np.minimum(out[:, :PATH], 3)
    some = out[:, PATH : PATH + WORDS]
    some /= np.maximum(1, np.sqrt((some**2).sum(axis=1, keepdims=True)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with one logistic output per step. Weights: per direction input, state and bias of the four gates; the output's."""

    SHAPES = ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")

    def __init__(self, hidden: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.w = h, {}
        for d in "fb":
            self.w["w" + d] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * h)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.w["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)  # gates: in, forget, out, new
        self.w["v"], self.w["c"] = rng.normal(0, 0.3, 2 * h).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction over (steps, pages, width); padded steps leave the state as it is."""
        w, u, b, h = self.w["w" + d], self.w["u" + d], self.w["b" + d], self.hidden
        steps, pages, _ = x.shape
        gates_in = x.reshape(-1, WIDTH) @ w + b
        gates_in = gates_in.reshape(steps, pages, 4 * h)
        out, kept = np.zeros((steps, pages, h), np.float32), [None] * steps
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_in[t] + state @ u
            gate = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            now = f * cell + i * g
            squashed = np.tanh(now)
            m = mask[t][:, None]
            kept[t] = (state, cell, i, f, o, g, squashed, m)
            cell = np.where(m, now, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        forth, kept_f = self._run(x, mask, "f")
        back, kept_b = self._run(x, mask, "b")
        both = np.concatenate([forth, back], axis=2)
        return both @ self.w["v"] + self.w["c"][0], (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the steps that are not padded."""
        z, (both, kept_f, kept_b) = self.logits(x, mask)
        error = ((_sigmoid(z) - y) * mask / max(1, mask.sum())).astype(np.float32)
        found = {"v": np.einsum("tp,tph->h", error, both), "c": np.array([error.sum()], np.float32)}
        spread = error[:, :, None] * self.w["v"]
        for d, kept in (("f", kept_f), ("b", kept_b)):
            found |= self._back(x, kept, spread[:, :, : self.hidden] if d == "f" else spread[:, :, self.hidden :], d)
        return found

    def _back(self, x: np.ndarray, kept: list, spread: np.ndarray, d: str) -> dict[str, np.ndarray]:
        u, h = self.w["u" + d], self.hidden
        steps, pages, _ = x.shape
        by_gate = np.zeros((steps, pages, 4 * h), np.float32)
        to_u = np.zeros_like(u)
        d_state, d_cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            state, cell, i, f, o, g, squashed, m = kept[t]
            d_out = d_state + spread[t]
            inner = d_out * m
            d_now = d_cell * m + inner * o * (1 - squashed**2)
            z = by_gate[t]
            z[:, :h], z[:, h : 2 * h] = d_now * g * i * (1 - i), d_now * cell * f * (1 - f)
            z[:, 2 * h : 3 * h], z[:, 3 * h :] = inner * squashed * o * (1 - o), d_now * i * (1 - g**2)
            to_u += state.T @ z
            d_state = z @ u.T + d_out * ~m
            d_cell = d_now * f + d_cell * ~m
        flat = by_gate.reshape(-1, 4 * h)
        return {"w" + d: x.reshape(-1, WIDTH).T @ flat, "u" + d: to_u, "b" + d: flat.sum(axis=0)}

    def fit(self, pages: Sequence[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 5) -> Labeller:
        """Adam over batches of pages of like length, in a drawn order."""
        rng = np.random.default_rng(seed)
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [stacked([v for v, _ in some], [y for _, y in some]) for k in range(0, len(pages), batch) if (some := pages[k : k + batch])]
        first, second, n = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                n += 1
                for name, g in self.gradients(*batches[k]).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - rate * (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self

    def shares(self, pages: Sequence[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """The probability of each leaf of each page. Pages of like length are read together, up to `most` leaves with padding."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        while order:
            some = [order.pop()]
            longest = len(pages[some[0]])
            while order and (len(some) + 1) * longest <= most:
                some.append(order.pop())
            x, mask, _ = stacked([pages[k] for k in some], None)
            p = _sigmoid(self.logits(x, mask)[0])
            for at, k in enumerate(some):
                out[k] = p[: len(pages[k]), at]
        return out

    def dump(self) -> bytes:
        with io.BytesIO() as out:
            np.savez(out, hidden=self.hidden, **self.w)
            return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        with np.load(io.BytesIO(data)) as stored:
            model = cls(int(stored["hidden"]))
            model.w = {k: stored[k] for k in cls.SHAPES}
        return model


def stacked(pages: Sequence[np.ndarray], labels: Sequence[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, width), which steps are not padded, labels."""
    steps = max(len(p) for p in pages)
    x, mask, y = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


#: Containers (element and names) as pages commonly call them.
MAIN = "article|main|div article|div content|div main-content|div post|div post-content|div entry-content|div story|div article-body|section content|section article|div page-content|div body-text|td content|div text"
OTHERS = {
    "menu": "nav|ul menu|div nav|div navbar|div navigation|div breadcrumbs|nav main-nav|div topnav",
    "header": "header|div header|div masthead|div site-header|div branding|div topbar",
    "footer": "footer|div footer|div site-footer|div copyright|div bottom|div legal",
    "side": "aside|div sidebar|div widget|div related|div recommended|section related|div side|div trending|aside sidebar",
    "notice": "div notice|div cookie|div cookie-banner|div alert|div consent|div popup|div banner|p notice|div subscribe",
    "advert": "div ad|div ads|div advert|div advertisement|div sponsored|div promo|div adsbygoogle|aside ad|section sponsored",
    "form": "form|form search|form newsletter|form login|div signup|form contact",
    "comments": "section comments|div comments|div comment|ol commentlist|div id=comments|div responses|ul comments|div discussion",
}
SHELLS = "div container|div wrapper|div row|div page|div|section|div id=page|div col"
MARK = {"": 0, "": 1}


class Maker:
    """Makes pages whose labels are known out of the texts of others. Each text starts with the mark of its label."""

    def __init__(self, long_texts: Sequence[str], seed: int = 3):
        self.rng = random.Random(seed)
        self.texts = [t for t in long_texts if t.strip()] or ["".join(self.rng.choices("aeioulnrst ", k=300)) + "." for _ in range(50)]

    def said(self, label: int, words: int) -> str:
        found = self.rng.choice(self.texts).split()
        at = self.rng.randrange(max(1, len(found) - words + 1))
        text = " ".join(found[at : at + words])
        if self.rng.random() < 0.5 and words > 6:
            text = text.rstrip(".,") + "."
        return chr(0xE000 + label) + text.replace("&", "&amp;").replace("<", "&lt;")

    def opened(self, what: str, inner: str) -> str:
        """A container in one of its spellings; its names are left out or replaced now and then."""
        tag, _, name = self.rng.choice(what.split("|")).partition(" ")
        draw = self.rng.random()
        if name and draw < 0.2:
            name = "" if draw < 0.1 else "".join(self.rng.choices("abcdefgh", k=5))
        attr = f' id="{name[3:]}"' if name.startswith("id=") else f' class="{name}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def linked(self, label: int, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{self.said(label, self.rng.randint(1, 4))}</a></li>' for _ in range(n)) + "</ul>"

    def other(self, kind: str) -> str:
        r = self.rng
        if kind in ("menu", "header"):
            inner = self.linked(0, r.randint(2, 8)) if r.random() < 0.8 else " ".join(f"<a href=x>{self.said(0, 1)}</a>" for _ in range(r.randint(2, 6)))
            inner += f"<h1>{self.said(0, 3)}</h1>" if kind == "header" and r.random() < 0.4 else ""
        elif kind == "comments":
            inner = f"<h3>{self.said(0, 2)}</h3>" + "".join(self.opened("div comment|li comment|div|p", self.said(0, r.randint(3, 50))) for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{self.said(0, 2)}</label><input><p>{self.said(0, r.randint(2, 12))}</p><button>x</button>"
        elif kind == "side":
            inner = f"<h3>{self.said(0, 2)}</h3>" + (self.linked(0, r.randint(2, 6)) if r.random() < 0.6 else f"<p>{self.said(0, r.randint(5, 40))}</p>")
        else:
            inner = self.said(0, r.randint(2, 30)) if r.random() < 0.6 else f"<p>{self.said(0, r.randint(2, 30))}</p>"
        return self.opened(OTHERS[kind], inner)

    def article(self) -> str:
        r, parts = self.rng, []
        for _ in range(r.randint(1, 14)):
            draw = r.random()
            end = "" if r.random() < 0.15 else "</p>"
            if draw < 0.75:
                parts.append(f"<p>{self.said(1, r.randint(1, 90))}{end}")
            elif draw < 0.83:
                parts.append(f"<h2>{self.said(1, r.randint(1, 6))}</h2>")
            elif draw < 0.91:
                parts.append("<ul>" + "".join(f"<li>{self.said(1, r.randint(1, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif draw < 0.96:
                parts.append(f"<blockquote><p>{self.said(1, r.randint(4, 40))}</p></blockquote>")
            else:
                parts.append(self.other(r.choice(["advert", "notice", "side", "form"])))
        head = f"<h1>{self.said(1, r.randint(2, 10))}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        return self.opened(MAIN, head + "".join(parts))

    def page(self) -> str:
        r = self.rng
        before = [self.other(k) for k in ("notice", "header", "menu", "advert", "side", "form") if r.random() < 0.45]
        after = [self.other(k) for k in ("advert", "side", "form", "comments", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = self.opened(SHELLS, body)
        return body + (self.other("footer") if r.random() < 0.5 else "")


def made_page(maker: Maker) -> tuple[np.ndarray, np.ndarray] | None:
    """Vectors and labels of a made page."""
    page = leaves(maker.page())
    labels = np.array([MARK.get(leaf.text[0], 0) for leaf in page], np.float32)
    for leaf in page:
        leaf.text = leaf.text.translate(dict.fromkeys(map(ord, MARK))).strip() or "."
    return (vectors(page), labels) if page else None


def train(pages: Sequence[str], made: int = 700, epochs: int = 9, longest: int = 200) -> Labeller:
    """From pages that say what their article is, cut to pieces of up to `longest` leaves in training only, and from made ones."""
    known, said = [], []
    for html in pages:
        page = leaves(html)
        if any(leaf.inside == "main" for leaf in page):
            v, y = vectors(page), np.array([leaf.inside == "main" for leaf in page], np.float32)
            known += [(v[k : k + longest], y[k : k + longest]) for k in range(0, len(page), longest)]
        said += [leaf.text for leaf in page if len(leaf.text) > 80]
    maker = Maker(said)
    known += [p for p in (made_page(maker) for _ in range(made)) if p]
    return Labeller().fit(known, epochs)


def learn(pages: DataFrame, sample: int = 300, most_chars: int = 60_000, html_col: str = "html", url_col: str = "url") -> bytes:
    """A labeller's weights, trained in one task on at most `sample` pages of up to `most_chars` characters, those first by hash.

    The bound holds for learning only; no page is left out or cut when texts are extracted.
    """
    rows = pages.select(F.xxhash64(url_col, F.octet_length(html_col)).alias("h"), F.col(html_col).alias("html")).filter(F.length("html") <= most_chars)
    narrow = rows.select("h").orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h
    some = rows.filter(F.col("h") <= F.lit(narrow)) if narrow is not None else rows
    some = some.select("h", F.xxhash64("html").alias("g"), "html").orderBy("h", "g").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row["h"], row["g"], row["html"]) for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([train([html for *_, html in found]).dump()], pa.binary())], ["weights"])

    return some.repartition(1).mapInArrow(run, "weights binary").first().weights


@functools.lru_cache(maxsize=2)
def _loaded(weights: bytes) -> Labeller:
    return Labeller.load(weights)


def blocks(pages: DataFrame, weights: bytes, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, the texts of all its leaves, and the probability of each.

    A null or empty html has no leaves; repeated rows and null ids stay; pages of any length are read whole; other columns are ignored.
    """
    names = [id_col, url_col, "leaves", "shares"]
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in cut(batches, 64):
            read = [leaves(html) for html in texts(batch.column(2))]
            shares = model.shares([vectors(page) for page in read])
            said = pa.array([[leaf.text for leaf in page] for page in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), said, pa.array(shares, pa.list_(pa.float32()))], names)

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, leaves array<string>, shares array<float>")


def main_texts(pages: DataFrame, weights: bytes, least: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (the leaves of `least` probability or more, in page order, joined by an empty line; '' if none), n_chars.

    An empty table gives an empty result; see `blocks` for the rest.
    """
    kept = F.transform(F.filter(F.arrays_zip("leaves", "shares"), lambda x: x["shares"] >= least), lambda x: x["leaves"])
    said = blocks(pages, weights, id_col, url_col, html_col).select(id_col, url_col, F.array_join(kept, "\n\n").alias("text"))
    return said.withColumn("n_chars", F.length("text").cast("long"))
