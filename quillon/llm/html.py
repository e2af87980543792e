"""Main text of web pages, by a recurrent labeller of their blocks.

A page becomes the sequence of its blocks: the text between the tags that end one,
with the path of open elements above it. A block's vector holds hashed names,
classes and ids of its path, its hashed words, and a few measures. A bidirectional
LSTM in numpy reads the whole sequence both ways and says of each block, in the
context of all the others, whether it belongs to the article.

The labeller is trained here, on pages that ``synthetic_pages`` makes up from a seed:
articles in many kinds of markup between menus, notices, adverts, forms, sidebars,
footers and comments, of invented words, each block labelled by what made it. No
page of the input is used, so the same input always gives the same text. The weights
that training gives are of a fixed size and stored beside this module;
``np.savez_compressed(WEIGHTS, **train().weights)`` makes them again in some seconds.

A null page has the empty text and no blocks, as have pages without text. Pages are
read whole, however long; broken markup is read as far as it goes. Repeated rows give
equal results; other columns pass through.
"""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free_name, texts

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 24, 8, 24
DIM = PATH_DIM + WORD_DIM + MEASURES
#: Pages of a batch, and blocks of a batch, that a task labels at once.
BATCH_PAGES, BATCH_BLOCKS = 128, 16_384
#: Elements and words of earlier pages that a task keeps.
KNOWN = 20_000

# Fixed values of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
}
SCOPES = frozenset("article aside blockquote body button div fieldset footer form header main nav ol section table td th ul".split())

#: Text, and the tag behind it if that is a plain one: no quoted value has an angle bracket.
_PAIR = re.compile(r"""([^<]*+)(?:<(/?)([a-zA-Z][^\s/<>]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+)*+)>)?""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
#: What ends a tag, or begins a quoted value in it.
_SPECIAL = re.compile(r"""[<>]|=\s*+["']""")
#: Elements whose content is no text of the page, and where they end.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in ("script", "style", "noscript", "template", "svg", "iframe", "object")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Element:
    """An open element, its names (tag, classes, ids, role), and the one above it; paths share their upper parts."""

    __slots__ = ("above", "names", "vector")

    def __init__(self, names: tuple[str, ...], above: Element | None) -> None:
        self.names, self.above = names, above
        self.vector: np.ndarray | None = None


class Block:
    """A piece of text, the element that it stands in, how many of its characters are in links, and the vector of its path."""

    __slots__ = ("element", "linked", "text", "vector")

    def __init__(self, text: str, element: Element | None, linked: int, vector: np.ndarray) -> None:
        self.text, self.element, self.linked, self.vector = text, element, linked, vector

    @property
    def path(self) -> tuple[str, ...]:
        """All names from the outermost element to the block's own."""
        out: list[tuple[str, ...]] = []
        at = self.element
        while at is not None:
            out.append(at.names)
            at = at.above
        return tuple(x for names in reversed(out) for x in names)


class Path:
    """The open elements of a page, with the vector of the path kept up to date.

    Opening and closing an element costs what the element itself has, however deep it
    lies: ``scopes`` counts the open elements by tag between one scoping element and
    the next, so nothing is searched for that is not there.
    """

    def __init__(self, known: dict[tuple[str, ...], tuple[tuple[str, int, int], ...]]) -> None:
        self.known = known
        self.tags: list[str] = []
        self.top: Element | None = None
        self.scopes: list[dict[str, int]] = [{}]
        self.open: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.sums = [0] * PATH_DIM
        self.nothing = np.zeros(PATH_DIM, dtype=np.float32)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.top = Element(names, self.top)
        self.tags.append(tag)
        if tag in SCOPES:
            self.scopes.append({})
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        self.open[tag] = self.open.get(tag, 0) + 1
        if (features := self.known.get(names)) is None:
            features = self.known[names] = _features(names)
        for token, at, sign in features:
            seen = self.tokens.get(token, 0)
            self.tokens[token] = seen + 1
            if not seen:  # a path has each of its tokens once
                self.sums[at] += sign

    def pop(self) -> str:
        tag, names = self.tags.pop(), self.top.names
        self.top = self.top.above
        self.open[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        for token, at, sign in self.known[names]:
            self.tokens[token] -= 1
            if not self.tokens[token]:
                del self.tokens[token]
                self.sums[at] -= sign
        return tag

    def end(self, tag: str) -> None:
        """An end tag closes the nearest element of its name and all in it, if there is one."""
        if self.open.get(tag):
            while self.pop() != tag:
                pass

    def close(self, tag: str) -> None:
        """What a start tag closes, if it is open in the same scope."""
        if self.scopes[-1].get(tag):
            while self.pop() != tag:
                pass

    def vector(self) -> np.ndarray:
        """Hashed tokens of the path, and once more the last name of its last element."""
        if self.top is None:
            return self.nothing
        if self.top.vector is None:
            self.top.vector = np.array(self.sums, dtype=np.float32)
            at, sign = _place(f"leaf {self.top.names[-1]}")
            self.top.vector[at] += sign
        return self.top.vector


def _features(names: tuple[str, ...]) -> tuple[tuple[str, int, int], ...]:
    """The tokens of an element: its names and their parts, each with its place in the vector and its sign."""
    tokens = set(names)
    for name in names:
        tokens.update(p for p in re.split(r"[-_.]+", name) if len(p) > 1)
    return tuple((t, *_place(t)) for t in sorted(tokens))


def _place(token: str) -> tuple[int, int]:
    h = crc32(token.encode())
    return h % PATH_DIM, 1 if h >> 31 else -1


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, end, name, rest) for each text and each tag, in time linear in the page; comments, declarations and raw elements are skipped.

    A quoted value runs to its closing quote, whatever it holds. A tag that meets another
    ``<`` before its end, or whose quote is never closed, ends at the next ``>`` before
    any ``<``; where there is none, its ``<`` is text. One that the page ends in is skipped.
    """
    at, n, last = 0, len(page), page.rfind(">")
    dead: set[int] = set()  # quotes from which no tag comes to its end
    while at < n:
        m = _PAIR.match(page, at)
        text, end, name, rest = m.groups()
        if text:
            yield text, "", "", ""
        begin, at = m.end(1), m.end()
        if name is None:
            if begin == n:
                return
            if page.startswith("<!--", begin):
                stop = page.find("-->", begin + 2)
                at = n if stop < 0 else stop + 3
                continue
            if (m := _NAME.match(page, begin)) is None:
                declared = page.startswith(("<!", "<?", "</"), begin)
                stop = page.find(">", begin) if declared and begin < last else -1
            else:
                end, name = m.groups()
                stop = _tag_end(page, m.end(), dead)
            if stop < 0:
                if begin > last and (m is not None or declared) and page.find("<", begin + 1) < 0:
                    return
                yield "<", "", "", ""
                at = begin + 1
                continue
            at = stop + 1
            if m is None:
                continue
            rest = page[m.end() : stop]
        name = name.lower()
        if not end and name in RAW:
            if name == "svg" and rest.endswith("/"):
                continue
            close = RAW[name].search(page, at)
            stop = page.find(">", close.end()) if close else -1
            at = n if stop < 0 else stop + 1
            continue
        yield "", end, name, rest


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag's ``>`` stands, or -1; every quote that fails is looked at once."""
    begin, seen = at, []
    while (m := _SPECIAL.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        quote = m.end() - 1
        if m[0] == "<" or quote in dead or (closing := page.find(page[quote], quote + 1)) < 0:
            seen.append(quote)
            break
        seen.append(quote)
        at = closing + 1
    dead.update(seen)
    other = page.find("<", begin)
    return page.find(">", begin, other) if other >= 0 else page.find(">", begin)


def blocks(page: str | None, known: dict | None = None) -> list[Block]:
    """The blocks of a page in its order, white space made one space; ``known`` keeps what elements of earlier pages add to a path."""
    out: list[Block] = []
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    path = Path(known)
    held: list[str] = []
    linked = 0
    element, vector = path.top, path.nothing

    def end_block() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(text, element, linked, vector))
            held.clear()
        linked = 0

    for text, end, name, rest in tokens(page or ""):
        if text:
            if not held:
                element, vector = path.top, path.vector()
            held.append(text)
            linked += len(text) if path.open.get("a") else 0
            continue
        if name not in INLINE:
            end_block()
        if end:
            path.end(name)
        elif name not in VOID:
            for closed in CLOSES.get(name, ()):
                path.close(closed)
            more = [v for x in _NAMES.findall(rest) for v in "".join(x).lower().split()] if "=" in rest else []
            path.push(name, (name, *(f".{v}" for v in more)))
    end_block()
    return out


def vectors(page: list[Block], known: dict[str, int]) -> np.ndarray:
    """One row a block; ``known`` keeps the places of words."""
    if len(known) > KNOWN:
        known.clear()
    out = np.zeros((len(page), DIM), dtype=np.float32)
    for k, b in enumerate(page):
        words = b.text.split(" ")
        out[k, :PATH_DIM] = b.vector
        places = [known[w] if w in known else known.setdefault(w, crc32(w.encode()) % WORD_DIM) for w in words]
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(places, minlength=WORD_DIM) / np.sqrt(len(words)) / 4
        n = len(b.text)
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 4,
            np.log1p(n) / 6,
            b.linked / n if n else 0.0,
            min(1.0, sum(map(b.text.count, ".!?")) * 8 / len(words)),
            b.text[-1] in ".!?:",
            k / len(page),
            (len(page) - 1 - k) / len(page),
            1.0,
        )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic unit on both states; weights as plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 0) -> None:
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {}
            for way in "fb":
                weights[f"w{way}"] = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 4 * HIDDEN))
                weights[f"u{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
                weights[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
            weights["v"] = rng.normal(0, 0.1, 2 * HIDDEN + DIM)
            weights["d"] = np.zeros(1)
        self.weights = {k: np.asarray(x, dtype=np.float32) for k, x in weights.items()}

    def _one_way(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        w, u, c = (self.weights[f"{k}{way}"] for k in "wuc")
        n, steps, _ = x.shape
        inputs = x @ w + c
        h = cell = np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.zeros((n, steps, HIDDEN), dtype=np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            gates = inputs[:, t] + h @ u
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            on = mask[:, t, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, h, cell, i, f, o, g, squashed, on))
            cell = np.where(on, new, cell)
            h = np.where(on, o * squashed, h)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._one_way("f", x, mask), self._one_way("b", x, mask), x], axis=2)
        return both @ self.weights["v"] + self.weights["d"][0]

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks belong to the article."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < BATCH_PAGES and (end - at + 1) * len(pages[order[end]]) <= BATCH_BLOCKS:
                end += 1
            some = [pages[k] for k in order[at:end]]
            x, mask = _padded(some)
            for k, row, page in zip(order[at:end], self.scores(x, mask) if x.shape[1] else x, some, strict=True):
                out[k] = row[: len(page)] > 0 if len(page) else np.zeros(0, dtype=bool)
            at = end
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of a batch and its gradients, back through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._one_way(way, x, mask, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"], x], axis=2)
        score = both @ self.weights["v"] + self.weights["d"][0]
        p = _sigmoid(score)
        total = mask.sum()
        loss = float(-(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / total)
        error = (p - y) * mask / total
        out = {"v": np.einsum("nt,ntd->d", error, both), "d": error.sum().reshape(1)}
        for k, way in enumerate("fb"):
            u = self.weights[f"u{way}"]
            from_score = error[:, :, None] * self.weights["v"][k * HIDDEN : (k + 1) * HIDDEN]
            dh = dc = np.zeros((len(x), HIDDEN), dtype=np.float32)
            of_gates = np.zeros((len(x), x.shape[1], 4 * HIDDEN), dtype=np.float32)
            du = np.zeros_like(u)
            for t, h, cell, i, f, o, g, squashed, on in reversed(kept[way]):
                dh = dh + from_score[:, t]
                dh_on, dc_on = np.where(on, dh, 0), np.where(on, dc, 0)
                dnew = dc_on + dh_on * o * (1 - squashed**2)
                dgates = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), dh_on * squashed * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                of_gates[:, t] = dgates
                du += h.T @ dgates
                dh = np.where(on, dgates @ u.T, dh)
                dc = np.where(on, dnew * f, dc)
            out |= {f"u{way}": du, f"w{way}": np.einsum("ntd,ntg->dg", x, of_gates), f"c{way}": of_gates.sum(axis=(0, 1))}
        return loss, out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages), default=0)
    x = np.zeros((len(pages), longest, DIM), dtype=np.float32)
    mask = np.zeros((len(pages), longest), dtype=bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


#: The weights that ``train`` gives by its defaults, so that they need not be found again at each start.
WEIGHTS = pathlib.Path(__file__).with_name("html_weights.npz")


@lru_cache(1)
def trained() -> Labeller:
    """The labeller with the stored weights, or trained anew where they are not there."""
    if not WEIGHTS.exists():
        return train()
    with np.load(WEIGHTS) as stored:
        return Labeller(dict(stored))


def train(n_pages: int = 600, epochs: int = 14, seed: int = 1) -> Labeller:
    """A labeller trained by Adam on ``n_pages`` synthetic pages."""
    rng = np.random.default_rng(seed)
    known: dict = {}
    made = [(vectors(found, known), labels) for found, labels in synthetic_pages(n_pages, seed)]
    model = Labeller(seed=seed)
    first = {k: np.zeros_like(w) for k, w in model.weights.items()}
    second = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(made)), max(1, len(made) // 24)):
            x, mask = _padded([made[k][0] for k in at])
            y = np.zeros(mask.shape, dtype=np.float32)
            for row, k in enumerate(at):
                y[row, : len(made[k][1])] = made[k][1]
            _, slope = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * 0.8**epoch
            for k, g in slope.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = (model.weights[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


class _Maker:
    """Makes up one page: markup in which every text begins with a mark of its label."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.syllables = ["".join(rng.choice(list("abcdefghijklmnoprstuvwäéñ"), rng.integers(1, 4))) for _ in range(40)]

    def one(self, *of: str) -> str:
        return of[self.rng.integers(len(of))]

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(self.syllables[k] for k in r.integers(0, 40, r.integers(1, 4))) for _ in range(r.integers(low, high + 1))]
        return " ".join(w + (r.choice([".", ","]) if r.random() < 0.12 else "") for w in out).capitalize() + r.choice([".", "", "."])

    def said(self, label: int, low: int, high: int) -> str:
        text = f"\x01{label}" + self.words(low, high)
        return f"<{t}>{text}</{t}>" if self.rng.random() < 0.12 and (t := self.one("b", "em", "strong", "span", "i")) else text

    def named(self, *names: str) -> str:
        return f' {self.one("class", "class", "id")}="{self.one(*names)}"'

    def links(self, label: int = 0, least: int = 3) -> str:
        items = [f'<a href="/{k}">{self.said(label, 1, 3)}</a>' for k in range(self.rng.integers(least, 10))]
        style = self.rng.integers(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if style == 1 else "<p>" + " | ".join(items) + "</p>"

    def prose(self, label: int, low: int, high: int, tag: str = "p") -> str:
        out = []
        for _ in range(self.rng.integers(low, high + 1)):
            size = (1, 6) if self.rng.random() < 0.2 else (6, 60)
            style = self.rng.random()
            if style < 0.12:
                out.append(f"<{tag}><b>{self.said(label, *size)}<br><{tag}>{self.said(label, *size)}</{tag}>")  # left open
            elif style < 0.2:
                out.append(f"<{tag}>{self.said(label, *size)}")
            else:
                out.append(f"<{tag}>{self.said(label, *size)}</{tag}>")
        return "".join(out)

    def boiler(self) -> str:
        """Something that may stand before, in or behind an article."""
        k = self.rng.integers(9)
        if k == 0:
            return f"<div{self.named('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'promo', 'banner')}>{self.one(self.said(0, 4, 30), self.prose(0, 1, 2))}</div>"
        if k == 1:
            return f"<aside{self.one('', self.named('sidebar', 'related', 'widget'))}>{self.one(self.links(), self.prose(0, 1, 3))}</aside>"
        if k == 2:
            return f"<div{self.named('sidebar', 'side', 'secondary', 'widget-area', 'related', 'recommended', 'trending')}><h3>{self.said(0, 1, 4)}</h3>{self.links()}</div>"
        if k == 3:
            return f"<div{self.named('cookie', 'cookie-notice', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'newsletter')}>{self.one(self.said(0, 5, 30), self.prose(0, 1, 2))}<button>{self.said(0, 1, 2)}</button></div>"
        if k == 4:
            return f"<form{self.one('', self.named('search', 'login', 'subscribe', 'contact'))}><label>{self.said(0, 1, 4)}</label><input><select><option>{self.said(0, 1, 2)}<option>{self.said(0, 1, 2)}</select><button>{self.said(0, 1, 3)}</button></form>"
        if k == 5:
            return f"<div{self.named('share', 'social', 'share-buttons', 'tags', 'toolbar')}>{self.links()}</div>"
        if k == 6:
            return f"<div{self.named('breadcrumb', 'breadcrumbs', 'pagination', 'pager')}>{self.links()}</div>"
        if k == 7:
            return f'<div role="{self.one("complementary", "navigation", "banner", "search", "alert", "dialog")}">{self.one(self.links(), self.prose(0, 1, 2))}</div>'
        return f"<nav>{self.links()}</nav>"

    def comments(self) -> str:
        items = []
        for _ in range(self.rng.integers(1, 6)):
            inner = self.one(self.said(0, 3, 40), self.prose(0, 1, 2))
            items.append(self.one(f'<div class="comment"><span>{self.said(0, 1, 2)}</span>{inner}</div>', f'<li class="comment">{inner}</li>', f'<article class="comment">{inner}</article>'))
        return f"<{(t := self.one('section', 'div', 'ol'))}{self.named('comments', 'comment-list', 'commentlist', 'discussion', 'responses', 'disqus')}><h3>{self.said(0, 1, 3)}</h3>{''.join(items)}</{t}>"

    def article(self) -> str:
        parts = []
        if self.rng.random() < 0.8:
            parts.append(f"<h1>{self.said(1, 2, 12)}</h1>")
        for _ in range(self.rng.integers(1, 6)):
            k = self.rng.random()
            if k < 0.65:
                parts.append(self.prose(1, 1, 8))
            elif k < 0.72:
                parts.append(f"<h2>{self.said(1, 1, 8)}</h2>" + self.prose(1, 1, 3))
            elif k < 0.79:
                parts.append("<ul>" + "".join(f"<li>{self.said(1, 2, 20)}</li>" for _ in range(self.rng.integers(2, 6))) + "</ul>")
            elif k < 0.84:
                parts.append(f"<blockquote>{self.one(self.said(1, 5, 30), self.prose(1, 1, 2))}</blockquote>")
            elif k < 0.88:
                parts.append("<table>" + "".join(f"<tr><td>{self.said(1, 1, 6)}<td>{self.said(1, 1, 6)}" for _ in range(self.rng.integers(1, 5))) + "</table>")
            elif k < 0.92:
                parts.append(f"<pre>{self.said(1, 3, 20)}</pre>")
            elif k < 0.96:
                parts.append(f"<figure><img><figcaption>{self.said(1, 3, 12)}</figcaption></figure>")
            else:
                parts.append(self.prose(1, 1, 3, "div"))
            if self.rng.random() < 0.15:
                parts.append(self.boiler())
        text = "".join(parts)
        k = self.rng.random()
        if k < 0.5:
            return f"<article{self.one('', '', self.named('post', 'entry', 'story', 'hentry'))}>{text}</article>"
        if k < 0.65:
            return f"<main{self.one('', self.named('content', 'main'))}>{text}</main>"
        return f"<{(t := self.one('div', 'section'))}{self.named('content', 'main', 'post', 'entry-content', 'article-body', 'post-body', 'story', 'body-text', 'main-content', 'text')}>{text}</{t}>"

    def page(self) -> str:
        top = [self.one(f"<nav>{self.links()}</nav>", f"<header>{self.said(0, 1, 5)}{self.links()}</header>", f"<div{self.named('header', 'masthead', 'menu', 'navbar', 'topbar', 'site-header')}>{self.links()}</div>", "")]
        top += [self.boiler() for _ in range(self.rng.integers(0, 3))]
        end = [self.boiler() for _ in range(self.rng.integers(0, 3))]
        if self.rng.random() < 0.35:
            end.insert(0, self.comments())
        end.append(self.one(f"<footer>{self.one(self.said(0, 2, 20), self.links(), self.prose(0, 1, 2))}</footer>", f"<div{self.named('footer', 'site-footer', 'colophon', 'copyright', 'legal', 'bottom')}>{self.one(self.said(0, 2, 20), self.links())}</div>", ""))
        body = "".join(top) + self.article() + "".join(end)
        if self.rng.random() < 0.3:
            body = f"<div{self.named('wrapper', 'page', 'container', 'site', 'layout')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.said(0, 2, 10)}</title></head><body>{body}</body></html>"


def synthetic_pages(n: int, seed: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages and whether each belongs to the article."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        found = blocks(_Maker(rng).page())
        labels = np.array([b.text.lstrip("| ")[1:2] == "1" for b in found], dtype=np.float32)
        for b in found:
            b.text = re.sub("\x01.", "", b.text) or "."
        yield found, labels


_TEXT = pa.struct([("text", pa.string()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())])


def main_text(pages: DataFrame, html: str = "html", name: str = "main") -> DataFrame:
    """``pages`` with a struct column: the article's text, blocks of the page, blocks kept."""
    name = free_name(pages, name)
    known = pages.sparkSession.sparkContext.broadcast(trained().weights)

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, elements, places = Labeller(known.value), {}, {}
        for batch in batches:
            rows = []
            for part in texts(batch):
                found = [blocks(p, elements) for p in part]
                for page, keep in zip(found, model.labels([vectors(p, places) for p in found]), strict=True):
                    rows.append({"text": " ".join(b.text for b, k in zip(page, keep.tolist(), strict=True) if k), "n_blocks": len(page), "n_kept": int(keep.sum())})
            yield pa.array(rows, _TEXT)

    return pages.withColumn(name, F.arrow_udf(extract, "struct<text:string,n_blocks:int,n_kept:int>")(F.col(html)))
