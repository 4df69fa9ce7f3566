"""Main text of web pages by a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks of text. A block is seen by the tags, classes
and ids on its path, by its hashed words and by a few proportions; a bidirectional LSTM in
numpy reads the whole sequence both ways and says of every block whether it belongs to the
article. It is trained here: on pages laid out at random from a small grammar that knows what
is article and what is not, and on a bounded sample of the given pages, as far as their
own mark-up says so (an ``article`` or ``main`` element).
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm import common

#: Elements that stand within a line of text, that have no content, whose
#: content is no text of the page, and before which an open paragraph ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table article section div body select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATHS, WORDS = 1024, 2048


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@dataclass
class Block:
    text: str
    path: frozenset[str]
    leaf: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of text of a whole page, in page order, references decoded.

    Unclosed and stray tags are taken as browsers mostly do; an unclosed script, style or
    comment reaches to the end of the page."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, frozenset[str]]] = []
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            at = next((e for e in reversed(stack) if e[0] not in INLINE), ("", frozenset()))
            out.append(Block(text, at[1], at[0], min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        links -= sum(1 for name, _ in stack[upto:] if name == "a")
        del stack[upto:]

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = token.end()
        name = token[3]
        if not name:
            continue
        name = name.lower()
        if token[2]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                # A stray inline end tag does not close what is around it.
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P or name in ALIKE:
            stop = ALIKE.get(name, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    close(k)
                    break
                if stack[k][0] in HOLDERS:
                    break
        if name in VOID:
            continue
        path = stack[-1][1] if stack else frozenset()
        own = {name} if name not in INLINE else set()
        for named in _NAMED.finditer(token[4] or ""):
            own.update(p.lower() for p in _PART.findall(named[1] or named[2] or named[3] or ""))
        stack.append((name, path if own <= path else path | own))
        links += name == "a"
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


PROPORTIONS = 9


class Reader:
    """Turns a page's blocks into numbers: path buckets, leaf bucket, word buckets, proportions."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[str, int] = {}

    def read(self, page: list[Block]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
        paths, leaves, words, rest = [], [], [], []
        for k, b in enumerate(page):
            for p in b.path:
                if p not in self.paths:
                    self.paths[p] = _bucket(p, PATHS)
            paths.append(np.array(sorted({self.paths[p] for p in b.path}) or [0], np.int32))
            leaves.append(_bucket(b.leaf, PATHS))
            tokens = b.text.lower().split()
            if len(self.words) > 500_000:
                self.words.clear()
            for w in tokens:
                if w not in self.words:
                    self.words[w] = _bucket(w, WORDS)
            words.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
            n = len(b.text)
            rest.append([
                np.log1p(n) / 5, np.log1p(len(tokens)) / 4, b.linked / n, sum(map(b.text.count, ".!?")) / len(tokens), float(b.text[-1] in ".!?"),
                sum(map(str.isdigit, b.text)) / n if n < 200 else 0.0, k / len(page), float(b.text[0].isupper()), 1.0,
            ])
        return paths, np.array(leaves, np.int32), words, np.array(rest, np.float64).reshape(-1, PROPORTIONS)


@dataclass(frozen=True)
class Params:
    """pages, laid: given pages and laid-out pages to train on; hidden: cells each way."""

    pages: int = 500
    laid: int = 900
    path_width: int = 16
    word_width: int = 8
    hidden: int = 16
    epochs: int = 10
    batch: int = 16
    rate: float = 0.01
    seed: int = 13


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: what both directions know of a block, and the block itself, decide.

    Weights are plain arrays, so it travels to tasks as it is."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(p.seed)
        d, h = 2 * p.path_width + p.word_width + PROPORTIONS, p.hidden
        self.p = p
        self.w = {"path": rng.normal(0, 0.3, (PATHS, p.path_width)), "leaf": rng.normal(0, 0.3, (PATHS, p.path_width)), "word": rng.normal(0, 0.1, (WORDS, p.word_width)), "out": rng.normal(0, 0.2, 2 * h), "own": np.zeros(d), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.w |= {f"x{way}": rng.normal(0, 1 / np.sqrt(d), (d, 4 * h)), f"h{way}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}

    def _inputs(self, page) -> np.ndarray:
        paths, leaves, words, rest = page
        mean = lambda table, parts: np.add.reduceat(table[np.concatenate(parts)], np.cumsum([0, *map(len, parts[:-1])]), axis=0) / np.array([[len(x)] for x in parts])
        return np.hstack([mean(self.w["path"], paths), self.w["leaf"][leaves], mean(self.w["word"], words), rest])

    @staticmethod
    def _reverse(x: np.ndarray, lengths) -> np.ndarray:
        out = x.copy()
        for k, n in enumerate(lengths):
            out[k, :n] = x[k, :n][::-1]
        return out

    def _run(self, x: np.ndarray, way: str, keep: bool):
        b, t, _ = x.shape
        h = self.p.hidden
        pre = x @ self.w[f"x{way}"] + self.w[f"c{way}"]
        hs, cs, gs = np.zeros((t + 1, b, h)), np.zeros((t + 1 if keep else 1, b, h)), np.zeros((t if keep else 0, b, 4 * h))
        c = np.zeros((b, h))
        for k in range(t):
            z = pre[:, k] + hs[k] @ self.w[f"h{way}"]
            g = _sigmoid(z)
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            c = g[:, h : 2 * h] * c + g[:, :h] * g[:, 3 * h :]
            hs[k + 1] = g[:, 2 * h : 3 * h] * np.tanh(c)
            if keep:
                gs[k], cs[k + 1] = g, c
        return hs, cs, gs

    def _back(self, x, way, hs, cs, gs, dh_out, grads):
        b, t, _ = x.shape
        h = self.p.hidden
        dh, dc, dz_all = np.zeros((b, h)), np.zeros((b, h)), np.zeros((b, t, 4 * h))
        for k in range(t - 1, -1, -1):
            g, th = gs[k], np.tanh(cs[k + 1])
            d = dh + dh_out[:, k]
            dc = dc + d * g[:, 2 * h : 3 * h] * (1 - th**2)
            dz = np.hstack([dc * g[:, 3 * h :], dc * cs[k], d * th, dc * g[:, :h]])
            dz[:, : 3 * h] *= g[:, : 3 * h] * (1 - g[:, : 3 * h])
            dz[:, 3 * h :] *= 1 - g[:, 3 * h :] ** 2
            dc = dc * g[:, h : 2 * h]
            dh = dz @ self.w[f"h{way}"].T
            dz_all[:, k] = dz
        flat = dz_all.reshape(-1, 4 * h)
        grads[f"x{way}"] = x.reshape(b * t, -1).T @ flat
        grads[f"h{way}"] = hs[:-1].transpose(1, 0, 2).reshape(b * t, h).T @ flat
        grads[f"c{way}"] = flat.sum(0)
        return dz_all @ self.w[f"x{way}"].T

    @staticmethod
    def _padded(inputs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(inputs), max(map(len, inputs)), inputs[0].shape[1]))
        for k, i in enumerate(inputs):
            x[k, : len(i)] = i
        return x

    def predict(self, pages: list) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, page in enumerate(pages) if len(page[1])), key=lambda k: len(pages[k][1]))
        at = 0
        while at < len(order):
            end = at + 1
            longest = len(pages[order[at]][1])
            while end < len(order) and end - at < 128 and len(pages[order[end]][1]) <= 1.2 * longest + 4:
                end += 1
            some = order[at:end]
            inputs = [self._inputs(pages[k]) for k in some]
            lengths = [len(i) for i in inputs]
            x = self._padded(inputs)
            forth = self._run(x, "f", False)[0][1:].transpose(1, 0, 2)
            back = self._reverse(self._run(self._reverse(x, lengths), "b", False)[0][1:].transpose(1, 0, 2), lengths)
            prob = _sigmoid(np.concatenate([forth, back], 2) @ self.w["out"] + x @ self.w["own"] + self.w["bias"])
            for row, k, n in zip(prob, some, lengths):
                out[k] = row[:n]
            at = end
        return out

    def fit(self, pages: list, labels: list[np.ndarray]) -> Labeller:
        """Adam on the cross entropy of all blocks, back through both directions."""
        rng = np.random.default_rng(self.p.seed)
        m, v, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(self.p.epochs):
            # Pages of like length in a batch, batches in random order.
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda k: len(labels[k]))
            batches = [order[at : at + self.p.batch] for at in range(0, len(order), self.p.batch)]
            for at in rng.permutation(len(batches)):
                some = batches[at]
                inputs = [self._inputs(pages[k]) for k in some]
                lengths = [len(i) for i in inputs]
                x = self._padded(inputs)
                turned = self._reverse(x, lengths)
                forth, back = self._run(x, "f", True), self._run(turned, "b", True)
                both = np.concatenate([forth[0][1:].transpose(1, 0, 2), self._reverse(back[0][1:].transpose(1, 0, 2), lengths)], 2)
                dz = _sigmoid(both @ self.w["out"] + x @ self.w["own"] + self.w["bias"])
                for row, k, n in zip(dz, some, lengths):
                    row[:n] = (row[:n] - labels[k]) / n
                    row[n:] = 0
                dz /= len(some)
                grads = {"out": (both * dz[:, :, None]).sum((0, 1)), "own": (x * dz[:, :, None]).sum((0, 1)), "bias": np.array([dz.sum()])}
                d_both = dz[:, :, None] * self.w["out"]
                h = self.p.hidden
                dx = self._back(x, "f", *forth, d_both[:, :, :h], grads)
                dx += self._reverse(self._back(turned, "b", *back, self._reverse(d_both[:, :, h:], lengths), grads), lengths)
                dx += dz[:, :, None] * self.w["own"]
                a, c = self.p.path_width, self.p.word_width
                for name in ("path", "leaf", "word"):
                    grads[name] = np.zeros_like(self.w[name])
                for row, k, n in zip(dx, some, lengths):
                    paths, leaves, words, _ = pages[k]
                    for name, parts, part in (("path", paths, row[:n, :a]), ("word", words, row[:n, 2 * a : 2 * a + c])):
                        counts = np.array([len(i) for i in parts])
                        np.add.at(grads[name], np.concatenate(parts), np.repeat(part / counts[:, None], counts, axis=0))
                    np.add.at(grads["leaf"], leaves, row[:n, a : 2 * a])
                step += 1
                rate = self.p.rate * (1 - 0.9 * epoch / self.p.epochs)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


#: Class and id words of parts that are no article, and of article bodies.
ASIDE = (
    ("nav", "menu navbar navigation breadcrumb breadcrumbs topnav tabs"), ("header", "header masthead banner topbar logo branding"),
    ("footer", "footer bottom colophon copyright legal"), ("aside", "sidebar widget rail related recommended trending popular tags archive"),
    ("div", "ad ads advert advertisement sponsor sponsored promo promotion banner"), ("div", "cookie cookies consent notice alert gdpr popup modal overlay disclaimer warning"),
    ("form", "search login signup newsletter subscribe contact form"), ("section", "comments comment reply replies respond discussion disqus thread feedback"),
    ("div", "share social follow buttons toolbar pagination pager skip"),
)
BODY = "content post entry article body main story text page prose single".split()
_ASIDE_WORDS = frozenset(w for _, words in ASIDE for w in words.split())
_NO_TAGS = frozenset("nav aside footer form button select head title".split())


def marked(page: list[Block]) -> np.ndarray | None:
    """What a page's own mark-up says of its blocks; None if it says nothing."""
    if not any({"article", "main"} & b.path for b in page):
        return None
    return np.array([bool({"article", "main"} & b.path) and not (_NO_TAGS & b.path or _ASIDE_WORDS & b.path) for b in page], float)


_STOCK = (
    "Home About Contact News Sports Login Register Search Subscribe Share Tweet Reply Comments Privacy Terms Cookies Copyright All rights reserved "
    "Read more Next Previous Advertisement Sponsored Related Popular Follow us Newsletter Sign up Menu Skip to content Accept Posted by Tags Archive"
).split()


def lay_out(rng: np.random.Generator, vocabulary: list[str]) -> tuple[str, list[tuple[str, int]]]:
    """A page from the grammar, and its texts with 1 for article and 0 for the rest."""
    truth: list[tuple[str, int]] = []
    pick = lambda items: items[int(rng.integers(len(items)))]

    def prose(low: int, high: int) -> str:
        words = [pick(vocabulary) for _ in range(int(rng.integers(low, high)))]
        odd = rng.random()
        if odd < 0.03:
            words = words[:1] * len(words) * int(rng.integers(1, 9))
        elif odd < 0.06:
            words = [w.upper() + pick(["", "!!", "***", "%", " |"]) for w in words]
        elif odd < 0.7:
            words[0] = words[0].capitalize()
            words[-1] += pick([".", ".", "!", "?"])
        return " ".join(words)

    def stock() -> str:
        return " ".join(pick(_STOCK) for _ in range(int(rng.integers(1, 5)))) if rng.random() < 0.6 else prose(1, 6)

    def said(text: str, label: int) -> str:
        truth.append((text, label))
        return html_lib.escape(text)

    def named(tag: str, words: list[str]) -> str:
        if not words or rng.random() < 0.1:
            return f"<{tag}>"
        name = pick(words)
        name = pick([name, name, f"{name}-{pick(['box', 'wrap', 'area', 'inner', 'list'])}", f"site-{name}", f"{name}{int(rng.integers(9))}"])
        return f'<{tag} {pick(["class", "class", "id"])}="{name}">'

    def paragraphs(label: int, low: int, high: int) -> str:
        out = []
        for _ in range(int(rng.integers(low, high))):
            kind = rng.random()
            if kind < 0.1:
                out.append(f"<h2>{said(prose(2, 8), label)}</h2>")
            elif kind < 0.18:
                out.append("<ul>" + "".join(f"<li>{said(prose(3, 15), label)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.23:
                out.append(f"<blockquote>{said(prose(5, 30), label)}</blockquote>")
            elif kind < 0.28:
                out.append("<table><tr>" + "".join(f"<td>{said(prose(1, 5), label)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<p>{said(prose(4, 60), label)}" + pick(["</p>", "</p>", "<br>", ""]))
        return "".join(out)

    def aside() -> str:
        tag, words = ASIDE[int(rng.integers(len(ASIDE)))]
        names = words.split()
        tag = tag if rng.random() < 0.7 else "div"
        open_ = named(tag, names) if tag != "div" else f'<div {pick(["class", "id"])}="{pick(names)}">'
        level = int(rng.integers(1, 5))
        title = f"<h{level}>{said(stock(), 0)}</h{level}>" if rng.random() < 0.35 else ""
        kind = rng.random()
        if "comments" in names or kind < 0.25:
            inner = paragraphs(0, 1, 5)
        elif kind < 0.65:
            inner = "<ul>" + "".join(f'<li><a href="/x">{said(stock(), 0)}</a></li>' for _ in range(int(rng.integers(2, 8)))) + "</ul>"
        else:
            inner = said(prose(3, 25), 0)
        return f"{open_}{title}{inner}</{tag}>"

    out = [f"<!DOCTYPE html><html><head><title>{said(prose(3, 10), 0)}</title></head><body>"]
    out += [aside() for _ in range(int(rng.integers(1, 4)))]
    # Without a telling container, only what is around the article tells it.
    tag = pick(["article", "main", "article", "div", "div", "section"])
    open_ = f'<{tag} {pick(["class", "id"])}="{pick(BODY)}">' if tag in ("div", "section") else named(tag, BODY)
    wrap = rng.random() < 0.3
    out.append("<div class=wrapper>" * wrap + open_ + (f"<h1>{said(prose(2, 10), 1)}</h1>" if rng.random() < 0.9 else ""))
    out.append(paragraphs(1, 1, 7) if rng.random() < 0.95 else paragraphs(1, 20, 150))
    if rng.random() < 0.35:
        out.append(aside())
        out.append(paragraphs(1, 1, 5))
    if rng.random() < 0.25:
        out.append(aside())
    out.append(f"</{tag}>" + "</div>" * wrap)
    out += [aside() for _ in range(int(rng.integers(1, 4)))]
    return "".join(out) + "</body></html>", truth


def fit(pages: DataFrame, p: Params = Params()) -> Labeller:
    """Train on laid-out pages and on a bounded sample of ``pages`` (page_id, html).

    Blocks, not pages, come to the driver, and of them only their bucket numbers."""
    ids = common.smallest_ids(pages.select("page_id"), p.pages, p.seed)
    schema = "sizes array<int>, paths array<int>, path_sizes array<int>, leaves array<int>, words array<int>, rest array<double>, labels array<double>, texts array<string>"

    def read(batches):
        reader = Reader()
        for batch in batches:
            rows = []
            for page in batch["html"]:
                page = blocks(page)
                label = marked(page)
                if label is not None:
                    paths, leaves, words, rest = reader.read(page)
                    some = sorted({w for b in page[:50] for w in b.text.split()[:50]})[:20]
                    rows.append(([len(w) for w in words], np.concatenate(paths), [len(x) for x in paths], leaves, np.concatenate(words), rest.ravel(), label, some))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    rows = common.having(pages.select("page_id", "html"), "page_id", sorted(ids)).mapInPandas(read, schema).toPandas()
    # One order, whatever task a row came from.
    rows = rows.iloc[sorted(range(len(rows)), key=lambda k: (zlib.crc32(rows["words"].iloc[k].tobytes()), len(rows["words"].iloc[k])))] if len(rows) else rows
    split = lambda flat, sizes: np.split(np.asarray(flat), np.cumsum(sizes)[:-1])
    examples = [(split(r.paths, r.path_sizes), np.asarray(r.leaves), split(r.words, r.sizes), np.asarray(r.rest).reshape(-1, PROPORTIONS)) for r in rows.itertuples()]
    labels = [np.asarray(r.labels) for r in rows.itertuples()]
    rng, reader = np.random.default_rng(p.seed), Reader()
    vocabulary = sorted({w for r in rows.itertuples() for w in r.texts}) or "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    for _ in range(p.laid):
        page, truth = lay_out(rng, vocabulary)
        found = blocks(page)
        known = dict((" ".join(t.split()), label) for t, label in truth)
        examples.append(reader.read(found))
        labels.append(np.array([known.get(b.text, 0) for b in found], float))
    return Labeller(p).fit(examples, labels)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page: its article blocks joined by a blank.

    ``pages`` has page_id, url and html; other columns are not read. Null, empty and
    textless pages have an empty text. Rows are kept as they are, repeated ones too.
    """

    def run(batches):
        reader = Reader()
        for batch in batches:
            pages_ = [blocks(page) for page in batch["html"]]
            prob = model.predict([reader.read(page) for page in pages_])
            text = [" ".join(b.text for b, q in zip(page, row) if q >= 0.5) for page, row in zip(pages_, prob)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    found = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", common.as_id(F.col("page_id")))
