"""Main text of web pages by a tree-structured graphical model over the DOM, with sum-product messages up and down.

A page becomes a tree of block elements with runs of text between their tags as leaves. Each node is content or not: its features
give a potential by counts of labelled pages, each edge one of parent and child. Messages to the root and back give every node's
marginal exactly, and the runs of text whose marginal of content is at least 1/2 are the result. The model learns
from labelled pages; `labelled_pages` writes some of common layouts by rule.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps

#: Names of HTML elements by how they are read. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")
BLOCKS = frozenset("html head body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend button select option label pre blockquote figure figcaption address details summary dialog hr menu search center".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"])}
_P = frozenset(["p"])
BOUNDS = frozenset("html body main article section header footer nav aside div ul ol dl table td th form fieldset blockquote figure dialog".split())
ENDS_P = BLOCKS - frozenset("button label option select legend html head body".split())

#: Stems of class and id names, by what they tell. Fixed values.
STEMS = {
    "comment": "comment comments disqus respond reply replies responses".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "side": "sidebar side aside related widget recommended trending popular more share social sharing tags".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "foot": "footer foot copyright legal colophon".split(),
    "head": "header masthead topbar logo branding".split(),
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe signup login paywall".split(),
    "body": "content article post entry story main text body prose".split(),
}
_STEM = {s: kind for kind, stems in STEMS.items() for s in stems}

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"""[^\s/>][^\s/>=]*(?:\s*=\s*)?""")
_VALUE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}


class _Tags:
    """The tags of a page, read in one pass that never goes back: each character is looked at a fixed number of times.

    Reads as browsers do: a quoted value begins after an equals sign, a tag or comment that does not end takes what is left of the page with
    it. A quoted value that does not end is read as one without quotes, which costs a look at the rest of the page once for each kind of quote."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.last = {q: source.rfind(q) for q in "\"'"}

    def next(self) -> tuple[str, bool, str, str, bool] | None:
        """(text before it, whether it ends an element, name, its class, id and role, whether it ends itself), name "" for comments and the like; None at the end."""
        source = self.source
        m = _OPEN.search(source, self.at)
        if not m:
            return None
        text, kind = source[self.at : m.start()], m[0]
        if kind == "<!--":
            end = source.find("-->", m.end())
            self.at = len(source) if end < 0 else end + 3
            return text, False, "", "", False
        if kind in ("<!", "<?"):
            end = source.find(">", m.end())
            self.at = len(source) if end < 0 else end + 1
            return text, False, "", "", False
        shuts = kind[1] == "/"
        name = _NAME.match(source, m.end() - 1)
        at, called = name.end(), []
        while True:
            blank = _SPACE.match(source, at)
            at = blank.end()
            if at >= len(source):
                self.at = at
                return text, False, "", "", False
            if source[at] == ">":
                self.at = at + 1
                return text, shuts, name[0].lower(), " ".join(called), blank[0].endswith("/")
            own = _ATTRIBUTE.match(source, at)
            at, key = own.end(), own[0]
            if not key.rstrip().endswith("=") or len(key.rstrip()) == 1:
                continue
            if (q := source[at : at + 1]) in ("'", '"') and q and self.last[q] > at:
                end = source.index(q, at + 1)
                value, at = source[at + 1 : end], end + 1
            else:
                plain = _VALUE.match(source, at)
                value, at = plain[0], plain.end()
            if key.rstrip("= \t\r\n\f").lower() in ("class", "id", "role"):
                called.append(value)


class Page:
    """parent and features of each node in page order, with the text of leaves (None for elements)."""

    def __init__(self, source: str):
        self.parent, self.features, self.text = [-1], [("tag=root",)], [None]
        self.at = [0]
        tags, opened = ["root"], Counter(["root"])  # open block elements beside self.at, and how many of each
        held: list[str] = []
        linked, in_link = 0, False
        reader = _Tags(source)

        def flush() -> None:
            nonlocal linked
            words = html.unescape("".join(held)).split() if held else []
            held.clear()
            if words:
                text = " ".join(words)
                self._leaf(tags[-1], text, linked)
            linked = 0

        def shut(size: int) -> None:
            opened.subtract(tags[size:])
            del tags[size:], self.at[size:]

        while tag := reader.next():
            piece, ends, name, called, alone = tag
            if piece:
                held.append(piece)
                linked += len(piece) * in_link
            if name == "br":
                held.append(" ")
            elif name == "a":
                in_link = not ends
            elif name in _RAW_END:
                if not ends and not alone:
                    reader.at = _RAW_END[name].search(source, reader.at).end()
            elif name in BLOCKS:
                flush()
                if ends:
                    if opened[name]:
                        k = len(tags) - 1
                        while tags[k] != name and not (name == "p" and tags[k] in BOUNDS):
                            k -= 1
                        shut(k if tags[k] == name else k + 1)
                    in_link = False
                    continue
                over = CLOSES.get(name, frozenset()) | (_P if name in ENDS_P else frozenset())
                if any(opened[x] for x in over):
                    k = len(tags) - 1
                    while k > 0 and tags[k] not in over and tags[k] not in BOUNDS:
                        k -= 1
                    if k > 0 and tags[k] in over:
                        shut(k)
                if name not in VOID:
                    self._element(name, called)
                    tags.append(name)
                    opened[name] += 1
        rest = source[reader.at :]
        if rest:
            held.append(rest)
            linked += len(rest) * in_link
        flush()

    def _add(self, features: tuple, text: str | None) -> int:
        self.parent.append(self.at[-1])
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1

    def _element(self, name: str, called: str) -> None:
        kinds = sorted({k for w in _WORD.findall(called.lower()) if (k := _STEM.get(w))}) if called else []
        self.at.append(self._add((f"tag={name}", *(f"name={k}" for k in kinds)), None))

    def _leaf(self, tag: str, text: str, linked: int) -> None:
        size = "short" if len(text) < 25 else "middle" if len(text) < 120 else "long"
        link = "all" if linked * 3 > len(text) * 2 else "some" if linked else "none"
        stop = "stop" if text[-1] in ".!?:;\"')”»…" else "open"
        self._add((f"under={tag if tag in ('p', 'li', 'td', 'a', 'button', 'label', 'footer', 'nav', 'option') or tag[0] == 'h' else 'other'}", f"size={size}", f"link={link}", f"end={stop}"), text)


class Model:
    """Log potentials: weight of each feature of a content node, and (pull, push) of an edge to an element and to a leaf.

    An edge adds `push` if the parent is content, and `pull` if both ends are."""

    def __init__(self, weight: dict[str, float], edge: dict[bool, tuple[float, float]]):
        self.weight, self.edge = weight, {leaf: (exp(pull), exp(push)) for leaf, (pull, push) in edge.items()}

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, by messages from leaves to root and back; parents come before their children. All as odds."""
        n, held = len(page.parent), lambda x: min(1e100, max(1e-100, x))
        own = [exp(max(-60.0, min(60.0, sum([self.weight.get(f, 0.0) for f in fs])))) for fs in page.features]
        below, sent, above = own[:], [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            pull, push = self.edge[page.text[i] is not None]
            x = below[i]
            sent[i] = push * (1 + x * pull) / (1 + x)
            below[page.parent[i]] = held(below[page.parent[i]] * sent[i])
        for i in range(1, n):
            p = page.parent[i]
            pull, push = self.edge[page.text[i] is not None]
            y = held(above[p] * below[p] / sent[i])
            above[i] = (1 + y * push * pull) / (1 + y * push)
        return [(x := held(above[i] * below[i])) / (1 + x) for i in range(n)]

    def text(self, source: str) -> str:
        page = Page(source)
        return "\n".join(t for t, p in zip(page.text, self.marginals(page), strict=True) if t is not None and p >= 0.5)


def train(labelled: list[tuple[str, str]]) -> Model:
    """labelled: (html, main text as this module returns it). A leaf is content if it is one of the main text's lines; an element is
    content if most characters below it are, but not body and what holds it.

    The potentials maximise the likelihood of the labels, less a ridge, by gradient steps (Adam): a step passes messages over
    all pages at once, level by level, and compares what the labels hold with what the marginals expect."""
    names: dict[str, int] = {}
    features: list[list[int]] = []
    parents, leaves, depths, truth = [], [], [], []
    for source, main in labelled:
        page, base = Page(source), len(truth)
        lines, n = Counter(main.split("\n")), len(page.parent)
        weight = [[0, 0] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            if page.text[i] is not None:
                weight[i][lines[page.text[i]] > 0] += len(page.text[i])
            for c in (0, 1) if i else ():
                weight[page.parent[i]][c] += weight[i][c]
        truth += [b > a and page.features[i][0] not in ("tag=root", "tag=html", "tag=body") for i, (a, b) in enumerate(weight)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[page.parent[i]] + 1
        depths += depth
        parents += [base + q for q in page.parent]
        leaves += [t is not None for t in page.text]
        features += [[names.setdefault(f, len(names)) for f in fs] for fs in page.features]
    n, m = len(truth), len(names)
    x = np.zeros((n, m))
    for i, fs in enumerate(features):
        x[i, fs] = 1
    y, parent, leaf, depth = np.array(truth, float), np.array(parents), np.array(leaves, int), np.array(depths)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    child = np.flatnonzero(depth > 0)
    w, first, second = np.zeros(m + 4), np.zeros(m + 4), np.zeros(m + 4)  # then pull of elements and leaves, push of both
    w[m : m + 2] = 2.0
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, 301):
        below, sent, above = x @ w[:m], np.zeros(n), np.zeros(n)
        pull, push = w[m + leaf], w[m + 2 + leaf]
        for at in reversed(levels):
            sent[at] = push[at] + soft(below[at] + pull[at]) - soft(below[at])
            below += np.bincount(parent[at], sent[at], n)
        for at in levels:
            z = above[parent[at]] + below[parent[at]] - sent[at] + push[at]
            above[at] = soft(z + pull[at]) - soft(z)
        own = 1 / (1 + np.exp(-np.clip(above + below, -500, 500)))
        z = (above[parent] + below[parent] - sent + push)[child]
        both = np.exp(z + below[child] + pull[child] - soft(np.logaddexp(below[child], np.logaddexp(z, z + below[child] + pull[child]))))
        kind = leaf[child]
        g = np.concatenate([x.T @ (y - own), np.bincount(kind, y[child] * y[parent[child]] - both, 2), np.bincount(kind, (y - own)[parent[child]], 2)]) - 0.5 * w
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(w[k]) for f, k in names.items()}, {False: (w[m], w[m + 2]), True: (w[m + 1], w[m + 3])})


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """Pages of common layouts with their main text: menus, headers, footers, sidebars, notices, adverts, forms and comments around an
    article of paragraphs, headings, lists, quotes and tables."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghilmnoprstuvy", k=r.randint(2, 9)))
    line = lambda a, b: (" ".join(word() for _ in range(r.randint(a, b)))).capitalize()
    row = lambda: " ".join(f'<a href="/{word()}">{line(1, 2)}</a>' for _ in range(r.randint(2, 6)))
    links = lambda: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(r.randint(2, 7)))
    pick = lambda kind: r.choice(STEMS[kind])
    end = lambda: r.choice([".", ".", ".", "", " |", "***", "!", " 12"])
    out = []
    for _ in range(n):
        main: list[str] = []

        def say(a: int, b: int, stop: str | None = None, main: list = main) -> str:
            main.append(line(a, b) + (end() if stop is None else stop))
            return main[-1]

        def noise() -> str:
            kind = r.randrange(7)
            return [
                f'<div class="{pick("advert")}">{line(3, 20)}{end()}</div>', f'<aside class="{pick("side")}"><h3>{line(1, 4)}</h3><ul>{links()}</ul></aside>', f'<div class="{pick("notice")}"><p>{line(4, 16)}{end()}</p><button>{line(1, 2)}</button></div>',
                f'<form action="/{word()}"><label>{line(1, 2)}</label><input><button>{line(1, 1)}</button></form>', f'<div class="{pick("side")}">{line(2, 12)}{end()} <a href="#">{line(1, 3)}</a></div>', f'<nav class="{pick("menu")}"><ul>{links()}</ul></nav>', f"<aside><p>{line(3, 25)}{end()}</p></aside>",
            ][kind]

        par = "div" if r.random() < 0.12 else "p"  # what this page puts its paragraphs in
        body = [f"<h1>{say(2, 12, r.choice(['', '.']))}</h1>"] if r.random() < 0.9 else []
        if body and r.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.72:
                body.append(f"<{par}>{say(1, 8) if r.random() < 0.35 else say(9, 90)}" + f"</{par}>" * (par == "div" or r.random() < 0.8))
            elif x < 0.8:
                body.append(f"<h{(h := r.randint(2, 4))}>{say(1, 6, '')}</h{h}>")
            elif x < 0.87:
                body.append("<ul>" + "".join(f"<li>{say(1, 15)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.91:
                body.append(f"<blockquote><p>{say(5, 25)}</p></blockquote>")
            elif x < 0.94:
                body.append("<table><tr>" + "".join(f"<td>{say(1, 3, '')}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.96:
                body.append(f"<pre>{say(2, 10)}</pre>" if r.random() < 0.5 else f"<figure><img src='{word()}'><figcaption>{say(2, 10)}</figcaption></figure>")
            elif x < 0.97:
                body.append(f"<article><h2>{say(1, 6, '')}</h2><p>{say(5, 40)}</p></article>")
            else:
                body.append(noise())
        shell = r.random()
        article = "".join(body)
        if shell < 0.55:
            article = f"<article>{article}</article>"
        elif shell < 0.7:
            article = f'<div class="{pick("body")}">{article}</div>'
        elif shell < 0.8:
            article = f"<div>{article}</div>"
        elif shell < 0.84:
            article = f"<table><tr><td>{row()}</td><td>{article}</td></tr></table>"
        else:
            article = f'<main><div class="{pick("body")}">{article}</div></main>'
        talk = f'<section {r.choice(["class", "id"])}="{pick("comment")}"><h2>{line(1, 2)}</h2>' + "".join((f'<div class="comment"><p>{line(2, 40)}{end()}</p></div>' if r.random() < 0.6 else f"<p>{line(2, 40)}{end()}</p>") for _ in range(r.randint(1, 4))) + "</section>" if r.random() < 0.3 else ""
        top = (f"<header><a href='/'>{line(1, 3)}</a></header>" if r.random() < 0.4 else "") + r.choice([f"<nav><ul>{links()}</ul></nav>"] * 6 + ["", "", f"<div>{row()}</div>", f"<ul>{links()}</ul>", f"<nav>{row()}</nav>"])
        foot = r.choice([f"<footer><p>{line(3, 12)}{end()}</p></footer>", f"<div>&copy; {line(2, 6)}. {row()}</div>", f"<footer>&copy; {word()}.{word()} {line(1, 14)}{end()}</footer>", f'<div class="{pick("foot")}"><p>{line(3, 12)}{end()}</p></div>'])
        around = [noise() for _ in range(r.randint(0, 3))]
        cut = r.randint(0, len(around))
        page = f"<!DOCTYPE html><html><head><title>{line(2, 8)}</title></head><body>{top}{''.join(around[:cut])}{article}{talk}{''.join(around[cut:])}{foot}" + "</body></html>" * (r.random() < 0.9)
        out.append((page, "\n".join(main)))
    return out


def _extracted(source: str, keep: list[str], model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in steps(batch.column(batch.schema.get_field_index(source)), 4_000_000):
                raw, at = data.tobytes(), at.tolist()
                texts = [model.text(raw[a:b].decode("utf-8", "replace")) if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """The kept columns of each row with text and n_chars (code points). Null and empty html give empty text.

    Repeated rows each count, null keys stay, an empty table gives none, other columns are not used. A kept column must not be called text or n_chars.
    Pages of any length are read whole, in time in proportion to it.
    """
    keep = list(keep)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*dict.fromkeys([*keep, source])).mapInArrow(_extracted(source, keep, train(labelled or labelled_pages())), schema)
