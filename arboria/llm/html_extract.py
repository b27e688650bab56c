"""Main text of HTML pages by a tree-structured graphical model [operator 2].

A page is parsed into its block elements.  Each is content or boilerplate; a unary potential looks at its tag,
its class, id and role, its own text and links; a parent-child potential says how the two go together (below
boilerplate nearly all is boilerplate).  Sum-product messages go up the tree and down again, which gives exact
marginals; a text block is kept where its element's marginal is over one half.

The potentials are learnt by gradient ascent on the likelihood of labelled pages (expected against observed
features, the expectations by the same messages).  The labelled pages are made here from a seed: layouts with
articles in many dresses, menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Text: character references are decoded, white space within a block is one space, blocks are trimmed and joined
by one line feed in page order; scripts, styles, templates, choices and fields of forms, and the head are never text.
What pages show where scripts or plug-ins are missing (noscript, object, canvas, iframe) and formulas are text like any.

Defined results: a null page is empty; a page without kept blocks gives the empty string; unclosed and unknown
elements are tolerated; page_id and url may be null; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# ---- parsing ---------------------------------------------------------------------------------------------------

#: A comment, which --> or --!> ends and which <!--> and <!---> are whole; a tag, whose quoted values may hold any character
#: (a quote that no blank, slash or > follows is none: its partner is missing); a declaration.  No part is tried twice.
_TOKEN = re.compile(r"<!--(?:-?>|(?P<open>.*?)(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+)*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is no text of the page: code, and what a reader picks or fills in.
_RAW = {"script", "style", "textarea", "template", "select", "title"}
#: Elements whose content has no markup.
_LITERAL = {"xmp"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp", "nobr", "picture", "output", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "mfrac", "msqrt", "mroot", "mstyle", "semantics", "object", "canvas", "svg", "g", "text", "tspan", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "#root", "aside", "nav", "main", "form"}

_TAGS = ("article", "main", "section", "div", "p", "heading", "li", "list", "nav", "header", "footer", "aside", "form", "cell", "table", "quote", "pre", "figure", "page", "head", "noscript", "other")
_TAG = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "blockquote": "quote", "figcaption": "figure", "body": "page", "html": "page", "#root": "page", "fieldset": "form", "button": "form", "menu": "list", "dialog": "aside", "address": "footer"}
#: Words in class, id or role, by what they tell.
_HINTS = (
    r"\b(?:article|content|post|entry|story|main|body|text|prose|hentry|richtext)",
    r"nav|menu|breadcrumb|toc\b|pagination|pager|tabs?\b|skip",
    r"\bheader|masthead|banner|topbar|logo|brand",
    r"foot|copyright|colophon|contentinfo|legal|imprint",
    r"side|widget|related|recommend|complementary|trending|popular|more-|also|read-next|teaser|tags?\b",
    r"\bads?\b|\bad-|-ad\b|advert|sponsor|promo|banner-ad|\bgoogle_ads|outbrain|taboola|doubleclick|affiliate",
    r"comment|repl(?:y|ies)|discuss|disqus|respond|feedback|\bremark|guestbook|review",
    r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|paywall|toast|message|warning|signup|dialog",
    r"share|social|follow|like-|login|search|form|rating|author-bio|byline|print",
)
_HINT = [re.compile(x) for x in _HINTS]
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Block elements in page order (parents first), and text blocks with the element each belongs to."""

    def __init__(self, source: str):
        self.parent, self.tag, self.hint = [-1], ["#root"], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        stack: list[tuple[str, int]] = [("#root", 0)]
        parts: list[str] = []
        linked = [0, 0]  # open links, characters in links

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked[1], len(text))))
                parts.clear()
            linked[1] = 0

        def say(raw: str) -> None:
            if raw:
                text = html_lib.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if linked[0]:
                    linked[1] += len(text.strip())

        at, find, last = 0, _TOKEN.search, source.rfind(">") + 1  # no tag ends beyond
        while True:
            m = find(source, at, last)
            if m is None:
                rest = source.find("<!--", at)  # of a comment that is never closed
                say(source[at:] if rest < 0 else source[at:rest])
                break
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            close, name, rest = m[2], m[3], m[4]
            if not name:
                if m["open"] is not None and at == last and not source.endswith(("-->", "--!>"), 0, last):
                    break  # a comment that is never closed
                continue
            name = name.lower()
            if not close and (name in _RAW or name in _LITERAL):
                if rest.endswith("/"):
                    continue
                end = _end_of(name).search(source, at)
                if name in _LITERAL:
                    flush()
                    self.push(stack, name, hints(rest) if rest else 0)
                    parts.append(source[at : end.start() if end else len(source)])
                    flush()
                    stack.pop()
                at = end.end() if end else len(source)
                parts.append(" ")
                continue
            if name in _VOID:
                parts.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in _INLINE:
                if name == "a":
                    linked[0] = 0 if close else 1
                continue
            flush()
            linked[0] = 0
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name in ("p", "li", "td", "tr", "dd", "dt") and stack[k][0] in _SCOPE:
                        break
                continue
            if stack[-1][0] == "p" or stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and _TAG.get(name) == "heading":
                stack.pop()
            if name in _CLOSES:
                ends = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if name == "head":
                self.push(stack, name, 1 << 12)
            else:
                if stack[-1][0] == "head" and name == "body":
                    stack.pop()
                self.push(stack, name, hints(rest) if rest else 0)
        flush()

    def push(self, stack: list, name: str, hint: int) -> None:
        stack.append((name, len(self.tag)))
        self.parent.append(stack[-2][1])
        self.tag.append(name)
        self.hint.append(hint)


@cache
def _end_of(name: str) -> re.Pattern:
    """The end tag of an element without markup inside, and what is left of it where the page ends in it."""
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I | re.A)


@cache
def _hints_of(text: str) -> int:
    return sum(1 << k for k, r in enumerate(_HINT) if r.search(text))


def hints(attributes: str) -> int:
    out, words = 0, []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            out |= 1 << 10
        elif key not in ("style", "aria-hidden"):
            words.append(value.lower())
    text = " ".join(words)
    if text:
        out |= _hints_of(text) if len(text) < 80 else sum(1 << k for k, r in enumerate(_HINT) if r.search(text))
    return out


# ---- the model -------------------------------------------------------------------------------------------------

N_HINTS = 13
N_FEATURES = 1 + len(_TAGS) + N_HINTS + 12
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}


class Batch:
    """The elements of some pages together: parents, levels, features."""

    def __init__(self, pages: list[Page]):
        first = np.cumsum([0, *(len(p.tag) for p in pages)])
        self.first = first
        n = int(first[-1])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + a) for p, a in zip(pages, first[:-1], strict=True)]) if pages else np.zeros(0, np.int64)
        depth = np.zeros(n, np.int64)
        for p, a in zip(pages, first[:-1].tolist(), strict=True):
            d = [0] * len(p.tag)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth[a : a + len(d)] = d
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
        x = np.zeros((n, N_FEATURES))
        x[:, 0] = 1
        tags = [_TAG_AT.get(_TAG.get(t, t), _TAG_AT["other"]) for p in pages for t in p.tag]
        x[np.arange(n), 1 + np.array(tags, np.int64)] = 1
        hint = np.array([h for p in pages for h in p.hint], np.int64)
        for k in range(N_HINTS):
            x[:, 1 + len(_TAGS) + k] = (hint >> k) & 1
        own = np.zeros((n, 4))
        rows = [(a + e, len(t), links, t.count(".") + t.count(",") + t.count(";"), "©" in t) for p, a in zip(pages, first[:-1].tolist(), strict=True) for e, t, links in p.blocks]
        if rows:
            r = np.array(rows, np.float64)
            np.add.at(own, r[:, 0].astype(np.int64), r[:, 1:5])
        f = 1 + len(_TAGS) + N_HINTS
        has = own[:, 0] > 0
        share = np.where(has, own[:, 1] / np.maximum(own[:, 0], 1), 0)
        x[:, f] = has
        x[:, f + 1] = np.log1p(own[:, 0]) / 5
        x[:, f + 2] = has & (own[:, 0] < 25)
        x[:, f + 3] = own[:, 0] > 100
        x[:, f + 4] = share
        x[:, f + 5] = share > 0.6
        x[:, f + 6] = np.minimum(own[:, 2], 10) / 5
        x[:, f + 7] = own[:, 3] > 0
        x[:, f + 8] = np.minimum(depth, 10) / 10
        x[1:, f + 9] = x[self.parent[1:], 1 + _TAG_AT["page"]] * (self.parent[1:] >= 0)
        under = own[:, :2].copy()  # with all below: a list of links is a menu, one of sentences is not
        for level in self.levels[:0:-1]:
            np.add.at(under, self.parent[level], under[level])
        lists, links = (x[:, 1 + _TAG_AT["list"]] + x[:, 1 + _TAG_AT["li"]]) > 0, under[:, 1] > 0.3 * under[:, 0]
        x[:, f + 10] = lists & links
        x[:, f + 11] = lists & ~links
        self.x = x

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element and the 2 x 2 marginals of each with its parent, by messages up and down.

        unary: log-potential of content against boilerplate; pair[parent, child]: log-potentials.
        """
        n = len(unary)
        belief = np.stack([np.zeros(n), unary], axis=1)  # own and children's
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            b = belief[level]
            m = np.logaddexp(pair[:, 0] + b[:, :1], pair[:, 1] + b[:, 1:])
            up[level] = m
            np.add.at(belief, self.parent[level], m)
        total = belief.copy()  # with the parent's
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            rest = total[self.parent[level]] - up[level]
            joint = rest[:, :, None] + pair[None] + belief[level][:, None, :]
            total[level] += np.logaddexp(rest[:, 0, None] + pair[0], rest[:, 1, None] + pair[1])
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp((total[:, 0] - total[:, 1]).clip(-50, 50))), both


def fit(pages: list[Page], labels: list[list[int]], rounds: int = 300, rate: float = 0.15, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and pair potentials of greatest penalised likelihood, by Adam on the exact gradient."""
    batch = Batch(pages)
    y = np.concatenate([np.array(x, np.float64) for x in labels])
    child = np.flatnonzero(batch.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[batch.parent[child]].astype(np.int64), y[child].astype(np.int64)), 1)
    theta, m, v = np.zeros(N_FEATURES + 4), 0, 0
    for t in range(1, rounds + 1):
        p, both = batch.marginals(batch.x @ theta[:-4], theta[-4:].reshape(2, 2))
        g = np.concatenate([batch.x.T @ (y - p), (seen - both.sum(axis=0)).reshape(-1)]) / len(y) - shrink * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


#: Classes of paragraphs and tables in articles that only sound like boilerplate, or like nothing.
ODD_CLASSES = ["comment-free", "lead", "note-1", "noticeable", "shared-text", "adventure", "data-table", "foot-step", "sidewise", "x1", "k-body"]
#: Elements that say nothing of their content.
UNUSUAL = ["details", "center", "hgroup", "x-block"]


# ---- labelled pages --------------------------------------------------------------------------------------------


def labelled(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """HTML in which every element carries data-y="0" or "1", made from a seed, and the texts of the content blocks."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tas vo shu pel dar nim ost ule ber fin gra hol".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice(".,.!.?.;. ").strip()
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda text=None: f'<a href="/{word()}">{text or words(1, 3)}</a>'

    def el(tag: str, inner: str, y: int, cls: str = "", key: str = "class") -> str:
        dress = f' {key}="{cls}"' if cls else ""
        return f'<{tag}{dress} data-y="{y}">{inner}</{tag}>'

    def links(y: int = 0) -> str:
        k = r.random()
        if k < 0.7:
            return el(r.choice(["ul", "ul", "ol"]), "".join(el("li", link(), y) for _ in range(r.randint(2, 9))), y)
        return " | ".join(link() for _ in range(r.randint(2, 9)))

    def nav() -> str:
        return el("nav", links(), 0, r.choice(["", "", "menu", "main-nav"])) if r.random() < 0.6 else el("div", links(), 0, r.choice(["nav", "menu", "navbar", "breadcrumbs", "navigation"]), r.choice(["class", "id"]))

    def header() -> str:
        inner = r.choice([el("h1", words(1, 3), 0), el("p", words(1, 6), 0), el("div", link(), 0, "logo"), words(1, 5)])
        if r.random() < 0.5:
            inner += nav()
        return el("header", inner, 0, r.choice(["", "site-header"])) if r.random() < 0.6 else el("div", inner, 0, r.choice(["header", "masthead", "banner", "top-bar"]), r.choice(["class", "id"]))

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example.org &middot; {prose(1, 2)}", el("p", f"© {words(1, 4)}", 0), links(), prose(1, 3), el("p", prose(1, 3), 0)])
        return el("footer", inner, 0) if r.random() < 0.6 else el("div", inner, 0, r.choice(["footer", "site-footer", "copyright", "bottom-footer"]), r.choice(["class", "id"]))

    def box(names: list[str], tags: list[str], inner: str) -> str:
        return el(r.choice(tags), inner, 0, r.choice(names), r.choice(["class", "class", "id"]))

    def few() -> str:
        if r.random() < 0.1:
            return el(r.choice(UNUSUAL), el("p", prose(1, 3), 0), 0)
        return r.choice([prose(1, 3), el("p", prose(1, 4), 0), el("h3", words(1, 4), 0) + el("p", prose(1, 3), 0), links(), el("h4", words(1, 3), 0) + links()])

    def sidebar() -> str:
        return el("aside", few() + few(), 0, r.choice(["", "sidebar"])) if r.random() < 0.5 else box(["sidebar", "widget", "related", "recommended", "side-bar", "more-stories", "trending"], ["div", "section"], few() + few())

    def advert() -> str:
        return box(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"], ["div", "div", "aside", "section", "p"], few() if r.random() < 0.5 else prose(1, 2))

    def notice() -> str:
        if r.random() < 0.15:
            return el("noscript", r.choice([prose(1, 1), el("p", prose(1, 2), 0), el("div", words(3, 12), 0)]), 0)
        return box(["cookie-notice", "cookie-banner", "consent", "gdpr", "newsletter", "subscribe-box", "popup", "modal", "notice", "alert"], ["div", "div", "section", "aside"], r.choice([prose(1, 3), el("p", prose(1, 3), 0)]) + (el("button", words(1, 2), 0) if r.random() < 0.5 else ""))

    def form() -> str:
        return el("form", r.choice([words(1, 4), el("p", words(2, 8), 0), f"<label>{words(1, 3)}</label> <input name=q>", el("div", words(1, 6), 0)]) + (el("button", words(1, 2), 0) if r.random() < 0.6 else ""), 0)

    def hidden() -> str:
        return f'<div style="display:none" data-y="0">{few()}</div>'

    def share() -> str:
        return box(["share", "social", "share-buttons", "follow-us"], ["div", "ul"], " ".join(link() for _ in range(r.randint(2, 5))))

    def comments() -> str:
        one = lambda: el(r.choice(["div", "li", "article"]), r.choice(["", el("div", words(1, 2), 0, "author"), el("h4", words(1, 2), 0)]) + "".join(el("p", prose(1, 5), 0) for _ in range(r.randint(1, 2))), 0, r.choice(["comment", "comment", "reply", "comment-body", ""]))
        inner = (el("h3", words(1, 3), 0) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
        return box(["comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments"], ["section", "div", "div", "ol"], inner)

    def paragraph() -> str:
        k = r.random()
        text = prose(1, 7) if k < 0.75 else words(1, 4).capitalize() + r.choice([".", ""])
        if r.random() < 0.15:
            text = text + " " + link(words(1, 4)) + " " + sentence()
        if r.random() < 0.1:
            text = f"<b>{text}</b>"
        return text

    def article() -> tuple[str, list[str]]:
        out, texts = "", []
        if r.random() < 0.85:
            title = words(2, 10).capitalize()
            h = el("h1", title, 1)
            out += el("header", h, 1) if r.random() < 0.15 else h
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            k = r.random()
            p = paragraph()
            if k < 0.03:  # tables, code, a link as a paragraph, and odd classes
                rows = "".join(el("tr", "".join(el(r.choice(["td", "td", "th"]), words(1, 5), 1) for _ in range(3)), 1) for _ in range(r.randint(1, 5)))
                out += el("table", rows, 1, r.choice(["", *ODD_CLASSES]))
            elif k < 0.05:
                out += el("pre", "\n".join(words(1, 6) for _ in range(r.randint(1, 4))), 1)
            elif k < 0.08:
                out += el("p", link(words(2, 7).capitalize()), 1)
            elif k < 0.12:
                out += el("p", p, 1, r.choice(ODD_CLASSES))
            elif k < 0.78:
                out += el("p", p, 1)
            elif k < 0.84:
                out += el("div", p, 1)
            elif k < 0.89:
                out += el("blockquote", el("p", p, 1) if r.random() < 0.5 else p, 1)
            elif k < 0.91:
                out += el(r.choice(UNUSUAL + ["noscript", "noscript"]), el("p", p, 1) if r.random() < 0.7 else p, 1)
            elif k < 0.94:
                out += el("ul", "".join(el("li", words(2, 14) if r.random() < 0.5 else sentence(), 1) for _ in range(r.randint(1, 5))), 1)
            elif k < 0.975:
                out += el("h2", words(1, 7), 1)
            else:
                out += r.choice([advert, share, notice, sidebar, form])()
        dress = r.random()
        if dress < 0.45:
            return el("article", out, 1, r.choice(["", "", "post", "entry", "story"])), texts
        if dress < 0.6:
            return el("main", out, 1), texts
        if dress < 0.9:
            return el(r.choice(["div", "div", "section"]), out, 1, r.choice(["content", "post-content", "article-body", "entry-content", "story", "main-content", "text"]), r.choice(["class", "id"])), texts
        return el("div", out, 1), texts

    pages = []
    for _ in range(n):
        main, _ = article()
        if r.random() < 0.25:
            main = main[: main.rfind("</")] + (comments() if r.random() < 0.5 else share()) + main[main.rfind("</") :]
        before = "".join(f() for f in (header, nav, notice, advert, form, hidden) if r.random() < 0.45)
        after = "".join(f() for f in (share, comments, sidebar, advert, notice, hidden, form, footer) if r.random() < 0.45)
        inner = before + main + after
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = el("div", inner, 1, r.choice(["", "wrapper", "container", "page", "site"]))
        pages.append((f'<!DOCTYPE html><html data-y="1"><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body data-y="1"><script>x="</p>"</script>{inner}</body></html>', []))
    return pages


_Y = re.compile(r'<[a-z0-9-]+[^>]* data-y="([01])">')


def training_pages(n: int = 800, seed: int = 11) -> tuple[list[Page], list[list[int]]]:
    pages, labels = [], []
    for source, _ in labelled(n, seed):
        page, marks = Page(source), iter(_Y.findall(source))
        labels.append([1 if t in ("#root",) else 0 if t == "head" else int(next(marks)) if t not in _RAW | _INLINE | _VOID else 0 for t in page.tag])
        pages.append(page)
    return pages, labels


@cache
def trained(n: int = 800, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    return fit(*training_pages(n, seed))


# ---- the operator ----------------------------------------------------------------------------------------------


def texts_of(sources: list[str], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """Main text of each page."""
    pages = [Page(s) for s in sources]
    batch = Batch(pages)
    if not pages:
        return []
    p, _ = batch.marginals(batch.x @ weights, pair)
    return ["\n".join(t for e, t, _ in page.blocks if p[a + e] > 0.5) for page, a in zip(pages, batch.first.tolist(), strict=False)]


def html_extract(pages: DataFrame, labelled_pages: int = 800, seed: int = 11) -> DataFrame:
    """page_id, url, text, n_chars of each page; the model is fitted to `labelled_pages` made pages."""
    weights, pair = trained(labelled_pages, seed)

    def run(batches):
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                sources, size, b = [], 0, a
                while b < batch.num_rows and (b == a or size < 1 << 20) and b - a < 256:
                    sources.append((batch.column("html")[b].as_py() or b"").decode("utf-8", "replace"))
                    size += len(sources[-1])
                    b += 1
                texts = texts_of(sources, weights, pair)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                a = b

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), C.text_bytes("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(C.table(spark, sf_dir, "pages"))
