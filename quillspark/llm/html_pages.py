"""Labelled training pages, made by rule from a seed.

There is no table of labelled pages, so the model of ``html_extract`` learns
from these: pages of many layouts, in which every element says whether it
belongs to the main text.  A page is a tree of (tag, attributes, children, content);
children are such trees or strings.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go hu in jo ka li mo na or pa qu re si to un ve wi xa yo za".split()

CONTENT = ["article", "post", "entry-content", "content", "main-content", "story", "article-body", "post-body", "text"]
NOT_CONTENT = {
    "nav": ["menu", "navbar", "nav", "breadcrumbs", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "logo", "banner"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense"],
    "notice": ["cookie", "notice", "consent", "popup", "modal", "alert", "subscribe", "newsletter", "paywall"],
    "comments": ["comments", "comment", "replies", "discussion", "respond", "disqus"],
    "share": ["share", "social", "tags", "meta", "byline", "author", "date"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def some(self, *options):
        return self.r.choice(options)

    def attrs(self, names: list[str], other: bool = True) -> dict:
        r = self.r
        value = r.choice(names)
        if other and r.random() < 0.3:
            value += " " + r.choice(["wide", "col", "box", "x1", "left", "block"])
        return {r.choice(["class", "class", "id"]): value}

    def inline(self, content: bool, n: int) -> list:
        out, r = [self.words(n)], self.r
        if r.random() < 0.3:
            out.append((self.some("a", "b", "i", "em", "strong", "span"), {}, [self.words(r.randint(1, 4))], content))
            out.append(self.words(r.randint(1, 12)))
        return out

    def links(self, n: int, content: bool = False) -> tuple:
        return ("ul", {}, [("li", {}, [("a", {"href": "/x"}, [self.words(self.r.randint(1, 3))], content)], content) for _ in range(n)], content)

    def body_block(self) -> tuple:
        r, k = self.r, self.r.random()
        if k < 0.72:
            return ("p", {}, self.inline(True, int(min(200, r.lognormvariate(3, 1.3))) + 1), True)
        if k < 0.8:
            return (self.some("h2", "h3"), {}, [self.words(r.randint(1, 8))], True)
        if k < 0.86:
            return (self.some("ul", "ol"), {}, [("li", {}, self.inline(True, r.randint(1, 30)), True) for _ in range(r.randint(2, 6))], True)
        if k < 0.9:
            return ("blockquote", {}, [("p", {}, self.inline(True, r.randint(3, 40)), True)], True)
        if k < 0.93:
            return ("pre", {}, [self.words(r.randint(3, 40))], True)
        if k < 0.96:
            return ("table", {}, [("tr", {}, [("td", {}, [self.words(r.randint(1, 5))], True) for _ in range(3)], True) for _ in range(r.randint(1, 4))], True)
        return ("figure", {}, [("figcaption", {}, [self.words(r.randint(2, 15))], True)], True)

    def junk(self, kind: str) -> tuple:
        r, names = self.r, NOT_CONTENT[kind]
        n = r.randint(1, 8)
        if kind == "nav":
            return (self.some("nav", "nav", "div", "ul"), self.attrs(names) if r.random() < 0.6 else {}, [self.links(n)], False)
        if kind == "comments" and r.random() < 0.3:
            # A plain list behind the text.
            return (self.some("ol", "ul", "section", "div"), {}, [(self.some("li", "li", "div"), {}, [("p", {}, self.inline(False, r.randint(1, 60)), False)], False) for _ in range(n)], False)
        if kind == "comments":
            one = lambda: ("div", {"class": "comment"}, [("p", {}, self.inline(False, r.randint(2, 60)), False)], False)
            return (self.some("div", "section", "aside"), self.attrs(names), [("h3", {}, [self.words(2)], False), *(one() for _ in range(n))], False)
        if kind == "notice" and r.random() < 0.5:
            return ("form", self.attrs(names) if r.random() < 0.5 else {}, [("label", {}, [self.words(2)], False), ("button", {}, [self.words(1)], False), ("p", {}, [self.words(r.randint(2, 20))], False)], False)
        tag = {"header": self.some("header", "div"), "footer": self.some("footer", "footer", "div"), "aside": self.some("aside", "aside", "div", "section")}.get(kind, self.some("div", "div", "section", "p"))
        named = kind not in ("header", "footer", "aside") or tag in ("div", "section") or r.random() < 0.4
        inner = self.some([self.words(r.randint(1, 40))], [("p", {}, self.inline(False, r.randint(1, 40)), False)], [self.links(n)], [("h4", {}, [self.words(2)], False), self.links(n)])
        return (tag, self.attrs(names) if named else {}, inner, False)

    def page(self) -> tuple:
        r = self.r
        blocks = [("h1", {}, [self.words(r.randint(2, 12))], True)] if r.random() < 0.8 else []
        for _ in range(int(r.lognormvariate(1.5, 0.8)) + 1):
            blocks.append(self.body_block())
            if r.random() < 0.04:
                blocks.append(self.junk(self.some("ad", "share", "notice", "aside")))
        if r.random() < 0.2:
            blocks.append(self.junk("comments"))
        k = r.random()
        if k < 0.5:
            main = ("article", self.attrs(CONTENT) if r.random() < 0.4 else {}, blocks, True)
        elif k < 0.7:
            main = ("main", {}, blocks, True)
        elif k < 0.75:
            main = ("main", {}, [("article", {}, blocks, True)], False)
        elif k < 0.95:
            main = (self.some("div", "section"), self.attrs(CONTENT), blocks, True)
        else:
            main = None
        before = [self.junk(x) for x in ("header", "nav", "notice", "ad") if r.random() < 0.5]
        after = [self.junk(x) for x in ("share", "comments", "aside", "ad", "footer", "notice") if r.random() < 0.5]
        middle = [main] if main else blocks
        body = [*before, *middle, *after]
        if r.random() < 0.3:
            body = [("div", {"class": self.some("wrapper", "container", "page", "layout")}, body, main is None)]
        if r.random() < 0.1:
            body = [("table", {}, [("tr", {}, [("td", {}, body[:1], False), ("td", {}, body[1:], main is None)], False)], False)]
        head = ("head", {}, [("title", {}, [self.words(r.randint(2, 10))], False)], False)
        # What holds an element of main text isn't main text itself.
        return ("html", {}, [head, ("body", {}, body, main is None)], False)


def pages(n: int, seed: int = 1) -> list[tuple]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
