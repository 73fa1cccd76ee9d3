"""Labelled pages for training: invented pages whose blocks are known to be article or not.

Words are invented too, so that nothing but the shape of blocks and the names of elements can be learned. On a third of the
pages the elements and names say nothing, and the shape of the text is all there is.
"""

from __future__ import annotations

import random

_NOT_ARTICLE = {
    "nav": ["nav", "ul", "div.menu", "div.navbar", "ul.nav", "div.navigation", "div.breadcrumb", "div.topbar", "menu"],
    "header": ["header", "div.header", "div.masthead", "header.site", "div.banner", "div.logo"],
    "footer": ["footer", "div.footer", "footer.site", "div.copyright", "div.legal", "div.colophon"],
    "side": ["aside", "div.sidebar", "aside.widget", "div.widget", "div.related", "section.related", "div.recommended", "div.popular", "div.trending", "ul.tags", "div.share", "div.social"],
    "notice": ["div.cookie", "div.notice", "div.consent", "div.banner", "div.alert", "div.gdpr", "div.popup", "dialog", "div.modal", "div.disclaimer"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.promo", "ins.ad", "section.ad", "div.sponsor", "div.promotion"],
    "form": ["form", "div.newsletter", "form.search", "div.subscribe", "form.login", "div.signup", "form.comment", "fieldset"],
    "comments": ["div.comments", "section.comments", "div.comment", "ol.comments", "ul.commentlist", "article.comment", "div.replies", "div.discussion", "div.disqus", "li.comment", "section.comment", "div.responses"],
}
_ARTICLE = ["article", "article.post", "article.entry", "main", "main.content", "div.content", "div.article", "div.post", "div.entry", "section.article", "div.story", "div.main", "div.body", "section.content", "div.text"]
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an er in on th st".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _sentence(r: random.Random, most: int = 22) -> str:
    words = [_word(r) for _ in range(r.randint(1, most))]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "?", "!", "", " |", "...", "###"))


def _text(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8))))


def _prose(r: random.Random) -> str:
    """Sentences as articles have them."""
    return " ".join(" ".join(_word(r) for _ in range(r.randint(6, 22))).capitalize() + r.choice("...?!") for _ in range(r.randint(2, 8)))


def _open(spec: str, r: random.Random, plain: bool = False) -> tuple[str, str]:
    """plain: a page whose elements say nothing; all that stands apart is in a div, with a name that means nothing or none."""
    name, *marks = spec.split(".")
    if plain:
        name, marks = "div", r.choice(([], [], [r.choice(("c", "x", "row", "col", "wrap", "block", "inner"))]))
    if name == "ins":
        name = "div"
    extra = f" {r.choice(('class', 'class', 'id'))}=\"{' '.join(marks)}\"" if marks else ""
    return f"<{name}{extra}>", f"</{name}>"


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []
        self.plain = r.random() < 0.33

    def leaf(self, tag: str, text: str, label: bool, close: bool = True) -> None:
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append((" ".join(text.split()), label))

    def rest(self, kind: str) -> None:
        """A part of a page that isn't article."""
        r = self.r
        begin, end = _open(r.choice(_NOT_ARTICLE[kind]), r, self.plain)
        self.html.append(begin)
        if kind in ("nav", "side") and r.random() < 0.8 or kind in ("header", "footer") and r.random() < 0.3:
            self.html.append("<ul>")
            for _ in range(r.randint(2, 8)):
                text = " ".join(_word(r) for _ in range(r.randint(1, 4)))
                self.html.append(f'<li><a href="/x">{text}</a></li>')
                self.labels.append((text, False))
            self.html.append("</ul>")
        else:
            for _ in range(r.choice((1, 1, 2, 3))):
                text = _text(r) if kind in ("comments", "notice", "ad", "side") and not self.plain else _sentence(r, 7 if self.plain else 22)
                if kind == "footer":
                    text = r.choice(("&copy; ", "")) + text
                shown = text.replace("&copy;", "©")
                how = r.choice(("", "p", "div", "span", "h3" if kind in ("side", "header", "comments") else "p"))
                if how in ("", "span"):
                    self.html.append(f"<div>{text}</div>")
                else:
                    self.html.append(f"<{how}>{text}</{how}>")
                self.labels.append((shown, False))
            if kind == "form" and r.random() < 0.7:
                text = _word(r)
                self.html.append(f'<label>{_word(r)}</label><input name="q"><button>{text}</button>')
                self.labels.append((None, False))
                self.labels.append((text, False))
        self.html.append(end)

    def article(self) -> None:
        r = self.r
        begin, end = _open(r.choice(_ARTICLE) if r.random() < 0.7 else "article", r, self.plain)
        self.html.append(begin)
        wrap = r.random() < 0.15
        if wrap:
            self.html.append("<div>")
        if r.random() < 0.85:
            self.leaf(r.choice(("h1", "h1", "h2")), _sentence(r, 10), True)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13))):
            x = r.random()
            if x < 0.72:
                self.leaf("p", _prose(r) if self.plain else _text(r), True)
            elif x < 0.78:
                self.html.append(f"<p><b>{(t := _text(r))}<br>")
                self.labels.append((t, True))
            elif x < 0.82:
                self.leaf(r.choice(("h2", "h3")), _sentence(r, 8), True)
            elif x < 0.86:
                self.leaf("blockquote", _text(r), True)
            elif x < 0.90:
                kind = r.choice(("ul", "ol"))
                self.html.append(f"<{kind}>")
                for _ in range(r.randint(1, 5)):
                    self.leaf("li", _sentence(r), True)
                self.html.append(f"</{kind}>")
            elif x < 0.92:
                self.leaf("pre", _sentence(r), True)
            else:
                self.rest(r.choice(("ad", "ad", "notice", "form", "side", "nav")))
        if wrap:
            self.html.append("</div>")
        if r.random() < 0.15:
            self.rest("comments")
        self.html.append(end)


def page(seed: int) -> tuple[str, list[tuple[str | None, bool]]]:
    """A page and the text and label of its blocks in order; text None: not compared."""
    r = random.Random(seed)
    p = _Page(r)
    p.html.append("<!DOCTYPE html><html><head>")
    if r.random() < 0.7:
        p.leaf("title", _sentence(r, 8), False)
    p.html.append("<script>var x='</p>';</script></head><body>")
    if r.random() < 0.2:  # a page of nothing else
        p.article()
        return "".join(p.html), p.labels
    if r.random() < 0.12:
        p.rest("notice")
    if r.random() < 0.4:
        p.rest("header")
    if r.random() < 0.8:
        p.rest("nav")
    if r.random() < 0.3:
        p.rest(r.choice(("ad", "notice", "side", "form")))
    p.article()
    for kind, share in (("comments", 0.3), ("side", 0.3), ("form", 0.2), ("ad", 0.2), ("notice", 0.1), ("footer", 0.8)):
        if r.random() < share:
            p.rest(kind)
    p.html.append("</body></html>")
    return "".join(p.html), p.labels
