"""Seeded labelled pages: the training set of the block labeller, whose texts are in no language.

A page is made from a choice of layout habits: how its article is marked up,
which other parts it has, where they stand and what they are called. Names are
left out or neutral in a part of the pages, so that tags, texts and neighbours
have to be learned too.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Element and class names by the part of a page they commonly mark.
PARTS = {
    "menu": (("nav", "ul", "div"), ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "site-nav",
                                    "toc", "pagination", "tabs")),
    "header": (("header", "div"), ("header", "masthead", "site-header", "banner", "top-bar", "logo", "brand", "branding")),
    "footer": (("footer", "div"), ("footer", "site-footer", "bottom", "copyright", "legal", "colophon")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "related-posts", "recommended", "popular",
                                              "trending", "secondary", "more-stories", "tags", "archive", "author-box")),
    "notice": (("div", "section", "p", "dialog"), ("notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup",
                                                   "modal", "message", "privacy-notice", "toast", "disclaimer")),
    "advert": (("div", "aside", "section", "ins", "p"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo",
                                                         "ad-slot", "banner-ad", "adsbygoogle", "partner", "sponsor")),
    "form": (("form", "div"), ("form", "search", "newsletter", "subscribe", "signup", "login", "contact-form",
                               "search-box")),
    "comments": (("section", "div", "ol"), ("comments", "comment-list", "responses", "discussion", "replies", "disqus",
                                            "reader-comments", "comment-thread", "respond")),
    "share": (("div", "ul"), ("share", "social", "share-buttons", "follow-us", "actions", "toolbar", "byline", "meta")),
}
ARTICLE = ("article", "post", "entry-content", "content", "article-body", "story", "main", "post-content", "body-text",
           "page-content", "entry", "text")
NEUTRAL = ("box", "row", "col", "wrap", "container", "inner", "block", "module", "section", "item", "area", "b1", "x2", "unit")


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.blocks: list[tuple[str, bool]] = []
        syllables = ["".join(self.rng.choices("abcdefghijklmnopqrstuvwxyzäéßñо", k=self.rng.randrange(1, 4))) for _ in range(40)]
        self.words = ["".join(self.rng.choices(syllables, k=self.rng.randrange(1, 4))) for _ in range(300)]
        self.named = self.rng.random()          # how often parts carry a telling name
        self.unclosed = self.rng.random() < .2  # paragraphs without end tags

    def phrase(self, least: int, most: int) -> str:
        out = " ".join(self.rng.choices(self.words, k=self.rng.randrange(least, most + 1)))
        return out.capitalize() if self.rng.random() < .7 else out

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.phrase(3, 14).replace(" ", ", ", self.rng.random() < .2) + self.rng.choice("...!?")
                        for _ in range(self.rng.randrange(least, most + 1)))

    def said(self, text: str, main: bool) -> str:
        """A block of text; what it is goes into the page's labels."""
        self.blocks.append((" ".join(text.split()), main))
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(" ", self.rng.choice([" ", " ", "\n  "]), 1)

    def attributes(self, names) -> str:
        if self.rng.random() < .1:
            return ""
        name = self.rng.choice(names) if self.rng.random() < self.named else self.rng.choice(NEUTRAL)
        if self.rng.random() < .2:
            name = f"{self.rng.choice(NEUTRAL)} {name}"
        return f' {self.rng.choice(["class", "class", "class", "id"])}="{name}"'

    def within(self, part: str, inside: Callable[[], str]) -> str:
        tags, names = PARTS[part]
        semantic = self.rng.random() < .5
        tag = tags[0] if semantic else self.rng.choice(tags)
        attributes = self.attributes(names)
        if tag == "p":
            return f"<p{attributes}>{self.said(self.sentences(1, 1), False)}</p>"
        if tag in ("div", "section", "aside", "ins") and " class" not in attributes and " id" not in attributes:
            attributes = f' class="{self.rng.choice(names)}"'
        return f"<{tag}{attributes}>{inside()}</{tag}>"

    def links(self, least: int = 2, most: int = 9) -> str:
        link = lambda: f'<a href="/{self.rng.choice(self.words)}">{self.said(self.phrase(1, 5), False)}</a>'
        n = self.rng.randrange(least, most + 1)
        if self.rng.random() < .7:
            items = "".join(f"<li>{link()}</li>" for _ in range(n))
            return items if self.rng.random() < .2 else f"<ul>{items}</ul>"
        if self.rng.random() < .5:
            return "".join(f"<div>{link()}</div>" for _ in range(n))
        texts = [self.phrase(1, 3) for _ in range(n)]
        self.blocks.append((" | ".join(texts), False))
        return " | ".join(f'<a href="/x">{t}</a>' for t in texts)

    def plain(self, least: int, most: int) -> str:
        """Ordinary prose that is not the article's."""
        text = self.said(self.sentences(least, most), False)
        return text if self.rng.random() < .5 else f"<p>{text}</p>"

    def paragraph(self) -> str:
        kind = self.rng.random()
        say = lambda t: self.said(t, True)
        if kind < .72:
            text = self.sentences(1, 8)
            if self.rng.random() < .2:      # a link or a stressed word inside
                words = text.split(" ")
                self.blocks.append((text, True))
                mark = self.rng.choice(["b", "em", 'a href="/y"', "span", "code"])
                k = self.rng.randrange(len(words))
                words[k] = f"<{mark}>{words[k]}</{mark.split()[0]}>"
                text = " ".join(words)
            else:
                text = say(text)
            lead = "<b>" if self.unclosed and self.rng.random() < .3 else ""
            if self.unclosed:
                return f"<p>{lead}{text}" + self.rng.choice(["", "<br>", "</p>"])
            return f"<p>{text}</p>"
        if kind < .8:
            level = self.rng.choice("2234")
            return f"<h{level}>{say(self.phrase(1, 8))}</h{level}>"
        if kind < .87:
            tag = self.rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{say(self.sentences(1, 2) if self.rng.random() < .5 else self.phrase(1, 8))}</li>"
                                        for _ in range(self.rng.randrange(2, 6))) + f"</{tag}>"
        if kind < .92:
            return f"<blockquote><p>{say(self.sentences(1, 3))}</p></blockquote>"
        if kind < .95:
            return f"<pre>{say(self.phrase(2, 12))}</pre>"
        if kind < .98:
            rows = "".join("<tr>" + "".join(f"<td>{say(self.phrase(1, 4))}</td>" for _ in range(3)) + "</tr>"
                           for _ in range(self.rng.randrange(1, 4)))
            return f"<table>{rows}</table>"
        return f'<figure><img src="x.png"><figcaption>{say(self.sentences(1, 1))}</figcaption></figure>'

    def comments(self) -> str:
        def one() -> str:
            who = f"<div>{self.said(self.phrase(1, 2), False)}</div>" if self.rng.random() < .6 else ""
            text = self.said(self.sentences(1, 4), False)
            body = f"<p>{text}</p>" if self.rng.random() < .7 else f"<div>{text}</div>"
            shell = self.rng.choice(["li", "div", "article"]) if self.named > .3 else "div"
            mark = ' class="comment"' if self.rng.random() < max(self.named, .5) or shell == "article" else ""
            return f"<{shell}{mark}>{who}{body}</{shell}>"

        head = f"<h3>{self.said(self.phrase(1, 3), False)}</h3>" if self.rng.random() < .6 else ""
        return head + "".join(one() for _ in range(self.rng.randrange(1, 6)))

    def form(self) -> str:
        out = ""
        if self.rng.random() < .7:
            out += f"<label>{self.said(self.phrase(1, 4), False)}</label><br>" if False else \
                f"<p>{self.said(self.phrase(2, 8), False)}</p>"
        out += '<input type="text" name="q">'
        return out + f"<button>{self.said(self.phrase(1, 2), False)}</button>"

    def sidebar(self) -> str:
        out = f"<h3>{self.said(self.phrase(1, 4), False)}</h3>" if self.rng.random() < .6 else ""
        return out + (self.links() if self.rng.random() < .7 else self.plain(1, 3))

    def other(self, part: str) -> str:
        inside = {"menu": self.links, "header": lambda: f"<h2>{self.said(self.phrase(1, 4), False)}</h2>" if self.rng.random() < .6
                  else self.links(), "sidebar": self.sidebar, "notice": lambda: self.plain(1, 3),
                  "advert": lambda: self.plain(1, 2) if self.rng.random() < .7 else self.links(1, 3),
                  "form": self.form, "comments": self.comments, "share": lambda: self.links(2, 5),
                  "footer": lambda: self.links() if self.rng.random() < .4 else self.said(
                      "© " * (self.rng.random() < .6) + self.phrase(2, 12) + "." * (self.rng.random() < .6), False)}
        return self.within(part, inside[part])

    def some(self, chances: dict[str, float]) -> str:
        parts = [p for p, c in chances.items() if self.rng.random() < c]
        if self.rng.random() < .3:
            self.rng.shuffle(parts)
        return "".join(self.other(p) for p in parts)

    def article(self) -> str:
        body = ""
        if self.rng.random() < .85:
            level = "1" if self.rng.random() < .85 else "2"
            body += f"<h{level}>{self.said(self.phrase(2, 12), True)}</h{level}>"
        if self.rng.random() < .15:
            body += self.other("share")
        for _ in range(self.rng.choice([1, 1, 2, 3, 4, 5, 6, 8, 12, 20])):
            body += self.paragraph()
            if self.rng.random() < .05:
                body += self.other(self.rng.choice(["advert", "sidebar", "form", "notice"]))
        tag = self.rng.choice(["article", "article", "main", "div", "section", "td"])
        marked = self.attributes(ARTICLE) if tag in ("div", "section") or self.rng.random() < .5 else ""
        if tag == "td":
            return f"<table><tr><td{marked}>{body}</td></tr></table>"
        return f"<{tag}{marked}>{body}</{tag}>"

    def page(self) -> tuple[str, str]:
        head = f"<head><title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        before = self.some({"notice": .2, "header": .45, "menu": .7, "form": .15, "advert": .35, "sidebar": .15})
        middle = self.article()
        after = self.some({"share": .2, "advert": .2, "comments": .4, "sidebar": .35, "form": .2, "menu": .15, "notice": .1,
                           "footer": .8})
        body = before + middle + after
        if self.rng.random() < .3:
            body = f'<div class="{self.rng.choice(NEUTRAL)}">{body}</div>'
        tail = "" if self.rng.random() < .1 else "</body></html>"
        return (f"<!DOCTYPE html><html>{head}<body><!-- x -->{body}{tail}",
                "\n\n".join(t for t, main in self.blocks if main))


def labelled_page(seed: int) -> tuple[str, str]:
    """(html, main text) of one made page."""
    return Maker(seed).page()
