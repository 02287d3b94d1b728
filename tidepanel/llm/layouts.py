"""Labelled pages for the extraction model: the main blocks of a page in other layouts, with other names and other things around them.

A page whose own markup tells its article teaches only that markup. So its blocks are laid out anew, by chance: in containers named in other
ways or not at all, beside menus, notices, adverts, forms, sidebars and comments whose paragraphs come from other pages, so that neither words nor
lengths alone tell.
"""

from __future__ import annotations

import random
from html import escape

# Names that pages commonly give to their parts.
MAIN = """content post entry entry-content post-content article-body article story story-body main main-content body-text text page-content single
    blog-post post-body articleBody content-body news-text rich-text prose""".split()
WRAPPERS = "page wrapper container row site layout inner col-8 grid app root outer primary column".split()
MENUS = "nav navbar menu main-menu navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager tags categories skip-links".split()
ADVERTS = "ad ads advert advertisement banner sponsor sponsored promo promotion adsbox teaser-ad commercial".split()
NOTICES = "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal overlay subscribe newsletter paywall disclaimer warning message".split()
SIDES = "sidebar side aside widget rail related related-posts recommended popular trending more-stories read-next author-box bio share social sharing toc".split()
FOOTERS = "footer site-footer bottom copyright legal imprint credits colophon".split()
HEADERS = "header site-header masthead top branding logo hero-bar".split()
COMMENTS = "comments comment-list discussion responses replies respond disqus thread reader-comments feedback reviews".split()
COMMENT = "comment reply comment-body response review message".split()


class Layouts:
    def __init__(self, seed: str, texts: list[str]):
        self.rng = random.Random(seed)
        self.texts = texts

    def words(self, least: int, most: int) -> str:
        """Some words in a row of another page, or of letters by chance where there is none."""
        n = self.rng.randint(least, most)
        if self.texts and self.rng.random() < 0.9:
            own = self.rng.choice(self.texts).split()
            at = self.rng.randrange(max(1, len(own) - n + 1))
            return " ".join(own[at : at + n])
        return " ".join("".join(self.rng.choice("etaoinshrdlu") for _ in range(self.rng.randint(2, 9))) for _ in range(n)).capitalize() + "."

    def named(self, names: list[str]) -> str:
        if self.rng.random() < 0.12:
            return ""
        own = self.rng.choice(names)
        if self.rng.random() < 0.3:
            own = self.rng.choice(["", "c-", "js-", "site-", "x_"]) + own + self.rng.choice(["", "-1", "__inner", "-wrap", "Box"])
        return f' {self.rng.choice(["class", "class", "id"])}="{own}"'

    def element(self, tags: str, names: list[str], inner: str) -> str:
        tag = self.rng.choice(tags.split())
        return f"<{tag}{self.named(names)}>{inner}</{tag}>"

    def links(self, least: int, most: int) -> str:
        own = [f'<a href="/{i}">{escape(self.words(1, 6))}</a>' for i in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in own) + "</ul>"
        return " | ".join(own)

    def paragraphs(self, most: int, longest: int) -> str:
        return "".join(f"<p>{escape(self.words(3, longest))}</p>" for _ in range(self.rng.randint(1, most)))

    def advert(self) -> str:
        inner = self.rng.choice([escape(self.words(3, 25)), self.paragraphs(2, 20), f'<a href="#">{escape(self.words(2, 12))}</a>'])
        return self.element("div div aside section", ADVERTS, inner)

    def notice(self) -> str:
        inner = self.rng.choice([self.paragraphs(2, 40), escape(self.words(5, 40)), f"<p>{escape(self.words(5, 30))}</p><form><input><button>ok</button></form>"])
        return self.element("div div section aside dialog", NOTICES, inner)

    def form(self) -> str:
        return f"<form{self.named(NOTICES)}><label>{escape(self.words(1, 4))}</label><input><p>{escape(self.words(2, 25))}</p><button>go</button></form>"

    def side(self) -> str:
        cards = "".join(f"<article{self.named(SIDES)}><h3>{escape(self.words(2, 8))}</h3><p>{escape(self.words(5, 40))}</p></article>" for _ in range(self.rng.randint(1, 3)))
        inner = self.rng.choice([f"<h3>{escape(self.words(1, 4))}</h3>{self.links(2, 8)}", self.paragraphs(3, 80), cards, self.links(2, 8)])
        return self.element("aside aside div section", SIDES, inner)

    def comments(self) -> str:
        each = [self.element("li article div div", COMMENT, self.rng.choice([f"<h4>{escape(self.words(1, 3))}</h4>", f"<span>{escape(self.words(1, 2))}</span>", ""]) + self.paragraphs(3, 120)) for _ in range(self.rng.randint(1, 6))]
        inner = self.rng.choice(["", f"<h3>{escape(self.words(1, 3))}</h3>"]) + "".join(each) + self.rng.choice(["", self.form()])
        return self.element("section div div ol aside", COMMENTS, inner)

    def header(self) -> str:
        title = self.rng.choice(["h1", "div", "p", "h2", "span"])
        return self.element("header header div", HEADERS, f"<{title}>{escape(self.words(1, 5))}</{title}>" + self.rng.choice(["", self.menu(), self.form()]))

    def menu(self) -> str:
        return self.element("nav nav div div", MENUS, self.links(2, 10))

    def footer(self) -> str:
        return self.element("footer footer div", FOOTERS, self.rng.choice([f"&copy; {escape(self.words(2, 14))}", self.paragraphs(2, 30), self.links(2, 6) + escape(self.words(2, 12))]))

    def some(self, *parts, chance: float = 0.45) -> str:
        return "".join(p() for p in self.rng.sample(parts, len(parts)) if self.rng.random() < chance)

    def page(self, blocks: list[tuple[str, str]]) -> str:
        """A page whose main text is ``blocks``: pairs of tag and text."""
        own: list[str] = []
        for tag, text in blocks:
            tag = tag if tag in ("h1", "h2", "h3", "blockquote", "pre") else self.rng.choice(["p", "p", "p", "p", "li", "div", "h2"])
            own.append(f"<ul><li>{escape(text)}</li></ul>" if tag == "li" else f"<{tag}>{escape(text)}</{tag}>")
            if self.rng.random() < 0.12:
                own.append(self.some(self.advert, self.side, self.notice, self.form, chance=0.4))
        if self.rng.random() < 0.3:
            own.append(self.comments())
        if self.rng.random() < 0.3:
            own.append(self.side())
        main = self.element("article article main div div div section", MAIN, "".join(own))
        if self.rng.random() < 0.4:
            main = self.element("main div div", WRAPPERS + MAIN[:4], self.some(self.menu, self.advert, chance=0.2) + main + self.some(self.side, self.comments, chance=0.3))
        before = self.some(self.header, self.menu, self.notice, self.advert)
        beside = self.some(self.side, self.advert, self.form, chance=0.4)
        after = self.some(self.comments, self.footer, self.side, self.notice, chance=0.4)
        inner = before + (main + beside if self.rng.random() < 0.6 else beside + main) + after
        if self.rng.random() < 0.4:
            inner = self.element("div div main", WRAPPERS, inner)
        return f"<!DOCTYPE html><html><head><title>{escape(self.words(1, 9))}</title></head><body>{inner}</body></html>"
