"""Labelled pages to train the extraction on: pages put together by rule, in which each main block starts with a mark.

Each page draws its own wrappers, names of classes, order of parts and texts. Names come from the vocabulary that web
pages use for such parts, with random ones between them, and a part of the pages has no names at all, so that tags,
texts and places must do.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from .html import MARK

#: Documented number of training pages.
PAGES = 1_000

#: Fixed vocabulary: what web pages call their parts.
NAMES = {
    "main": "content main-content article article-body post post-content entry-content story body-text page-content text prose single primary markdown".split(),
    "wrap": "wrapper container page site row layout grid inner root app outer col region center".split(),
    "nav": "nav navbar navigation main-menu menu topnav site-nav breadcrumbs breadcrumb tabs links pagination pager".split(),
    "header": "header site-header masthead banner top topbar brand logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal footer-links".split(),
    "aside": "sidebar side aside widget right-rail related recommended popular trending most-read teaser more-stories".split(),
    "ad": "ad ads advert advertisement sponsored promo ad-slot banner-ad adsbox sponsor".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter-notice message announcement warning".split(),
    "form": "form search-form newsletter subscribe login contact signup search".split(),
    "comments": "comments comment-list responses discussion replies thread disqus reader-comments feedback".split(),
    "comment": "comment reply comment-body response".split(),
    "share": "share social social-links sharing share-buttons tags tag-list meta toolbar actions".split(),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ei ch ie un ge sch que é è ai oi ción ado ra os ue ñ ver lich ß ü ä mi ka po lo ba".split()
SHORT = ["Home", "About us", "Contact", "Archive", "News", "Sport", "Log in", "Sign up", "Search", "Next", "Privacy", "Terms", "Help", "Shop", "Menu", "RSS"]
COOKIES = ["We use cookies to improve this site.", "Accept all cookies", "This site uses cookies; read more in our policy.", "Please update your browser.", "You have read your last free page."]
ADVERTS = ["Advertisement", "Sponsored", "Buy now and save", "Limited offer, order today"]


class Page:
    """One page in the making; every choice comes from its own generator of random numbers."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.8  # whether parts have telling names
        self.semantic = self.r.random() < 0.65  # whether parts have telling tags
        self.closed = self.r.random() < 0.7  # whether paragraphs and items are closed
        self.space = self.r.choice(["", "", "\n", "\n  "])

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join(self.word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high)))
        return text[:1].upper() + text[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 24).rstrip(",") + self.r.choice("......?!") for _ in range(self.r.randint(low, high)))

    def attributes(self, part: str) -> str:
        r = self.r
        kinds = [r.choice(NAMES[part])] if self.named and (part not in ("main", "wrap") or r.random() < 0.8) else []
        if r.random() < 0.3:
            kinds.append(r.choice(["c-" + self.word()[:3] + str(r.randint(1, 99)), "x" + str(r.randint(10, 9999)), *NAMES["wrap"]]))
        r.shuffle(kinds)
        out = ""
        if kinds and r.random() < 0.25:
            out += f' id="{kinds.pop()}"'
        if kinds:
            quote = r.choice(['"', '"', "'"])
            out += f" class={quote}{' '.join(kinds)}{quote}"
        return out

    def put(self, tag: str, inner: str, part: str | None = None, close: bool = True) -> str:
        return f"<{tag}{self.attributes(part) if part else ''}>{inner}" + (f"</{tag}>" if close else "") + self.space

    def links(self, low: int, high: int) -> str:
        r = self.r
        one = [f'<a href="/{self.word()}">{r.choice(SHORT) if r.random() < 0.3 else self.words(1, 4)}</a>' for _ in range(r.randint(low, high))]
        kind = r.random()
        if kind < 0.6:
            return self.put("ul", "".join(self.put("li", x, close=self.closed) for x in one))
        return r.choice([" | ", " ", " · ", "\n"]).join(one)

    # parts beside the article

    def nav(self) -> str:
        return self.put("nav" if self.semantic or self.r.random() < 0.5 else "div", self.links(3, 9), "nav")

    def header(self) -> str:
        inner = self.r.choice([f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 3)}</div><p>{self.words(3, 9)}</p>", f"<h2>{self.words(1, 3)}</h2>"])
        if self.r.random() < 0.5:
            inner += self.nav()
        if self.r.random() < 0.3:
            inner += self.form()
        return self.put("header" if self.semantic else "div", inner, "header")

    def footer(self) -> str:
        r = self.r
        inner = r.choice(["&copy; 2019 ", "© ", "Copyright ", "&copy; ", ""]) + self.words(1, 4) + r.choice([" &middot; ", ". ", " - "]) + r.choice([self.sentences(1, 1), self.links(2, 5), self.words(2, 8)])
        if r.random() < 0.5:
            inner = self.put("p", inner) + (self.put("p", self.sentences(1, 2)) if r.random() < 0.5 else "")
        if r.random() < 0.3:
            inner = self.links(3, 8) + inner
        return self.put("footer" if self.semantic or r.random() < 0.4 else "div", inner, "footer")

    def aside(self) -> str:
        r = self.r
        inner = self.put(r.choice(["h2", "h3", "h4", "div"]), self.words(1, 3))
        inner += self.links(3, 8) if r.random() < 0.6 else "".join(self.put("p", self.sentences(1, 2)) for _ in range(r.randint(1, 3)))
        keep, self.named = self.named, True
        out = self.put("aside" if self.semantic or r.random() < 0.3 else "div", inner, "aside")
        self.named = keep
        return out

    def ad(self) -> str:
        r = self.r
        text = r.choice([r.choice(ADVERTS), self.sentences(1, 3), f'<a href="//x">{self.sentences(1, 1)}</a>', f"<p>{self.sentences(1, 2)}</p>"])
        tag = r.choice(["div", "div", "aside", "section", "ins"])
        keep, self.named = self.named, True  # an advert that nothing tells apart is no lesson
        out = f"<!-- {r.choice(NAMES['ad'])} -->" * (r.random() < 0.3) + self.put(tag, text, "ad")
        self.named = keep
        return out

    def notice(self) -> str:
        r = self.r
        text = r.choice([r.choice(COOKIES), self.sentences(1, 2)])
        keep, self.named = self.named, True
        out = self.put(r.choice(["div", "div", "section", "p", "dialog", "aside"]), r.choice([text, f"<p>{text}</p>", f"<p>{text}</p><button>OK</button>"]), "notice")
        self.named = keep
        return out

    def form(self) -> str:
        r = self.r
        inner = r.choice(['<input name="q">', f"<label>{self.words(1, 3)} <input></label>", f"<p>{self.sentences(1, 1)}</p><input type=email>", f"<fieldset><legend>{self.words(1, 3)}</legend><label>{self.words(1, 2)}</label><select><option>a</option></select></fieldset>"])
        return self.put("form", inner + "<button>Go</button>", "form" if r.random() < 0.6 else None)

    def comments(self) -> str:
        r = self.r
        keep, self.named = self.named, True
        one = []
        for _ in range(r.randint(1, 6)):
            body = r.choice([f"<p>{self.sentences(1, 4)}</p>", self.sentences(1, 3), f"<b>{self.words(1, 2)}</b> <span>{r.randint(1, 9)} days ago</span><p>{self.sentences(1, 3)}</p>"])
            one.append(self.put(r.choice(["div", "li", "article", "section"]), body, "comment"))
        inner = (self.put(r.choice(["h2", "h3"]), r.choice(["Comments", f"{len(one)} comments", self.words(1, 3)])) if r.random() < 0.7 else "") + "".join(one) + (self.form() if r.random() < 0.4 else "")
        out = self.put(r.choice(["section", "div", "div", "ol", "aside"]), inner, "comments")
        self.named = keep
        return out

    def share(self) -> str:
        keep, self.named = self.named, True
        out = self.put(self.r.choice(["div", "ul", "p"]), self.r.choice([self.links(2, 5), "Share this", self.words(1, 3)]), "share")
        self.named = keep
        return out

    # the article

    def inline(self, text: str) -> str:
        r = self.r
        parts = text.split(" ")
        if len(parts) > 4 and r.random() < 0.4:
            k = r.randrange(len(parts) - 2)
            tag = r.choice(["b", "i", "em", "strong", "code", "span", 'a href="/x"'])
            parts[k] = f"<{tag}>{parts[k]}"
            parts[k + 1] += f"</{tag.split()[0]}>"
        if r.random() < 0.1:
            parts.insert(r.randrange(len(parts)), r.choice(["&amp;", "&lt;", "&nbsp;", "<br>", "&quot;", "<!-- x -->"]))
        return " ".join(parts)

    def main_block(self) -> str:
        r = self.r
        kind = r.random()
        text = lambda low, high: MARK + self.inline(self.sentences(low, high))
        if kind < 0.62:
            return self.put("p", text(1, 6), close=self.closed)
        if kind < 0.68:
            return self.put("p", text(1, 1)[: r.randint(12, 60)].rsplit("<")[0].rsplit("&")[0], close=self.closed)
        if kind < 0.77:
            return self.put(r.choice(["h2", "h2", "h3", "h4"]), MARK + self.words(1, 8))
        if kind < 0.84:
            return self.put(r.choice(["ul", "ol"]), "".join(self.put("li", MARK + self.inline(r.choice([self.words(1, 8), self.sentences(1, 2)])), close=self.closed) for _ in range(r.randint(2, 5))))
        if kind < 0.89:
            return self.put("blockquote", r.choice([text(1, 2), f"<p>{text(1, 2)}</p>"]))
        if kind < 0.92:
            return self.put("pre", MARK + self.words(3, 20))
        if kind < 0.95:
            return self.put("figure", f"<img src=a.jpg><figcaption>{MARK}{self.words(2, 10)}</figcaption>")
        if kind < 0.97:
            return self.put("table", "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))))
        return self.put("div", text(1, 4))

    def article(self) -> str:
        r = self.r
        title = self.put(r.choice(["h1", "h1", "h1", "h2"]), MARK + r.choice([self.words(2, 10), self.words(2, 10) + "."]))
        blocks = [self.main_block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 20]))]
        for make, chance in ((self.ad, 0.2), (self.share, 0.2), (self.aside, 0.15), (self.form, 0.1), (self.notice, 0.1), (self.nav, 0.05)):
            if r.random() < chance:
                blocks.insert(r.randrange(len(blocks) + 1), make())
        if r.random() < 0.12:
            blocks.append(self.comments())
        if r.random() < 0.5 and self.semantic:
            title = self.put("header", title)
        kind = r.random()
        if kind < 0.15:
            title = "" if r.random() < 0.5 else title
        inner = title + "".join(blocks)
        if self.semantic:
            tag = r.choice(["article", "article", "article", "main"])
            inner = self.put(tag, inner, "main" if r.random() < 0.4 else None)
            return self.put(r.choice(["main", "div"]), inner, "wrap") if r.random() < 0.4 else inner
        if r.random() < 0.1:
            return f"<table><tr><td>{self.links(3, 6)}</td>{self.put('td', inner, 'main')}</tr></table>"
        return self.put(r.choice(["div", "div", "section"]), inner, "main")

    def build(self) -> str:
        r = self.r
        before = [make() for make, chance in ((self.notice, 0.2), (self.header, 0.5), (self.nav, 0.7), (self.ad, 0.4), (self.form, 0.1), (self.aside, 0.12)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [make() for make, chance in ((self.share, 0.15), (self.aside, 0.4), (self.comments, 0.3), (self.ad, 0.2), (self.form, 0.1), (self.nav, 0.15), (self.notice, 0.1)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(after)
        body = "".join(before) + self.article() + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.3:
            body = self.put("div", body, "wrap")
        head = f"<head><meta charset=utf-8><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='<p>x</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{self.space}{body}</body></html>"
        return page[: r.randrange(len(page) // 2, len(page))] if r.random() < 0.08 else page


def pages(n: int = PAGES, seed: int = 0) -> list[str]:
    """n labelled pages; the same seed gives the same pages."""
    return [Page(seed * 1_000_003 + i).build() for i in range(n)]


def labelled_pages(spark: SparkSession, n: int = PAGES) -> DataFrame:
    """The training pages as a table: html."""
    return spark.createDataFrame([(p,) for p in pages(n)], "html string")
