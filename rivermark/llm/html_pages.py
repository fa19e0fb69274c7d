"""Labelled pages to train the extraction model on.

There are no labelled pages among the tables, so a fixed set is laid out by rules: the
usual places of an article (semantic tags, named containers, tables, nothing but
paragraphs) among the usual surroundings. The words are invented; only structure, lengths
and names of elements differ between content and the rest. Each text carries its label.
"""

from __future__ import annotations

import random

#: Elements around articles: (opening, closing) with attributes.
ARTICLES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"),
    ('<div class="entry-content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="article-body">', "</div>"),
    ('<section class="story">', "</section>"), ('<div class="text">', "</div>"), ('<td class="main">', "</td>"), ("<div>", "</div>"),
    ("<main><article>", "</article></main>"), ('<div class="content"><article>', "</article></div>"),
    ('<article class="post">', "</article>"), ('<article class="entry">', "</article>"), ('<article id="story">', "</article>"), ('<article class="article">', "</article>"),
    ('<main id="main">', "</main>"), ('<div id="main">', "</div>"), ('<div class="main"><div class="inner">', "</div></div>"), ('<div role="main">', "</div>"),
)
MENUS = ('<nav>{}</nav>', '<div class="menu">{}</div>', '<ul class="nav">{}</ul>', '<div id="navigation">{}</div>', '<div class="breadcrumb">{}</div>', '<header><nav>{}</nav></header>', '<ul>{}</ul>')
HEADERS = ('<header>{}</header>', '<div id="header">{}</div>', '<div class="site-header">{}</div>', '<div class="masthead">{}</div>', '<div class="logo">{}</div>')
FOOTERS = ('<footer>{}</footer>', '<div id="footer">{}</div>', '<div class="footer">{}</div>', '<div class="copyright">{}</div>', '<footer><p>{}</p></footer>')
SIDES = ('<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="widget">{}</div>', '<div class="related">{}</div>', '<aside class="recommended">{}</aside>', '<section class="related-posts">{}</section>')
NOTICES = ('<div class="cookie-notice">{}</div>', '<div class="notice">{}</div>', '<div id="consent-banner">{}</div>', '<div class="alert">{}</div>', '<div role="alert">{}</div>', '<div class="newsletter">{}</div>', '<div class="subscribe">{}</div>', '<div class="popup modal">{}</div>')
ADS = ('<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="banner">{}</div>', '<div class="promo">{}</div>', '<div class="sponsored">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<div id="ad-top">{}</div>', '<aside class="ad">{}</aside>')
FORMS = ('<form>{}<input><button>{}</button></form>', '<form class="search"><label>{}</label><input></form>', '<div class="login"><form>{}</form></div>', '<form><select><option>{}</option></select></form>')
COMMENTS = ('<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div id="disqus_thread">{}</div>', '<div class="reader-comments">{}</div>', '<section class="comments"><h3>@</h3>{}</section>')
SHARES = ('<div class="share">{}</div>', '<div class="social">{}</div>', '<ul class="tags">{}</ul>', '<div class="author-bio">{}</div>', '<div class="meta byline">{}</div>')


#: Places on a page that say nothing by their names; the same names stand around other things too.
PLAIN = ('<article class="{n}">{}</article>', "<div><div>{}</div></div>", "<div>{}</div>", '<div class="{n}">{}</div>', '<section class="{n}">{}</section>', '<div id="{n}">{}</div>', "<section>{}</section>", '<div class="{n}"><div class="{n}">{}</div></div>')


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        syllables = ("an", "ber", "co", "de", "el", "fi", "ga", "ho", "in", "ju", "ka", "lo", "mi", "no", "or", "pa", "re", "st", "ti", "un")
        return " ".join("".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(n))

    def sentence(self) -> str:
        return self.words(self.r.randint(4, 22)).capitalize() + self.r.choice("...!?")

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(least, most)))

    def links(self, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/x'>{self.words(self.r.randint(1, 3))}</a></{tag}>" for _ in range(self.r.randint(2, 8)))

    def name(self) -> str:
        """A name that is like no other."""
        return "".join(self.r.choice("bcdfgklmnprstvz") + self.r.choice("aeiou") for _ in range(3))

    def plain(self, inner: str) -> str:
        form = self.r.choice(PLAIN)
        return form.replace("{n}", self.name()).replace("{}", inner)

    def listing(self) -> str:
        """A list that belongs to an article: short and long items, few links."""
        r = self.r
        item = lambda: r.choice((self.words(r.randint(1, 4)), self.words(r.randint(2, 7)), self.sentence()))
        kind = r.randrange(4)
        if kind == 0:
            return "<dl>" + "".join(f"<dt>{self.words(r.randint(1, 3))}</dt><dd>{r.choice((self.sentence(), self.words(5)))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        if kind == 1:
            return "<table>" + "".join(f"<tr><th>{self.words(1)}</th><td>{self.words(r.randint(1, 4))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        tag = r.choice(("ul", "ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{r.choice((item(), item(), '<p>' + item() + '</p>'))}</li>" for _ in range(r.randint(2, 7))) + f"</{tag}>"

    def figure(self) -> str:
        return f"<figure><img src='x'><figcaption>{self.r.choice((self.sentence(), self.words(4)))}</figcaption></figure>"

    def legal(self) -> str:
        """Small print without a telling element."""
        r = self.r
        inner = r.choice((f"&copy; {r.randint(1998, 2026)} {self.words(2)}", f"{self.words(3).capitalize()}. {self.words(3).capitalize()}.", f"{self.words(3)} | {self.words(2)}", self.sentence()))
        return r.choice(('<div class="legal">{}</div>', '<p class="legal">{}</p>', '<div class="terms">{}</div>', '<div class="disclaimer">{}</div>', '<small class="copyright">{}</small>', '<div id="legal-notice">{}</div>')).format(inner)

    def boilerplate(self) -> str:
        r = self.r
        kind = r.randrange(12)
        if kind == 9:
            return self.legal()
        if kind == 10:
            # A menu without a telling name, its links in blocks or around them.
            inner = r.choice((self.links("div"), self.links("li"), "".join(f"<a href='/x'><div>{self.words(2)}</div></a>" for _ in range(r.randint(3, 6)))))
            return self.plain(f"<ul>{inner}</ul>" if "<li>" in inner else inner)
        if kind == 11:
            return r.choice((f"<noscript>{self.sentence()}</noscript>", f"<noscript><p>{self.sentence()}</p></noscript>", f"<dialog><p>{self.sentence()}</p></dialog>"))
        if kind == 0:
            return r.choice(MENUS).format(r.choice((f"<ul>{self.links()}</ul>", self.links(), self.links("span"))))
        if kind == 1:
            return r.choice(HEADERS).format(r.choice((self.words(3), f"<h1>{self.words(2)}</h1>", f"<h1>{self.words(2)}</h1><p>{self.words(r.randint(2, 6))}</p>", f"<p>{self.words(r.randint(2, 6))}</p>", f"<a href='/'>{self.words(2)}</a><p>{self.sentence()}</p>")))
        if kind == 2:
            return r.choice(SIDES).format(r.choice((f"<h3>{self.words(2)}</h3><ul>{self.links()}</ul>", f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2))))
        if kind == 3:
            return r.choice(NOTICES).format(r.choice((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p><button>{self.words(1)}</button>")))
        if kind in (4, 5):
            return r.choice(ADS).format(r.choice((self.prose(1, 4), f"<p>{self.prose(1, 3)}</p>", f"<a href='/ad'>{self.words(6)}</a>")))
        if kind == 6:
            return r.choice(FORMS).format(self.words(3), self.words(1))
        if kind == 7:
            return r.choice(SHARES).format(r.choice((self.links("span"), self.words(4), f"<p>{self.prose(1, 2)}</p>")))
        body = "".join(f'<{t} class="comment"><p>{self.prose(1, 5)}</p></{t}>' for t in [r.choice(("div", "li", "article"))] * r.randint(1, 5))
        return r.choice(COMMENTS).format(body).replace("@", self.words(1))

    def article(self, bare: bool = False) -> str:
        r = self.r
        title = r.choice((self.words(r.randint(2, 9)), self.sentence(), self.prose(1, 2)[:60]))
        parts = [r.choice((f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", "", f"<h2>{title}</h2>"))]
        short = r.random()
        if short < 0.22:
            few = self.words(r.randint(3, 9)) + "."
            return r.choice((f"<p>{few}</p>", f"<p>{few}</p>", f"<p>{self.prose(1, 1)}</p>", f"<h1>{title}</h1>{self.listing()}", f"<p>{self.prose(1, 1)}</p>{self.listing()}", f"<h1>{title}</h1><p>{few}</p>"))
        if short < 0.27 or bare and short < 0.8:
            # Nothing but blocks of sentences.
            tag = r.choice(("div", "div", "section"))
            return "".join(f"<{tag}>{self.prose(1, 2)}</{tag}>" for _ in range(r.randint(1, 5)))
        for _ in range(r.choice((1, 1, 2, 3, 5, 9))):
            parts.append(r.choices(
                (f"<p>{self.prose()}</p>", f"<p><b>{self.sentence()}<br><p>{self.prose()}", f"<h2>{self.words(4)}</h2>",
                 "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{self.prose(1, 2)}</p></blockquote>",
                 f"<div>{self.prose()}</div>", f"<p>{self.words(2)} <a href='/y'>{self.words(2)}</a> {self.prose()}</p>",
                 f"<pre>{self.words(9)}</pre>", f"<table><tr><td>{self.words(2)}</td><td>{self.words(2)}</td></tr></table>", f"<p>{self.words(3)}.</p>",
                 self.listing(), self.figure(), self.plain(f"<p>{self.prose()}</p>"), f"<p>{self.words(r.randint(2, 6))}</p>", f"<h3>{self.words(3)}</h3><p>{self.prose(1, 2)}</p>",
                 f"<p>{self.words(2)} &copy; {r.randint(1998, 2026)} {self.words(3)}</p>"),
                (12, 3, 2, 1, 1, 2, 3, 0.5, 0.5, 2, 4, 1, 2, 2, 1, 0.3))[0])
        return "".join(parts)


def labelled_pages(n: int = 480, seed: int = 3) -> list[list[tuple[str, bool]]]:
    """Pages as runs of (html, is content)."""
    pages = []
    for k in range(n):
        w = _Writer(seed * 1_000_003 + k)
        opening, closing = w.r.choice(ARTICLES)
        if w.r.random() < 0.4:
            # Content in blocks that say nothing, sometimes several of them.
            opening, closing = w.plain("\0").split("\0") if w.r.random() < 0.6 else ("", "")
            if w.r.random() < 0.3:
                opening, closing = f"<main>{opening}", f"{closing}</main>"
        inner = [(w.article(not opening), True)]
        if w.r.random() < 0.15:
            inner += [(closing + opening, False), (w.article(), True)]
        if w.r.random() < 0.45:
            inner += [(w.boilerplate(), False), ("<p>" + w.prose() + "</p>", True)]
        before = [(w.boilerplate(), False) for _ in range(w.r.randint(0, 4))]
        after = [(w.boilerplate(), False) for _ in range(w.r.randint(0, 4))]
        foot = [(w.r.choice(FOOTERS).format(w.r.choice((f"&copy; {w.words(3)} &middot; {w.sentence()}", w.prose(1, 2), f"<ul>{w.links()}</ul>"))), False)] * (w.r.random() < 0.8)
        middle = [(opening, False), *inner, (closing, False)]
        if opening.startswith("<td"):
            middle = [("<table><tr>", False), *middle, ("</tr></table>", False)]
        if w.r.random() < 0.15:
            # Hardly anything but the article, with or without the usual frame.
            before, after, foot = before[:1], [], foot if w.r.random() < 0.5 else []
        wrap = w.r.choice((("", ""), ('<div id="wrapper">', "</div>"), ('<div class="container"><div class="row">', "</div></div>")))
        pages.append([("<html><body>" + wrap[0], False), *before, *middle, *after, (wrap[1], False), *foot, ("</body></html>", False)])
    return pages
