"""Labelled pages to train the block labeller on: invented pages in many layouts, with the blocks of their main text.

Layouts vary in what holds the article, what stands before, within and after it, whether names are telling, and how long
and how well closed its blocks are, so that no single sign decides."""

from __future__ import annotations

import random
from html import escape

#: Syllables of invented words, by language; fixed values.
SYLLABLES = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve",
    "en er ch de ei te in ie ge un nd st be es un zu au ü ö ä ß sch ver lich",
    "le de es en re nt on er te el an qu ou ai é è ê ç ie eu",
    "de la os en er es que ar ión ado ll ñ ó í á ta mo",
)


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, set()
        self.syllables = rng.choice(SYLLABLES).split()
        self.telling = rng.random() < 0.75

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 4)))

    def words(self, low: int, high: int, stop: str = "") -> str:
        own = [self.word() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.3:
            own = [w + self.rng.choice(("", "", ",", "###", "$$$", "&", "***", "%")) for w in own]
        return " ".join(own).capitalize() + stop

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(1, 16, ".") for _ in range(self.rng.randint(low, high)))

    def name(self, *choices: str) -> str:
        if not self.telling and self.rng.random() < 0.7:
            return self.rng.choice(("", ' class="c1"', ' class="row"', ' id="x7"'))
        return self.rng.choice((' class="{}"', ' id="{}"', ' class="col {}"', " class='{} wide'")).format(self.rng.choice(choices))

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{i}">{escape(self.words(1, 3))}</a>' for i in range(self.rng.randint(low, high))]
        return self.rng.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def nav(self) -> str:
        return self.rng.choice((f"<nav>{self.links()}</nav>", f"<div{self.name('nav', 'menu', 'navigation', 'breadcrumbs')}>{self.links()}</div>", f"<nav><p>{escape(self.words(1, 4))}</p>{self.links()}</nav>"))

    def ad(self) -> str:
        inner = self.rng.choice((escape(self.prose(1, 3)), f"<p>{escape(self.prose(1, 2))}</p>", f'<a href="http://ad.example">{escape(self.words(2, 6))}</a>'))
        return self.rng.choice(("<div class=\"ad\">{}</div>", "<div class='advert'>{}</div>", '<div id="banner-ad">{}</div>', '<aside class="promo">{}</aside>', '<section class="sponsored">{}</section>')).format(inner)

    def notice(self) -> str:
        text = escape(self.rng.choice(("We use cookies. ", "", "", "Subscribe now. ")) + self.prose(1, 3))
        return self.rng.choice(('<div class="cookie-notice"><p>{}</p><button>{}</button></div>', '<div id="consent">{}<button>{}</button></div>', '<div role="alert" class="notice">{} <a href="#">{}</a></div>', '<dialog class="newsletter">{}<button>{}</button></dialog>')).format(text, escape(self.words(1, 2)))

    def form(self) -> str:
        return f'<form{self.name("search", "login", "contact-form")}><label>{escape(self.words(1, 3))}</label><input name="q"><p>{escape(self.prose(1, 2))}</p><button>{escape(self.words(1, 2))}</button><select><option>{escape(self.words(1, 2))}<option>{escape(self.words(1, 2))}</select></form>'

    def sidebar(self) -> str:
        inner = f"<h3>{escape(self.words(1, 4))}</h3>" + self.rng.choice((self.links, lambda: f"<p>{escape(self.prose(1, 3))}</p>", lambda: f"<p>{escape(self.prose(1, 2))}</p>" + self.links()))()
        return self.rng.choice((f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div class="related widget">{inner}</div>', f'<aside class="related">{inner}</aside>'))

    def comments(self) -> str:
        one = lambda: self.rng.choice(("<li class=\"comment\"><b>{}</b><p>{}</p></li>", '<div class="comment"><span>{}</span> <p>{}</p></div>', '<div class="comment-body"><h4>{}</h4>{}</div>')).format(escape(self.words(1, 2)), escape(self.prose(1, 4)))
        inner = f"<h2>{escape(self.words(1, 3))}</h2>" + "".join(one() for _ in range(self.rng.randint(1, 6)))
        return self.rng.choice((f'<section id="comments">{inner}</section>', f'<div class="comments">{inner}</div>', f'<ol class="comment-list">{inner}</ol>', f'<section class="reader-comments">{inner}</section>'))

    def header(self) -> str:
        inner = self.rng.choice((f"<h1>{escape(self.words(1, 3))}</h1>", f'<a href="/">{escape(self.words(1, 3))}</a>', f"<p>{escape(self.words(1, 6))}</p>", f"<div>{escape(self.words(1, 4))}</div>{self.nav()}", f"<h2>{escape(self.words(1, 3))}</h2><p>{escape(self.prose(1, 1))}</p>"))
        return self.rng.choice((f"<header>{inner}</header>", f'<div id="header">{inner}</div>', f'<header class="site-header">{inner}</header>'))

    def footer(self) -> str:
        inner = self.rng.choice((f"&copy; example &middot; {escape(self.prose(1, 1))}", f"<p>&copy; 2020 {escape(self.words(1, 4))}</p>{self.links(1, 5)}", f"<p>{escape(self.prose(1, 2))}</p>", f"{escape(self.words(2, 6))} All rights reserved."))
        return self.rng.choice((f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f"<footer{self.name('site-footer', 'bottom')}>{inner}</footer>"))

    def block(self) -> str:
        """One block of the main text, in some markup."""
        r = self.rng.random()
        text = self.words(1, 6) if r < 0.12 else self.prose(1, 1) if r < 0.3 else self.prose(1, 12)
        self.main.add(" ".join(text.split()))
        parts = text.split(" ")
        if len(parts) > 3 and self.rng.random() < 0.35:
            k = self.rng.randrange(len(parts) - 1)
            tag = self.rng.choice(("b", "em", "a href='/w'", "span", "strong", "code"))
            shown = " ".join([*map(escape, parts[:k]), f"<{tag}>{escape(parts[k])}</{tag.split()[0]}>", *map(escape, parts[k + 1 :])])
        else:
            shown = escape(text)
        if self.rng.random() < 0.25:
            shown = shown.replace(" ", "\n  ", 1)
        tag = self.rng.choices(("p", "p-open", "b-br", "h2", "h3", "li", "blockquote", "div", "pre", "td", "figcaption", "dd"), (50, 10, 8, 6, 4, 6, 4, 6, 2, 2, 2, 1))[0]
        wrap = {"p-open": "<p>{}", "b-br": "<p><b>{}<br>", "li": "<ul><li>{}</li></ul>", "blockquote": "<blockquote><p>{}</p></blockquote>", "td": "<table><tr><td>{}</td></tr></table>", "figcaption": "<figure><figcaption>{}</figcaption></figure>", "dd": "<dl><dd>{}</dd></dl>"}
        return wrap.get(tag, f"<{tag}>{{}}</{tag}>").format(shown)

    def article(self) -> str:
        title = self.words(1, 12)
        self.main.add(" ".join(title.split()))
        heading = self.rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", '<h1 class="title">{}</h1>', '<div class="entry-header"><h1>{}</h1></div>')).format(escape(title))
        body = [self.block() for _ in range(self.rng.choice((1, 2, 3, 5, 8, 12, 20)))]
        for extra, p in ((self.ad, 0.25), (self.sidebar, 0.15), (self.notice, 0.12), (self.form, 0.12), (self.share, 0.15)):
            if self.rng.random() < p:
                body.insert(self.rng.randint(0, len(body)), "</p>" * (self.rng.random() < 0.5) + extra())
        if self.rng.random() < 0.2:
            body.append(self.comments())
        if self.rng.random() < 0.15:
            body.append(f"<footer>{self.links(1, 4)}</footer>")
        inner = (heading if self.rng.random() < 0.85 else "") + "".join(body)
        if heading not in inner:
            self.main.discard(" ".join(title.split()))
        return self.rng.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="post-content">{inner}</div>', f'<div id="content">{inner}</div>', f'<section class="story">{inner}</section>', f'<div class="entry"><div>{inner}</div></div>', f"<div>{inner}</div>", inner))

    def share(self) -> str:
        return f'<div class="share">{self.links(2, 4)}</div>'

    def html(self) -> str:
        pick = lambda p, *makers: "".join(m() for m in makers if self.rng.random() < p)
        before = pick(0.5, self.header, self.nav, self.ad) + pick(0.2, self.notice, self.form, self.sidebar)
        after = pick(0.3, self.sidebar, self.comments, self.ad) + pick(0.15, self.form, self.notice, self.nav)
        end = pick(0.75, self.footer) + pick(0.1, self.notice)
        title = escape(self.words(2, 8))
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        return (head if self.rng.random() < 0.9 else "") + before + "<!-- c -->" + self.article() + after + end + "</body></html>" * (self.rng.random() < 0.8)


def labelled_pages(pages: int = 500, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, texts of the main blocks) of so many pages; the same for the same seed."""
    out = []
    for i in range(pages):
        page = _Page(random.Random(seed * 1_000_003 + i))
        out.append((page.html(), page.main))
    return out
