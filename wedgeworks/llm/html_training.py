"""Labelled pages for the block classifier: made up, deterministic, of many layouts.

A page is put together from parts whose labels are known: an article's head, paragraphs, lists, tables and
quotes; and menus, mastheads, breadcrumbs, notices, adverts, forms, share bars, teasers, author boxes, reader
comments, sidebars and footers. Layouts differ in how much they tell: semantic elements, class words,
misleading class words, class names without meaning, whole pages in a form, articles that are teasers.
"""

from __future__ import annotations

import random

SYLLABLES = "an be ca der en fi go hu in ja ka lo mi nu or pa qui re sa te un ver wa xi yo zé ção ü".split()
CUES = "cookies newsletter subscribe share follow login comments advertisement sponsored copyright privacy terms imprint".split()


class PageMaker:
    """Makes pages; ``content`` holds the texts of the article's blocks."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.content: set[str] = set()

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def prose(self, n: int) -> str:
        out, left = [], n
        while left > 0:
            k = min(left, self.rng.randint(3, 18))
            left -= k
            parts = self.words(k).split(" ")
            for i in range(4, k, 6):
                if self.rng.random() < 0.5:
                    parts[i] += ","
            out.append(" ".join(parts).capitalize() + self.rng.choice(("." if self.rng.random() < 0.93 else "", ".", ".", "?", "!")))
        return " ".join(out)

    def kept(self, text: str) -> str:
        self.content.add(text)
        return text

    def name(self, said: str) -> str:
        """A class or id attribute that says so, or says nothing, by the page's habit."""
        if not said or self.habit == "plain":
            return ""
        if self.habit == "opaque":
            return f' class="c{self.rng.randrange(10**6)}"'
        form = self.rng.choice(("{}", "{}", "{}-wrapper", "site-{}", "{}-box", "{}_block", "page {}"))
        return f' {self.rng.choice(("class", "class", "id"))}="{form.format(said)}"'

    def box(self, tag: str, said: str, inner: str) -> str:
        """A part in its own element if the page is semantic, else in a div."""
        tag = tag if self.habit == "semantic" or (self.habit == "words" and self.rng.random() < 0.4) else "div"
        return f"<{tag}{self.name(said)}>{inner}</{tag}>"

    def links(self, n: int, longest: int = 3) -> str:
        items = [f'<a href="/{self.word()}">{self.words(self.rng.randint(1, longest)).capitalize()}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def paragraph(self) -> str:
        r = self.rng
        n = r.choice((1, 2, 4, 8, 15, 30, 30, 60, 60, 120))
        text = self.kept(self.prose(n))
        if n > 8 and r.random() < 0.3:  # links inside
            parts = text.split(" ")
            at = r.randrange(len(parts) - 3)
            return f"<p>{' '.join([*parts[:at], '<a href=x>' + ' '.join(parts[at:at + 2]) + '</a>', *parts[at + 2:]])}</p>"
        return f"<p>{text}</p>" if r.random() < 0.9 else f"<div>{text}</div>"

    def article(self) -> str:
        r = self.rng
        out = [f"<h1>{self.kept(self.words(r.randint(1, 10)).capitalize())}</h1>"]
        if r.random() < 0.3:
            out = [f"<header>{out[0]}</header>"] if self.habit == "semantic" else [f'<div class="post-header">{out[0]}</div>'] if self.habit == "words" else out
        if r.random() < 0.12:
            out = []  # no title
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.72:
                out.append(self.paragraph())
            elif k < 0.8:
                out.append(f"<h2>{self.kept(self.words(r.randint(1, 6)).capitalize())}</h2>")
            elif k < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.kept(self.words(r.randint(2, 12)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append("<table><tr>" + "".join(f"<td>{self.kept(self.words(r.randint(1, 4)))}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>")
            elif k < 0.93:
                out.append(f"<blockquote>{self.kept(self.prose(r.randint(5, 40)))}</blockquote>")
            elif k < 0.97:
                out.append(self.box("aside", r.choice(("related", "ad", "advert", "newsletter", "promo")), r.choice((self.links(3, 8), self.words(r.randint(2, 14)), self.prose(r.randint(4, 25))))))
            else:
                out.append(f"<div{self.name('share')}>{self.links(3, 2)}</div>")
        inner = "".join(out)
        said = r.choice(("article", "post", "entry-content", "content", "story", "main-content", ""))
        if self.habit == "words" and r.random() < 0.15:  # words that mislead
            said += r.choice((" related-width", " has-sidebar", " article-comments-enabled", " no-ads-yet", " share-ready"))
            return f'<div class="{said}">{inner}</div>'
        return self.box("article", said, inner)

    def comments(self) -> str:
        r = self.rng
        one = lambda: self.box("article", "comment", f"<b>{self.word()}</b><p>{self.prose(r.randint(3, 60))}</p>")
        return self.box("section", "comments", "<h3>Comments</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def teasers(self) -> str:
        r = self.rng
        one = lambda: self.box("article", r.choice(("teaser", "card", "")), f'<h3><a href="/x">{self.words(r.randint(3, 9))}</a></h3><p>{self.prose(r.randint(4, 18))}</p>')
        return self.box("section", r.choice(("related", "recommended", "trending")), "".join(one() for _ in range(r.randint(2, 5))))

    def page(self) -> str:
        r = self.rng
        self.habit = r.choice(("semantic", "semantic", "words", "words", "opaque", "plain"))
        marked = self.habit in ("semantic", "words")
        before, after = [], []
        if r.random() < 0.8:
            before.append(self.box("nav", r.choice(("nav", "menu", "navbar")), self.links(r.randint(2, 10))))
        if r.random() < 0.4:
            before.append(self.box("header", "masthead", f"<h2>{self.words(2)}</h2> {self.words(r.randint(1, 6))}"))
        if r.random() < 0.25:
            before.append(f"<div{self.name('breadcrumbs')}>{self.links(3, 2)}</div>")
        if r.random() < 0.3:
            before.append(self.box("div", r.choice(("cookie-notice", "consent")), f"{self.words(r.randint(2, 6))} cookies {self.words(r.randint(2, 9))}. <button>OK</button>"))
        for side in (before, after):
            if r.random() < 0.35:
                side.append(self.box("div", r.choice(("ad", "advert", "sponsored")), self.prose(r.randint(3, 16))))
        if r.random() < 0.35:
            after.append(self.box("aside", "sidebar", f"<h3>{self.words(2)}</h3>" + r.choice((self.links(5, 7), f"<p>{self.prose(r.randint(5, 40))}</p>"))))
        if r.random() < 0.25:
            after.append(f"<form{self.name('newsletter')}><p>{r.choice(CUES).capitalize()} {self.words(r.randint(2, 8))}</p><label>{self.word()}</label></form>")
        if marked and r.random() < 0.4:
            after.append(self.comments())
        if r.random() < 0.25:
            after.append(self.teasers())
        if r.random() < 0.85:
            after.append(self.box("footer", "footer", f"&copy; {self.word()} {r.choice(CUES)} {self.words(r.randint(1, 8))}" + (self.links(3, 2) if r.random() < 0.4 else "")))
        article = self.article()
        if r.random() < 0.2 and self.habit == "semantic":
            article = f"<main>{article}</main>"
        inner = "".join([*before, article, *after])
        if r.random() < 0.15:  # little or nothing around it
            inner = article + (after[-1] if after and r.random() < 0.4 else "")
        if r.random() < 0.12:
            inner = f"<form id=page-form>{inner}</form>"
        return f"<html><body>{inner}</body></html>"


def labelled_pages(n: int = 700, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(page, texts of its content blocks)."""
    out = []
    for i in range(n):
        maker = PageMaker(seed * 100_003 + i)
        out.append((maker.page(), maker.content))
    return out
