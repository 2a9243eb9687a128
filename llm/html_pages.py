"""Labelled pages to learn from: texts set in many kinds of page, with ``data-label`` on what is the article and what isn't.

Texts of articles, adverts, notices and comments are of one kind here, so nothing can be learned from their words, only from where they stand.
"""

from __future__ import annotations

import html
import random

# fixed values: words that pages name their parts by
NAMES = {
    "content": "content article post entry story body text main page markdown prose",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links",
    "header": "header masthead top branding logo site hero",
    "footer": "footer bottom copyright legal colophon",
    "side": "sidebar aside related widget rail recommended popular trending more",
    "ad": "ad ads advert advertisement sponsored promo sponsor adsbygoogle",
    "notice": "notice cookie consent alert banner gdpr popup modal warning paywall",
    "form": "search form login signup newsletter subscribe",
    "comments": "comments comment discussion replies respond reply thread",
    "share": "share social tools meta byline tags pagination pager",
    "wrap": "wrapper container row col grid layout inner outer wrap section app root box",
}
TAGS = {
    "nav": "nav nav nav ul div div section",
    "header": "header header header div div",
    "footer": "footer footer footer div div",
    "side": "aside aside div div section ul",
    "ad": "div div div aside section ins p",
    "notice": "div div section aside p dialog",
    "form": "form form form div",
    "comments": "section div div ol ul",
    "share": "div div ul p section",
}


class Writer:
    def __init__(self, r: random.Random, paragraphs: list[str]):
        self.r, self.paragraphs = r, paragraphs
        self.named = r.random() < 0.85  # else a page that names nothing

    def some(self, words: str) -> str:
        return self.r.choice(words.split())

    def names(self, kind: str, chance: float = 0.85) -> str:
        """A class or id of the kind, sometimes an empty word, sometimes nothing."""
        r = self.r
        if not self.named or r.random() > chance:
            return f' class="{"".join(r.choice("abcdefxyz0123") for _ in range(5))}"' if r.random() < 0.4 else ""
        word = self.some(NAMES[kind])
        form = r.choice(["{}", "{}", "{}", "site-{}", "{}-{n}", "{}_{w}", "{}-{w}", "{}s"])
        return f' {r.choice(["class", "class", "id"])}="{form.format(word, n=r.randint(1, 9), w=self.some(NAMES["wrap"]))}"'

    def words(self, n: int) -> str:
        w = self.r.choice(self.paragraphs).split() or ["x"]
        at = self.r.randrange(len(w))
        return html.escape(" ".join(w[at : at + n]))

    def prose(self) -> str:
        return html.escape(self.r.choice(self.paragraphs)[:2000])

    def link(self, n: int = 1) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(self.r.randint(1, 2 + n))}</a>'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link(n)}</li>" for _ in range(self.r.randint(2, 8))) + "</ul>"

    def heading(self, least: int, most: int, text: str) -> str:
        rank = self.r.randint(least, most)
        return f"<h{rank}>{text}</h{rank}>"

    def inline(self, text: str) -> str:
        r, w = self.r, text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(w))
            tag = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>"
        return " ".join(w)

    def part(self, kind: str) -> str:
        """A part of a page that isn't its article."""
        r, tag = self.r, self.some(TAGS[kind])
        if kind == "nav":
            body = self.links(1) if tag != "ul" else "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 8)))
            body = body if r.random() < 0.8 else " | ".join(self.link() for _ in range(r.randint(2, 7)))
        elif kind == "header":
            body = r.choice([f'<a href="/">{self.words(2)}</a>', f"<h1>{self.words(3)}</h1><p>{self.words(8)}</p>", f"<img src=x><span>{self.words(2)}</span>"]) + (self.part("nav") if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice(["&copy; ", "&copy; ", "© ", "Copyright ", ""]) + r.choice(["t.example.com &middot; ", "2021 ", "", self.words(2) + " "]) + r.choice([self.prose(), self.words(12), self.link(), ""])
            body += self.links(1) if r.random() < 0.3 else ""
            body = f"<p>{body}</p>" if r.random() < 0.4 else body
        elif kind == "side":
            body = self.heading(2, 4, self.words(3)) + r.choice([self.links(6), f"<p>{self.prose()}</p>", "".join(f"<div>{self.link(8)}<p>{self.words(15)}</p></div>" for _ in range(3))])
        elif kind == "form":
            body = f"<label>{self.words(3)}</label><input name=q><button>{self.words(1)}</button>" + (f"<p>{self.words(12)}</p>" if r.random() < 0.5 else "")
            body = body if tag == "form" else f"<form>{body}</form>"
        elif kind == "comments":
            each = [f"<{t}>{self.words(2)}</{t}><p>{self.prose()}</p>" for t in r.choices(["p", "span", "b"], k=r.randint(1, 5))]
            inner = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "div"])
            body = "".join(f"<{inner}{self.names('comments', 0.6)}>{e}</{inner}>" for e in each)
            body = (f"<h3>{self.words(2)}</h3>" if inner != "li" else "") + body
        elif kind == "share":
            body = "".join(r.choice([self.link(), f"<span>{self.words(2)}</span>"]) for _ in range(r.randint(2, 5)))
        else:
            body = r.choice([self.prose(), f"<p>{self.prose()}</p>", self.link(6), f"<b>{self.words(3)}</b> {self.words(14)} {self.link()}"])
        names = self.names(kind) if tag != "p" else f' class="{self.some(NAMES[kind])}"'  # a plain paragraph is the article's
        return f'<{tag}{names} data-label="0">{body}</{tag}>'

    def article(self) -> str:
        """The article: a title, and its paragraphs in some form, with other parts between them at times."""
        r = self.r
        short = r.choice([0.05, 0.05, 0.3, 1])  # some articles hardly say anything, and some paragraphs are a word
        cut = [" ".join(p.split(" ")[: r.randint(1, 6)]) if r.random() < short else p for p in self.paragraphs[: r.choice([1, 2, 99, 99, 99])]]
        paragraphs = [html.escape(p) for p in cut]
        form, out = r.choice("ppppplbdq"), []
        for k, p in enumerate(paragraphs):
            p = self.inline(p)
            if k == 0 and r.random() < 0.5:
                out.append(f"<p><b>{p}<br>" if r.random() < 0.5 else f"<p><b>{p}</b></p>")
                continue
            if r.random() < 0.15:
                out.append(self.heading(2, 3, self.words(5)))
            if r.random() < 0.08:
                out.append("<ul>" + "".join(f"<li>{self.words(r.randint(3, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            out.append({"p": f"<p>{p}</p>", "l": f"<p>{p}", "b": f"{p}<br><br>", "d": f"<div>{p}</div>", "q": f"<p>{p}</p>" if k % 3 else f"<blockquote><p>{p}</p></blockquote>"}[form])
            if r.random() < 0.06:
                out.append(self.part(r.choice(["ad", "ad", "share", "side", "notice", "form"])))
        title = self.heading(1, r.choice([1, 1, 1, 2]), paragraphs[0][:60].partition("&")[0]) if r.random() < 0.85 else ""
        if r.random() < 0.2:
            title += self.part("share")
        tag = self.some("article article article main div div section")
        names = self.names("content") if tag in ("div", "section") or r.random() < 0.3 else ""
        ends = "".join(self.part(r.choice(["share", "comments", "side"])) for _ in range(r.choice([0, 0, 0, 1])))
        return f'<{tag}{names} data-label="1">{title}{"".join(out)}{ends}</{tag}>'

    def page(self) -> str:
        r = self.r

        def some(kinds: str) -> str:
            return "".join(self.part(k) for k in kinds.split() if r.random() < 0.45)

        middle = self.article()
        sides = r.random()
        middle = some("ad") + middle if sides < 0.7 else some("side") + middle + some("side ad")
        middle += some("comments side")
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            tag = self.some("div div div main section")
            middle = f"<{tag}{self.names('wrap')}>{middle}</{tag}>"
        head = f"<head><meta charset=utf-8><title>{self.words(6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        top = some("notice header nav ad") if r.random() < 0.7 else self.part("nav") + f"<!-- {r.randint(0, 9)} -->" + self.part("ad")
        end = some("comments ad") + (self.part("footer") if r.random() < 0.8 else "") + some("notice form")
        return f"<!DOCTYPE html><html>{head}<body>{top}{middle}{end}" + ("</body></html>" if r.random() < 0.8 else "")


def labelled_page(text: str, seed: int) -> str:
    """A page whose article is the text, a paragraph a line."""
    paragraphs = [p for p in text.split("\n") if p.strip()]
    return Writer(random.Random(seed), paragraphs).page() if paragraphs else ""
