"""Labelled pages for training: layouts of web pages, filled with made-up words.

data-main="1" marks the element in which the main text stands, data-main="0" an element in it that is not part of it.
"""

from __future__ import annotations

import random

#: The share of pages whose main text is in body itself.
BARE = 0.2
SYLLABLES = "ka lo mi ter sun dar vel po rin est ombra qui tas ner ul fe gra shi bo wen".split()
CONTENT = ["content", "main-content", "post-content", "entry", "entry-content", "story-body", "article-body", "articleText", "post", "page-body", "text", "articletext"]
MENU = ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "navigation", "subnav", "dropdown", "pagination", "pager"]
SIDE = ["sidebar", "side", "widget", "related", "recommended", "more-stories", "rail", "toc", "complementary"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "ad-slot", "adverts", "adsense", "promoted", "outbrain", "taboola"]
NOTICE = ["cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "paywall", "disclaimer", "cookies", "overlay", "dialog", "tooltip"]
FORM = ["newsletter", "subscribe", "signup", "search", "login", "contact-form"]
COMMENTS = ["comments", "comment-list", "disqus", "responses", "replies", "discussion", "reader-comments", "comment-reply", "feedback"]
HEADER = ["header", "site-header", "masthead", "top", "logo", "branding", "headers"]
FOOTER = ["footer", "site-footer", "copyright", "legal", "bottom", "footers", "footnotes", "contentinfo"]
SHARE = ["share", "social", "share-buttons", "tags", "byline-links"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.1:
            return " | ".join(made)
        if style < 0.17:
            return " ".join(w.upper() + "!!" for w in made)
        if style < 0.24:
            return " ".join(w + r.choice(["***", "$$$", "###", " &amp;&amp;"]) for w in made)
        if style < 0.3:
            return " ".join(made[:1] * len(made))
        return made[0].capitalize() + " " + " ".join(w + ("," if r.random() < 0.1 else "") for w in made[1:]) + "."

    def sentence(self) -> str:
        return self.words(1, 4) if self.r.random() < 0.3 else self.words(5, 40)

    def attr(self, names: list[str], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", " x" + str(r.randint(1, 9)), "-box", "_inner"])}"'

    def inline(self, text: str) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.6:
            return text
        if kind < 0.7:
            return f"<b>{text}<br>"
        tag = r.choice(["b", "em", "strong", "span", "i", 'a href="/x"', "code"])
        a, _, b = text.partition(" ")
        return f"{a} <{tag}>{b or 'x'}</{tag.split()[0]}>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.68:
            return f"<p>{self.inline(self.sentence())}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.76:
            tag = r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{self.words(1, 8)}</{tag}>"
        if kind < 0.83:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.words(1, 12))}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote><p>{self.sentence()}</p></blockquote>"
        if kind < 0.91:
            return f"<pre><code>{self.words(2, 12)}</code></pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<div>{self.sentence()}</div>"
        return f"<section><h2>{self.words(1, 6)}</h2><p>{self.sentence()}</p></section>"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def noise(self, inside: bool) -> str:
        """Something that isn't main text; inside the article it is marked as such."""
        r = self.r
        m = ' data-main="0"' if inside else ""
        kind = r.randint(0, 8)
        if kind == 0:
            tag = r.choice(["nav", "div", "ul"]) if not inside else r.choice(["nav", "div"])
            return f"<{tag}{self.attr(MENU, 1.0 if tag != 'nav' else 0.5)}{m}>{self.links(r.randint(2, 8))}</{tag}>" if tag != "ul" else f'<ul class="{r.choice(MENU)}"{m}><li><a href="/a">{self.words(1, 2)}</a></li></ul>'
        if kind == 1:
            return f"<{(t := r.choice(['div', 'aside', 'section']))}{self.attr(ADVERT, 1.0)}{m}>{r.choice([self.sentence(), f'<p>{self.sentence()}</p>', f'<a href=/b>{self.words(2, 6)}</a>'])}</{t}>"
        if kind == 2:
            t = r.choice(["aside", "div"])
            body = f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(4), f"<p>{self.sentence()}</p>", f"<p>{self.sentence()}</p>{self.links(3)}"])
            return f"<{t}{self.attr(SIDE, 1.0 if t == 'div' else 0.5)}{m}>{body}</{t}>"
        if kind == 3:
            return f"<div{self.attr(NOTICE, 1.0)}{m}>{r.choice(['<p>', ''])}{self.sentence()} <button>{self.words(1, 2)}</button></div>"
        if kind == 4:
            return f"<form{self.attr(FORM, 0.6)}{m}><label>{self.words(1, 4)}</label><input name=q><p>{self.words(1, 12)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == 5:
            t = r.choice(["div", "section"])
            one = lambda: f'<{(u := r.choice(["div", "div", "li", "li", "section", "article"]))} class="{r.choice(["comment", "reply", "response"])}"><{(v := r.choice(["b", "span", "strong", "cite", "h4"]))}>{self.words(1, 2)}</{v}><p>{self.sentence()}</p></{u}>'
            return f"<{t}{self.attr(COMMENTS, 1.0)}{m}><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 4)))}</{t}>"
        if kind == 6:
            return f"<div{self.attr(SHARE, 1.0)}{m}>{''.join(f'<a href=/s>{self.words(1, 2)}</a> ' for _ in range(3))}</div>"
        if kind == 7:
            return f"<{(t := r.choice(['footer', 'div']))}{self.attr(FOOTER, 1.0 if t == 'div' else 0.4)}{m}>{r.choice(['&copy; ', ''])}{self.words(1, 5)} &middot; {self.sentence()}</{t}>"
        return f"<{(t := r.choice(['header', 'div']))}{self.attr(HEADER, 1.0 if t == 'div' else 0.4)}{m}>{r.choice(['<h1>', '<p>'])}{self.words(1, 5)}{r.choice(['', self.links(3)])}</{t}>"

    def bare_page(self) -> str:
        """A page whose main text stands right in body, among what isn't."""
        r = self.r
        body = [f"<h1>{self.words(1, 10)}</h1>"] if r.random() < 0.5 else []
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 8, 12])):
            body.append(self.block())
            if r.random() < 0.05:
                body.append(self.noise(True))
        before = [self.noise(True) for _ in range(r.randint(0, 3))]
        after = [self.noise(True) for _ in range(r.randint(0, 3))]
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body data-main="1">{"".join([*before, *body, *after])}</body></html>'

    def page(self) -> str:
        r = self.r
        if r.random() < BARE:
            return self.bare_page()
        body = [f"<h1>{self.words(1, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5, 8, 12])):
            body.append(self.block())
            if r.random() < 0.1:
                body.append(self.noise(True))
        if r.random() < 0.1:
            body.insert(r.randint(0, len(body)), self.sentence())
        open_, close = r.choice(
            [("<article{}>", "</article>")] * 6
            + [("<main{}>", "</main>"), ("<main><article{}>", "</article></main>"), ("<div{}>", "</div>"), ("<div{}>", "</div>"), ("<section{}>", "</section>")]
        )
        attr = self.attr(CONTENT, 1.0 if "div" in open_ or "section" in open_ else 0.3) + ' data-main="1"'
        before = [self.noise(False) for _ in range(r.randint(0, 4))]
        after = [self.noise(False) for _ in range(r.randint(0, 4))]
        wrap = r.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>', "<div>{}</div>"])
        if r.random() < 0.12:  # a fragment
            return "".join([open_.format(attr), *body, self.words(1, 6), close, self.noise(False) if r.random() < 0.5 else ""])
        inner = "".join([*before, open_.format(attr), *body, close, *after])
        tail = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t = '</p>';</script></head><body>{wrap.format(inner)}{tail}"


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    made = Maker(seed)
    return [made.page() for _ in range(n)]
