"""Labelled pages to train the extraction on: made by rule from a seed, in the layouts that web pages commonly have.

Text is made of invented words. A page is a list of (html, label of its blocks) in order: label 1 is the article.
"""

from __future__ import annotations

import random

_PARTS = "la re ti on an es ta mo ne ri so ve du pi ka lo".split()
MENU = ("nav", "menu", "navbar", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "links", "toc")
ADS = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")
NOTICES = ("cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "paywall")
ASIDES = ("sidebar", "widget", "related", "recommended", "share", "social", "tags", "author-box", "meta", "more", "popular")
COMMENTS = ("comments", "comment", "comment-list", "responses", "discussion", "disqus", "replies")
FEET = ("footer", "site-footer", "copyright", "colophon", "legal", "bottom")
HEADS = ("header", "site-header", "masthead", "topbar", "logo", "branding")
BODIES = ("content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "text", "main", "body")


def sentence(r: random.Random, n: int) -> str:
    s = " ".join("".join(r.choice(_PARTS) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize()
    return s + r.choice((".", ".", ".", "!", "?", ""))


def prose(r: random.Random) -> str:
    return " ".join(sentence(r, r.randint(1, 25)) for _ in range(r.choice((1, 1, 1, 2, 3, 5, 9))))


def _around(r: random.Random, tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, str]:
    tag = r.choice(tags)
    named = tag == "div" or r.random() < 0.5
    return f'<{tag} {r.choice(("class", "id"))}="{r.choice(names)}">' if named else f"<{tag}>", f"</{tag}>"


def _links(r: random.Random) -> str:
    return "".join(f'<li><a href="/x">{sentence(r, r.randint(1, 3))}</a></li>' for _ in range(r.randint(2, 8)))


def _boiler(r: random.Random, kind: str) -> tuple[str, int]:
    if kind == "menu":
        a, z = _around(r, ("nav", "div", "ul"), MENU)
        return a + ("<ul>" + _links(r) + "</ul>" if "ul" not in z else _links(r)) + z, 0
    if kind == "ads":
        a, z = _around(r, ("div",), ADS)
    elif kind == "notice":
        a, z = _around(r, ("div", "dialog"), NOTICES)
    elif kind == "aside":
        a, z = _around(r, ("aside", "div"), ASIDES)
    elif kind == "comments":
        a, z = _around(r, ("section", "div"), COMMENTS)
        one = lambda: r.choice(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li>{}</li>", "<article><p>{}</p></article>")).format(prose(r))
        a = a if '"' in a else f'<section class="{r.choice(COMMENTS)}">'
        return a + f"<h3>{sentence(r, 2)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 5))) + ("</section>" if a.startswith("<section") else z), 0
    elif kind == "form":
        a, z = "<form>", "</form>"
        return a + f"<label>{sentence(r, 2)}</label><input name=q><button>{sentence(r, 1)}</button>" + f"<p>{prose(r)}</p>" * r.randint(0, 1) + z, 0
    elif kind == "foot":
        a, z = _around(r, ("footer", "div"), FEET)
        return a + r.choice((f"&copy; {sentence(r, 3)}", f"<p>{prose(r)}</p>", f"<ul>{_links(r)}</ul>", prose(r))) + z, 0
    else:
        a, z = _around(r, ("header", "div"), HEADS)
        return a + r.choice((f"<h1>{sentence(r, 2)}</h1>", f"<p>{sentence(r, 4)}</p>", f'<a href="/">{sentence(r, 2)}</a>', sentence(r, 5))) + z, 0
    return a + r.choice((prose(r), f"<p>{prose(r)}</p>", f"<h3>{sentence(r, 2)}</h3><ul>{_links(r)}</ul>", f"<h3>{sentence(r, 2)}</h3><p>{prose(r)}</p>")) + z, 0


def _article(r: random.Random) -> list[tuple[str, int]]:
    a, z = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), _around(r, ("div", "section", "article"), BODIES), ("<article>" + (b := _around(r, ("div",), BODIES))[0], b[1] + "</article>")))
    out = [(a, 1)]
    if r.random() < 0.8:
        h = f"<h1>{sentence(r, r.randint(1, 12))}</h1>"
        out.append((f"<header>{h}</header>" if r.random() < 0.15 else h, 1))
    for _ in range(r.choice((1, 2, 4, 8, 15))):
        x = prose(r)
        out.append((r.choice((f"<p>{x}</p>",) * 8 + (f"<p>{x}", f"<p><b>{x}<br></p>", f"<div>{x}</div>", f"<h2>{sentence(r, 4)}</h2>", f"<blockquote><p>{x}</p></blockquote>", f"<ul><li>{x}</li><li>{prose(r)}</li></ul>", f"<table><tr><td>{sentence(r, 3)}</td><td>{sentence(r, 1)}</td></tr></table>", f"<pre>{x}</pre>", f'<p>{sentence(r, 6)} <a href="/y">{sentence(r, 2)}</a></p>', f"<figure><figcaption>{sentence(r, 7)}</figcaption></figure>")), 1))
        if r.random() < 0.08:
            out.append(_boiler(r, r.choice(("ads", "aside", "notice"))))
    return [*out, (z, 1)]


def page(seed: int) -> list[tuple[str, int]]:
    r = random.Random(seed)
    out: list[tuple[str, int]] = [(f"<!DOCTYPE html><html><head><title>{sentence(r, 5)}</title></head><body>", 0)]
    for kind, share in (("notice", 0.3), ("head", 0.4), ("menu", 0.7), ("form", 0.2), ("ads", 0.5), ("aside", 0.25)):
        if r.random() < share:
            out.append(_boiler(r, kind))
    out += _article(r)
    for kind, share in (("aside", 0.4), ("ads", 0.2), ("comments", 0.4), ("form", 0.25), ("notice", 0.15), ("menu", 0.15), ("foot", 0.8)):
        if r.random() < share:
            out.append(_boiler(r, kind))
    return [*out, ("</body></html>", 0)]
