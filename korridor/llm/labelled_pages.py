"""Labelled pages: what stands between ``<!--main-->`` and ``<!--/main-->`` is the article, all else is not.

Made for this package by rule from a seed, as varied as pages are: where menus, notices, adverts,
forms and comments stand, what their elements and classes are called, how the article is wrapped and
which blocks it has, whether tags are closed. The extractor's weights are learnt from them. Texts
are words of random letters, so nothing is learnt from what a page says.
"""

from __future__ import annotations

import random

_M, _E = "<!--main-->", "<!--/main-->"
#: what a part of a page that is not the article may be: elements, names of classes or ids
ASIDE = {
    "menu": ("nav div ul menu", "nav navbar menu navigation breadcrumb breadcrumbs pager pagination toc topbar skip main-nav"),
    "edge": ("footer header div section", "footer foot header masthead copyright legal site-footer site-header topbar contentinfo"),
    "advert": ("div p aside section", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense ad-slot"),
    "notice": ("div section p dialog", "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast cookie-notice"),
    "side": ("aside div section", "sidebar aside related widget widgets recommended recommendations trending popular complementary read-more"),
    "share": ("div ul p", "share sharing social follow share-buttons"),
    "comment": ("div section ol article li", "comment comments reply replies respond disqus discussion comment-list comment-body"),
    "form": ("form div fieldset search", "login search form search-form signin"),
}
MAIN = ("article main div section", "content article post story entry main body text post-content entry-content article-body main-content page story-body")
PLAIN = "wide first last row inner box clearfix left right c1 block-2 js grid"


def _words(r: random.Random, least: int, most: int) -> str:
    out = ["".join(r.choice("aeioulmnrstdkpg") for _ in range(r.randint(1, 9))) for _ in range(r.randint(least, most))]
    return " ".join(out).capitalize() + r.choice([".", ".", "!", "", " &amp;"])


def _open(r: random.Random, tags: str, names: str, named: float = 0.8) -> tuple[str, str]:
    tag, some = r.choice(tags.split()), []
    if r.random() < named:
        some = [r.choice(names.split())]
    if r.random() < 0.3:
        some.insert(r.randint(0, len(some)), r.choice(PLAIN.split()))
    if not some:
        return f"<{tag}>", f"</{tag}>"
    quote = r.choice(['"', "'", '"'])
    return f"<{tag} {r.choice(['class', 'class', 'id'])}={quote}{' '.join(some)}{quote}>", f"</{tag}>"


def _links(r: random.Random) -> str:
    some = [f'<a href="/{i}">{_words(r, 1, 3)}</a>' for i in range(r.randint(2, 9))]
    return r.choice([lambda x: "<ul>" + "".join(f"<li>{a}</li>" for a in x) + "</ul>", " | ".join, " ".join])(some)


def _aside(r: random.Random, kind: str) -> str:
    tags, names = ASIDE[kind]
    start, end = _open(r, tags, names, 0.75 if tags.split()[0] in ("nav", "footer", "aside", "form") else 1.0)
    if kind == "menu":
        inner = _links(r)
    elif kind == "form":
        inner = f"<form><label>{_words(r, 1, 4)}</label><input name=q><select><option>{_words(r, 1, 2)}<option>{_words(r, 1, 2)}</select><button>{_words(r, 1, 2)}</button></form>"
    elif kind == "comment":
        inner = "".join(f"<div class=\"{r.choice(['comment', 'reply', 'comment-body'])}\"><b>{_words(r, 1, 2)}</b><p>{_words(r, 3, 60)}</p></div>" for _ in range(r.randint(1, 6)))
    elif kind in ("side", "share"):
        inner = r.choice([f"<h3>{_words(r, 1, 4)}</h3>", ""]) + _links(r) + (f"<p>{_words(r, 3, 40)}</p>" if r.random() < 0.5 else "")
    elif kind == "edge":
        inner = r.choice([f"<p>{_words(r, 3, 20)}</p>", _words(r, 3, 20), _links(r)])
    else:
        inner = r.choice([_words(r, 4, 30), f"<p>{_words(r, 4, 40)}</p>", f"<p>{_words(r, 4, 40)}</p><button>{_words(r, 1, 2)}</button>"])
    return start + inner + end


def _block(r: random.Random) -> str:
    link = lambda t: t if r.random() < 0.8 else t + f' <a href="/x">{_words(r, 1, 4)}</a> ' + _words(r, 2, 12)
    kind = r.choice(["p"] * 8 + ["b", "h2", "ul", "quote", "pre", "table", "figure", "div", "short", "lead", "bare"])
    return {
        "p": lambda: f"<p>{link(_words(r, 8, 70))}</p>",
        "b": lambda: f"<p><b>{_words(r, 6, 40)}<br>",
        "h2": lambda: f"<h2>{_words(r, 1, 8)}</h2>",
        "ul": lambda: "<ul>" + "".join(f"<li>{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
        "quote": lambda: f"<blockquote>{_words(r, 6, 40)}</blockquote>",
        "pre": lambda: f"<pre>{_words(r, 4, 20)}</pre>",
        "table": lambda: "<table>" + "".join(f"<tr><th>{_words(r, 1, 2)}</th><td>{_words(r, 1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
        "figure": lambda: f"<figure><img src=x><figcaption>{_words(r, 3, 14)}</figcaption></figure>",
        "div": lambda: f"<div>{_words(r, 8, 60)}</div>",
        "short": lambda: f"<p>{_words(r, 1, 5)}</p>",
        "bare": lambda: f"{_words(r, 8, 60)}<br><br>",
        "lead": lambda: f"<p class=\"{r.choice(['lead', 'intro', 'dropcap', 'summary'])}\"><em>{_words(r, 5, 30)}</em></p>",
    }[kind]()


def page(seed: int) -> str:
    """The labelled page of a seed."""
    r = random.Random(seed)
    start, end = _open(r, *MAIN, 0.85) if r.random() < 0.85 else ("", "")
    title = f"<h1>{_words(r, 2, 9)}</h1>"
    inside = title if r.random() < 0.7 else f"<header>{title}</header>"
    inside = _M + inside
    for _ in range(r.randint(1, 12)):
        inside += _block(r)
        if r.random() < 0.06:
            inside += _E + _aside(r, r.choice(["advert", "share", "notice", "side"])) + _M
    inside += _E
    for kind in ("share", "comment"):
        if r.random() < 0.2:
            inside += _aside(r, kind)
    if r.random() < 0.05:
        return f"{_M}{_words(r, 2, 40)}{_E}" if r.random() < 0.5 else f"<html><body>{inside}</body></html>"
    before = [_aside(r, k) for k in ("menu", "edge", "advert", "notice", "form") if r.random() < 0.5]
    after = [_aside(r, k) for k in ("side", "comment", "share", "advert", "edge", "menu", "notice") if r.random() < 0.4]
    r.shuffle(before)
    wrap = r.random() < 0.3
    body = "".join(before) + "<div class=wrapper>" * wrap + start + inside + end + "".join(after) + "</div>" * wrap
    hidden = f"<div {r.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=true'])}>{_words(r, 3, 20)}</div>" if r.random() < 0.2 else ""
    return f'<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title><style>p{{margin:0}}</style><script>track("</p>")</script></head><body{r.choice(["", " class=single", " class=has-sidebar"])}>{hidden}{body}</body></html>'
