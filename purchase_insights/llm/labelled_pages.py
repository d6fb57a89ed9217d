"""Labelled pages to train the extraction on, made of common page parts.

``data-part`` marks a subtree: ``content`` or ``other``. What has neither mark around
it and holds content is a wrapper. The mark is never a feature.
"""

from __future__ import annotations

import random
import re

#: (tag, names) of page parts that aren't main text, and what they hold.
OTHER_PARTS = [
    ("nav", "", "links"), ("nav", "menu main", "links"), ("div", "nav navbar", "links"), ("ul", "menu", "links"),
    ("div", "breadcrumb breadcrumbs", "links"), ("div", "pagination pager", "links"), ("div", "toc toolbar", "links"),
    ("header", "", "short"), ("header", "site header masthead", "links"), ("div", "header top banner", "short"),
    ("footer", "", "short"), ("footer", "site footer", "links"), ("div", "footer bottom copyright", "short"),
    ("aside", "", "long"), ("aside", "sidebar", "links"), ("div", "sidebar side rail", "long"), ("div", "widget", "links"),
    ("div", "ad", "long"), ("div", "ads advert advertisement", "long"), ("section", "ad sponsor sponsored", "long"),
    ("div", "promo promotion banner", "long"), ("aside", "ad", "short"), ("p", "ad sponsored", "long"),
    ("div", "cookie cookies consent gdpr", "long"), ("div", "notice alert message", "long"), ("p", "notice", "long"),
    ("div", "popup modal overlay dialog", "long"), ("dialog", "", "long"), ("div", "privacy legal disclaimer terms", "long"),
    ("form", "", "short"), ("form", "login signup search", "long"), ("div", "newsletter subscribe subscription", "long"),
    ("form", "newsletter", "long"), ("fieldset", "", "short"), ("search", "", "short"), ("div", "paywall", "long"),
    ("div", "comment", "long"), ("div", "comments discussion", "long"), ("section", "comments", "long"),
    ("section", "comment reply respond responses", "long"), ("ol", "comment list comments", "long"), ("ul", "comments", "long"),
    ("div", "disqus thread reader feedback", "long"), ("aside", "comments", "long"), ("div", "reviews replies", "long"),
    ("div", "share social sharing", "links"), ("div", "related recommended more", "links"), ("section", "related teaser", "long"),
    ("div", "tags meta byline author", "short"), ("menu", "", "links"), ("div", "hidden", "long"), ("div", "skip", "links"),
]
CONTENT_ROOTS = [
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article body"),
    ("div", "post entry"), ("section", "story text"), ("div", ""), ("section", ""), ("article", "story"), ("article", ""),
]
WRAPPERS = [("div", ""), ("div", "container wrapper page"), ("section", ""), ("main", ""), ("div", "row column layout")]


def _text(rng: random.Random, low: int, high: int) -> str:
    words = ("".join(rng.choice("aeiounrtslmd") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))
    return " ".join(words).capitalize() + rng.choice([".", ".", "", ". Etc."])


def _links(rng: random.Random) -> str:
    return "".join(f'<li><a href="/x">{_text(rng, 1, 3)}</a></li>' for _ in range(rng.randint(1, 8)))


def _open(tag: str, names: str, rng: random.Random, part: str = "") -> str:
    attribute = f' {rng.choice(["class", "id", "class"])}="{names if rng.random() < 0.4 else rng.choice(names.split())}"' if names else ""
    return f"<{tag}{attribute}" + (f' data-part="{part}">' if part else ">")


def _other(rng: random.Random) -> str:
    tag, names, kind = rng.choice(OTHER_PARTS)
    if kind == "links":
        inner = _links(rng) if tag in ("ul", "menu") else f"<ul>{_links(rng)}</ul>"
    elif kind == "short":
        inner = _text(rng, 1, 12)
    else:
        item = "li" if tag in ("ol", "ul") else rng.choice(["p", "p", "div"])
        texts = [_text(rng, 1, 60) for _ in range(rng.randint(1, 4))]
        inner = "".join(f"<{item}>{t}</{item}>" for t in texts) if tag != "p" and rng.random() < 0.7 else texts[0]
        if tag not in ("p", "ol", "ul") and rng.random() < 0.4:
            level = rng.randint(2, 5)
            inner = f"<h{level}>{_text(rng, 1, 5)}</h{level}>{inner}"
    return f"{_open(tag, names, rng, 'other')}{inner}</{tag}>"


def _content(rng: random.Random) -> str:
    tag, names = rng.choice(CONTENT_ROOTS)
    parts = [f"<h1>{_text(rng, 1, 10)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.66:
            inner = _text(rng, 1, 90)
            parts.append(f"<p>{inner}</p>" if rng.random() < 0.9 else f'<p>{inner} <a href="/y">{_text(rng, 1, 5)}</a></p>')
        elif kind < 0.73:
            parts.append(f"<h2>{_text(rng, 1, 6)}</h2>")
        elif kind < 0.78:
            parts.append("<ul>" + "".join(f"<li>{_text(rng, 1, 20)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.81:
            parts.append(f"<blockquote><p>{_text(rng, 3, 40)}</p></blockquote>")
        elif kind < 0.83:
            parts.append(f"<table><tr><td>{_text(rng, 1, 5)}</td><td>{_text(rng, 1, 5)}</td></tr></table>")
        elif kind < 0.85:
            inner = rng.choice(["div", "section"])
            parts.append(f"<{inner}><p>{_text(rng, 5, 60)}</p></{inner}>")
        else:
            parts.append(_other(rng))
    if rng.random() < 0.1:  # no element around the main text
        return "".join(part if 'data-part="other"' in part[:200] else re.sub(r"^<\w+", r'\g<0> data-part="content"', part) for part in parts)
    return f"{_open(tag, names, rng, 'content')}{''.join(parts)}</{tag}>"


def labelled_pages(n: int = 1500, seed: int = 11) -> list[str]:
    """``n`` marked pages, the same ones for a seed."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        before = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
        after = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
        body = before + _content(rng) + after
        for _ in range(rng.choice([0, 0, 1, 2])):
            tag, names = rng.choice(WRAPPERS)
            body = f"{_other(rng) if rng.random() < 0.3 else ''}{_open(tag, names, rng)}{body}</{tag}>"
        pages.append(f"<html><body>{body}</body></html>")
    return pages
