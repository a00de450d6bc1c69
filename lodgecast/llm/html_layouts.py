"""Labelled training pages: paragraphs rendered into layouts whose block roles are known.

A role's markup is drawn from the elements and class names that pages use for it, so a model
trained on many drawings learns names and structure rather than one template. Every labelled
element carries ``data-label``, which the block reader reports and the features do not see.
"""

from __future__ import annotations

import html
import random

# Names by role. Each entry: elements, and class or id names (joined words count one by one).
MAIN = (
    "article main div section td",
    "content article post entry story text body main-content post-content entry-content "
    "article-body article-text page-content story-body blog-post post-body markdown prose "
    "article-content single-post news-text",
)
ROLES = {
    "menu": (
        "nav div ul",
        "nav menu navbar navigation main-menu top-menu breadcrumb breadcrumbs topbar tabs "
        "site-nav pagination pager links sitemap toc-menu language-menu submenu",
    ),
    "header": ("header div", "header site-header masthead banner-top top head page-header branding logo"),
    "footer": (
        "footer div",
        "footer site-footer page-footer bottom copyright legal colophon foot imprint credits",
    ),
    "sidebar": (
        "aside div section",
        "sidebar side aside widget widgets related related-posts recommended more-stories rail "
        "popular trending latest tags tag-cloud archive author-box bio also-read",
    ),
    "notice": (
        "div section aside dialog noscript",
        "cookie cookies cookie-notice consent gdpr notice alert notification popup modal overlay "
        "privacy-notice warning message announcement paywall disclaimer",
    ),
    "advert": (
        "div aside section ins",
        "ad ads advert adverts advertisement sponsored sponsor promo promotion banner ad-slot "
        "adsbox ad-container commercial partner-content google-ad native-ad",
    ),
    "form": (
        "form div section fieldset",
        "form search search-form subscribe newsletter signup login register contact-form "
        "subscription feedback poll survey",
    ),
    "comments": (
        "section div ol ul aside",
        "comments comment comment-list commentlist discussion replies respond reader-comments "
        "disqus user-comments responses comment-body reviews",
    ),
    "share": ("div ul section", "share sharing social social-links share-buttons follow like meta byline"),
}
FIXED = ("All rights reserved.", "Privacy policy", "Terms of use", "Subscribe", "Accept", "Reply")


def _element(rng: random.Random, kind: tuple[str, str]) -> tuple[str, str]:
    """Element and its attributes. Elements that name their role may go without a class."""
    tags, names = kind[0].split(), kind[1].split()
    tag = rng.choice(tags)
    plain = tag in ("nav", "header", "footer", "aside", "form", "article", "main", "fieldset", "dialog")
    if plain and rng.random() < 0.6:
        return tag, ""
    used = " ".join(rng.sample(names, 1 if rng.random() < 0.8 else 2))
    return tag, f' {rng.choice(("class", "class", "id"))}="{used}"'


def _inline(rng: random.Random, text: str) -> str:
    """Escaped text, some words marked up or linked."""
    words = [html.escape(w, quote=False) for w in text.split()]
    for i in range(len(words)):
        if rng.random() < 0.02:
            tag = rng.choice(("b", "i", "em", "a", "span"))
            words[i] = f'<{tag}{" href=/x" if tag == "a" else ""}>{words[i]}</{tag}>'
    return " ".join(words)


def _links(rng: random.Random, words: list[str]) -> str:
    items = [f'<a href="/{i}">{html.escape(w)}</a>' for i, w in enumerate(rng.choices(words, k=rng.randint(2, 7)))]
    wrap = rng.choice(("<ul><li>{}</li></ul>", "<p>{}</p>", "<div>{}</div>"))
    return wrap.format("</li><li>".join(items) if "ul" in wrap else rng.choice((" | ", " ", " &middot; ")).join(items))


def _sentences(rng: random.Random, spare: list[str], most: int) -> list[str]:
    """Short stretches of other text, as adverts, notices and comments hold them."""
    out = []
    for _ in range(rng.randint(1, most)):
        words = rng.choice(spare).split()
        first = rng.randrange(max(1, len(words) - 5))
        out.append(" ".join(words[first : first + rng.randint(3, 40)]))
    return out


def _aside(rng: random.Random, role: str, spare: list[str], words: list[str]) -> str:
    """One element that is not main text."""
    tag, attributes = _element(rng, ROLES[role])
    if role == "menu":
        inside = _links(rng, words)
        if tag == "ul":
            inside = "".join(f'<li><a href="#">{html.escape(w)}</a></li>' for w in rng.choices(words, k=5))
    elif role in ("header", "footer", "sidebar", "share"):
        parts = [_links(rng, words)] if rng.random() < 0.7 else []
        for s in _sentences(rng, spare, 2):
            parts.append(f'<{(t := rng.choice(("p", "h3", "div", "span", "h4", "li")))}>{_inline(rng, s[:90])}</{t}>')
        if role == "footer":
            parts.append(f'<p>&copy; {html.escape(rng.choice(words))}.example.com &middot; {rng.choice(FIXED)}</p>')
        inside = "".join(rng.sample(parts, len(parts)))
    elif role == "form":
        fields = "".join(f"<label>{html.escape(w)}</label><input name=q>" for w in rng.choices(words, k=rng.randint(1, 3)))
        inside = f"<p>{_inline(rng, _sentences(rng, spare, 1)[0])}</p>" * (rng.random() < 0.6) + fields
        inside += f"<button>{rng.choice(FIXED)}</button>"
    elif role == "comments":
        shape = rng.choice(("<p>{}</p>", "<div class=comment><b>x</b><p>{}</p></div>", "<li>{}</li>", "<div>{}</div>"))
        inside = "".join(shape.format(_inline(rng, s)) for s in _sentences(rng, spare, 5))
        if rng.random() < 0.5:
            inside = f"<h3>{html.escape(' '.join(rng.choices(words, k=2)))}</h3>" + inside
    else:
        texts = [_inline(rng, s) for s in _sentences(rng, spare, 2)]
        inside = "".join(f"<p>{t}</p>" for t in texts) if rng.random() < 0.5 else texts[0]
        if role == "notice" and rng.random() < 0.5:
            inside += f"<button>{rng.choice(FIXED)}</button>"
    return f'<{tag}{attributes} data-label="other">{inside}</{tag}>'


def _main(rng: random.Random, paragraphs: list[str], spare: list[str], words: list[str]) -> str:
    tag, attributes = _element(rng, MAIN)
    body = []
    if rng.random() < 0.8:
        title = f"<{(h := rng.choice(('h1', 'h1', 'h2')))}>{_inline(rng, ' '.join(paragraphs[0].split()[:10]))}</{h}>"
        body.append(f"<header data-label=main>{title}</header>" if rng.random() < 0.15 else title)
    plain = rng.choice(("p", "p", "p", "div", "section"))
    for text in paragraphs:
        kind = rng.random()
        if kind < 0.06:
            body.append(f"<h2>{_inline(rng, ' '.join(text.split()[:6]))}</h2>")
        if kind < 0.85:
            body.append(f"<{plain}>{_inline(rng, text)}" + f"</{plain}>" * (rng.random() < 0.9 or plain != "p"))
        elif kind < 0.9:
            body.append(f"<ul><li>{_inline(rng, text)}</li><li>{_inline(rng, text[:60])}</li></ul>")
        elif kind < 0.95:
            body.append(f"<blockquote><p>{_inline(rng, text)}</p></blockquote>")
        else:
            body.append(f"<table><tr><td>{_inline(rng, text[:50])}</td><td>{_inline(rng, text[-50:])}</td></tr></table>")
    for role in rng.choices(list(ROLES), k=rng.choice((0, 0, 1, 1, 2, 3))):
        if role not in ("menu", "footer") or rng.random() < 0.3:
            at = len(body) if role == "comments" else rng.randint(1, len(body))
            body.insert(at, _aside(rng, role, spare, words))
    inside = f'<{tag}{attributes} data-label="main">{"".join(body)}</{tag}>'
    return f"<table><tr>{inside}</tr></table>" if tag == "td" else inside


def labelled_page(rng: random.Random, paragraphs: list[str], spare: list[str]) -> str:
    """One page around ``paragraphs``; ``spare`` supplies the text of everything else."""
    words = " ".join(spare).split()[:500] or ["x"]
    around = lambda roles, most: [
        _aside(rng, r, spare, words) for r in rng.choices(roles, k=rng.randint(0, most))
    ]
    before = around(["menu", "header", "notice", "advert", "sidebar", "form", "share"], 4)
    after = around(["sidebar", "comments", "advert", "share", "form", "notice", "menu", "footer"], 4)
    body = [*before, _main(rng, paragraphs, spare, words), *after]
    if rng.random() < 0.8:
        body.append(_aside(rng, "footer", spare, words))
    text = "".join(body)
    for _ in range(rng.choice((0, 0, 1, 2))):
        name = rng.choice(("container", "wrapper", "page", "row", "col", "site", "layout", "inner"))
        text = f'<div class="{name}">{text}</div>'
    return f"<html><body>{text}</body></html>"
