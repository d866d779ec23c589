"""Labelled pages for training: made by rule from the texts of the given pages' languages, in many layouts.

Each page is a list of HTML pieces with a label, so that the labels of its blocks are known without any annotation.
"""

from __future__ import annotations

import random

SYLLABLES = "ba con der el fi gra hou in ka lo men na or pre qui ra sta ti un ver wo ze ing tion ed ly".split()


def words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))


def sentences(rng: random.Random, low: int, high: int) -> str:
    """Sentences; sometimes other text instead: lists, codes, shouting, without an end."""
    if rng.random() < 0.35:
        gap = rng.choice([" ", " | ", "$$$ ", ", ", "!! ", " 12 ", " &amp; ", "\n"])
        text = gap.join(words(rng, 1, 1) for _ in range(rng.choice([1, 2, 4, 9, 20, 45, 90])))
        return rng.choice([text, text.upper(), text.capitalize() + ".", text + " |", f"{text} (c) 20{rng.randint(10, 25)}", f"&copy; {text}"])
    return " ".join(words(rng, 4, 16).capitalize() + rng.choice("...?!") for _ in range(rng.randint(low, high)))


def links(rng: random.Random, low: int, high: int) -> str:
    return "".join(f'<li><a href="/{words(rng, 1, 1)}">{words(rng, 1, 3)}</a></li>' for _ in range(rng.randint(low, high)))


def wrapped(tag: str, mark: str, inner: str) -> str:
    return f'<{tag}{f" class={chr(34)}{mark}{chr(34)}" if mark else ""}>{inner}</{tag}>'


def article(rng: random.Random) -> str:
    """The pieces of an article, with things inside it that do not belong to its text."""
    parts = [f"<h{rng.choice('112')}>{words(rng, 2, 12).capitalize()}</h1>" if rng.random() < 0.8 else ""]
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.72:
            parts.append(f"<p>{sentences(rng, 1, 7)}</p>")
        elif kind < 0.8:
            parts.append(f"<p><b>{sentences(rng, 1, 4)}<br>")
        elif kind < 0.86:
            parts.append(f"<h2>{words(rng, 1, 6).capitalize()}</h2>")
        elif kind < 0.92:
            parts.append(f"<blockquote><p>{sentences(rng, 1, 3)}</p></blockquote>")
        elif kind < 0.96:
            parts.append("<ul>" + "".join(f"<li>{sentences(rng, 1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        else:
            parts.append(f"<p>{words(rng, 1, 5).capitalize()}.</p>")
    return "".join(parts)


def other(rng: random.Random, kind: str) -> str:
    """A part of a page that is not its article."""
    named = rng.random() < 0.9
    if kind == "nav":
        tag = rng.choice(["nav", "nav", "div"])
        return wrapped(tag, rng.choice(["menu", "main-nav", "breadcrumbs", "nav"]) if tag == "div" or rng.random() < 0.4 else "", f"<ul>{links(rng, 3, 9)}</ul>")
    if kind == "header":
        tag = rng.choice(["header", "div"])
        mark = rng.choice(["header", "masthead", "topbar"]) if tag == "div" or rng.random() < 0.4 else ""
        return wrapped(tag, mark, rng.choice([f"<h1>{words(rng, 1, 4)}</h1>", f"<p>{words(rng, 2, 8)}</p>", f'<a href="/">{words(rng, 1, 3)}</a>']))
    if kind == "footer":
        tag = rng.choice(["footer", "footer", "div"])
        mark = rng.choice(["footer", "copyright"]) if tag == "div" or rng.random() < 0.3 else ""
        text = rng.choice([f"&copy; {words(rng, 1, 3)} &middot; {sentences(rng, 1, 3)}", f"<p>{sentences(rng, 1, 2)}</p><ul>{links(rng, 2, 5)}</ul>"])
        return wrapped(tag, mark, text)
    if kind == "aside":
        tag = rng.choice(["aside", "div", "section"])
        mark = rng.choice(["sidebar", "related", "widget", "trending"]) if tag != "aside" or rng.random() < 0.5 else ""
        return wrapped(tag, mark, f"<h3>{words(rng, 1, 3)}</h3>" + rng.choice([f"<ul>{links(rng, 2, 7)}</ul>", f"<p>{sentences(rng, 1, 3)}</p>"]))
    if kind == "ad":
        return wrapped(rng.choice(["div", "section", "aside"]), rng.choice(["ad", "advert", "promo", "ad-box", "sponsored"]), rng.choice([sentences(rng, 1, 3), f"<p>{sentences(rng, 1, 3)}</p>"]))
    if kind == "notice":
        return wrapped(rng.choice(["div", "section"]), rng.choice(["cookie-notice", "notice", "newsletter", "alert", "consent"]), f"<p>{sentences(rng, 1, 2)}</p>")
    if kind == "comments":
        inner = "".join(f'<div class="comment"><p>{sentences(rng, 1, 3)}</p></div>' if named else f"<li><p>{sentences(rng, 1, 3)}</p></li>" for _ in range(rng.randint(1, 5)))
        return wrapped(rng.choice(["div", "section", "ol"]), rng.choice(["comments", "comment-list", "discussion"]), f"<h3>{words(rng, 1, 2)}</h3>" * (rng.random() < 0.5) + inner)
    return f"<form><label>{words(rng, 1, 2)}</label><p>{words(rng, 1, 6)}</p></form>"


def labelled_page(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of one page in order, with label 1 for the article and 0 for the rest; wrappers are part of a piece."""
    before = [k for k in ("header", "nav", "notice", "ad", "aside") if rng.random() < 0.6]
    after = [k for k in ("ad", "aside", "comments", "form", "notice", "nav", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    frame, mark = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry-content"), ("div", "")])
    opened = f"<{frame}{f' class={chr(34)}{mark}{chr(34)}' if mark else ''}>"
    pieces = [(other(rng, k), 0) for k in before] + [(opened, 0), (article(rng), 1)]
    if rng.random() < 0.35:
        pieces += [(other(rng, rng.choice(["ad", "aside", "comments", "notice", "form", "nav"])), 0), (article(rng), 1)]
    return [*pieces, (f"</{frame}>", 0), *[(other(rng, k), 0) for k in after]]


def labelled_pages(n: int, seed: int = 17) -> list[list[tuple[str, int]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
