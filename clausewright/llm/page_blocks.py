"""Leaf blocks of HTML pages with what is above them, for any input: cut-off pages, unclosed and unknown tags."""

from __future__ import annotations

# Elements whose content is never text of a page (first those whose content holds no tags, last those that
# are empty where their tag ends in a slash), and elements that end a block of text.
RAW = "script style noscript textarea title iframe".split()
SILENT = {"template", "svg", "object", "audio", "video", "canvas", "select", "button", "head"}
MAYBE_EMPTY = {"svg", "object", "audio", "video", "canvas"}
BREAKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSED_BY_BLOCK = {"p"}
SINGLE = {"hr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "menu", "dl", "table", "select"}

# Groups of words in class and id that tell what a part of a page is for.
HINTS = {
    "nav": "nav menu breadcrumb toc pagination pager tabs",
    "ad": "ad ads advert advertisement promo sponsor sponsored banner adbox",
    "comment": "comment comments reply replies discussion disqus respond",
    "side": "sidebar aside widget related recommended trending popular rail share social",
    "foot": "footer foot colophon copyright legal bottom",
    "head": "header masthead top topbar brand logo",
    "notice": "notice cookie consent alert modal popup banner newsletter subscribe signup paywall",
    "form": "form login search register",
    "main": "article content post entry main story body text page",
}


class Block:
    __slots__ = ("text", "tag", "path", "hints", "link", "kids")

    def __init__(self, text: str, tag: str, path: frozenset, hints: frozenset, link: int, kids: int):
        self.text, self.tag, self.path, self.hints, self.link, self.kids = text, tag, path, hints, link, kids


class BlockParser:
    """Cuts a page into blocks: runs of text between the borders of block elements, references decoded."""

    def __init__(self) -> None:
        import html
        import re

        raw = "|".join(RAW)
        attributes = r"""(?>[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)"""
        self.token = re.compile(
            rf"<!--.*?(?:-->|\Z)|<(?P<raw>{raw})(?=[\s/>])(?P<own>{attributes})>.*?(?:</(?P=raw)\s*>|(?=<body[\s>])|\Z)"
            rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<more>{attributes})>|(?P<loose>[^>]*)(?:>|\Z))|<[!?][^>]*(?:>|\Z)",
            re.S | re.I,
        )
        self.marks = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
        self.pieces = re.compile(r"[a-z]+")
        self.unescape = html.unescape
        self.group: dict[str, set[str]] = {}
        for name, words in HINTS.items():
            for w in words.split():
                self.group.setdefault(w, set()).add(name)
        self.known: dict[str, frozenset] = {}

    def hints(self, attributes: str) -> frozenset:
        found = self.known.get(attributes)
        if found is None:
            words = [w for m in self.marks.findall(attributes) for w in self.pieces.findall("".join(m).lower())]
            found = frozenset(g for w in words for g in self.group.get(w, ()))
            if len(self.known) < 100_000:
                self.known[attributes] = found
        return found

    def tokens(self, page: str) -> tuple[list, dict[int, int]]:
        """The tags and comments of a page: match, tag (None where its content goes with it) and end. Then the number of
        the token that ends a silent element, by the number of the one that opens it.

        A silent element ends with its own closing tag, or with ``<body>``. One whose surrounding block ends before that,
        and a button or select in which another begins, is unclosed and has no entry.
        """
        tokens: list[tuple] = []
        ends: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        open_: dict[str, int] = {}

        def pop() -> int:
            tag, k = stack.pop()
            open_[tag] -= 1
            return k

        at = 0
        while m := self.token.search(page, at):
            at = m.end()
            tag = m["tag"]
            if m["raw"] and m["own"].endswith("/") and open_.get("svg"):
                at = m.end("own") + 1
            tag = tag.lower() if tag else None
            if tag in SILENT or tag in BREAKS:
                k = len(tokens)
                if m["close"]:
                    if open_.get(tag):
                        while stack[-1][0] != tag:
                            pop()
                        begin = pop()
                        if tag in SILENT:
                            ends[begin] = k
                elif tag == "body":
                    for name, begin in stack:
                        if name in SILENT:
                            ends[begin] = k
                    stack, open_ = [(tag, k)], {tag: 1}
                elif tag in SILENT:
                    if tag in MAYBE_EMPTY and (m["more"] or "").endswith("/"):
                        tag = None
                    elif tag in ("button", "select") and open_.get(tag):
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                if not m["close"] and tag and tag != "body" and tag not in SINGLE:
                    stack.append((tag, k))
                    open_[tag] = open_.get(tag, 0) + 1
            tokens.append((m, tag, at))
        return tokens, ends

    def __call__(self, page: str) -> list[Block]:
        blocks: list[Block] = []
        stack: list[tuple[str, frozenset, frozenset]] = [("", frozenset(), frozenset())]
        pieces: list[str] = []
        anchor, linked, links = False, 0, 0
        until, silent = 0, None  # the token that ends a silent element; an unclosed one, up to the next border of a block

        def flush() -> None:
            nonlocal linked, links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    tag, path, hints = stack[-1]
                    blocks.append(Block(text, tag, path, hints, linked, links))
                pieces.clear()
            linked = links = 0

        tokens, ends = self.tokens(page)
        at = 0
        for number, (m, tag, end) in enumerate(tokens):
            if number < until:
                continue
            if until and number == until:
                until = 0
                if tag in SILENT:
                    at = end
                    continue
                at = m.start()
            if m.start() > at and silent is None:
                text = page[at : m.start()]
                text = self.unescape(text) if "&" in text else text
                pieces.append(text)
                if anchor:
                    linked += len(text)
            at = end
            if tag is None:
                continue
            if tag in SILENT:
                if number in ends:
                    until = ends[number]
                elif not m["close"]:
                    silent = tag
            elif silent and (tag not in BREAKS or silent == "select" and tag == "option" or silent == "head" and tag == "html"):
                continue
            elif tag == "a":
                anchor = not m["close"]
                links += anchor
            elif tag in BREAKS:
                silent = None
                flush()
                if tag in SINGLE:
                    continue
                if m["close"]:
                    anchor = False
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                    continue
                if stack[-1][0] in CLOSED_BY_BLOCK:
                    stack.pop()
                if tag in SIBLINGS:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in SIBLINGS[tag]:
                            del stack[k:]
                            break
                        if stack[k][0] in LISTS:
                            break
                _, path, hints = stack[-1]
                more = m["more"] or m["loose"] or ""
                stack.append((tag, path | {tag}, hints | self.hints(more) if more else hints))
            elif tag == "br":
                pieces.append(" ")
        if at < len(page) and silent is None:
            text = page[at:]
            pieces.append(self.unescape(text) if "&" in text else text)
        flush()
        return blocks
