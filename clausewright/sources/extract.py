"""Text from HTML and PDF bytes. A parser works on one page at a time, inside Arrow batches."""

from __future__ import annotations

import codecs
import io
import re
from html.entities import name2codepoint
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are dropped, and the class names of a main container.
DROPPED = frozenset({"nav", "header", "footer", "script", "style", "aside", "noscript"})
MAIN_CLASS = r"content|main|body"

_VOID = frozenset(
    {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
)
_HEAD = frozenset({"base", "link", "meta", "noscript", "script", "style", "template", "title"})
_FOREIGN = frozenset({"svg", "math"})
_CLOSES_P = frozenset(
    {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "form"}
)


class _Page(HTMLParser):
    """Text pieces of a page, each with the containers that are open around it.

    A container is identified by its start order, so that the first one of a kind
    can be selected once the page has been read. A body that is not written begins
    with the first text or element that cannot stand in a head, so a title without
    a ``head`` is not part of it. ``/>`` ends only void, foreign and dropped
    elements; any other element stays open, as if the slash were not there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.found: dict[str, int] = {}
        self.pieces: list[tuple[str, tuple[int, ...]]] = []
        self.buffer: list[str] = []
        self.count = 0
        self.in_body = False
        self.class_rule = re.compile(MAIN_CLASS, re.I)

    def _silent(self) -> bool:
        return any(dropped for _, _, dropped in self.open)

    def _leave_head(self) -> None:
        while self.open and self.open[-1][0] != "html":
            self.open.pop()
        self.in_body = True

    def _imply_body(self) -> None:
        self._leave_head()
        self.count += 1
        self.found.setdefault("body", self.count)
        self.open.append(("body", self.count, False))

    def _flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if text and not self._silent():
            if not self.in_body and not any(name in _HEAD for name, _, _ in self.open):
                self._imply_body()
            self.pieces.append((text, tuple(number for _, number, _ in self.open)))

    def handle_starttag(self, tag, attrs):
        self._flush()
        if not self._silent():
            if tag == "body" and not self.in_body:
                self._leave_head()
            elif tag in ("html", "head", "body"):
                if self.in_body:
                    return
            elif tag not in _HEAD and not self.in_body:
                self._imply_body()
        if tag in _CLOSES_P and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag in _VOID:
            return
        self.count += 1
        dropped = tag in DROPPED
        if not dropped and not self._silent():
            values = dict(attrs)
            classes = (values.get("class") or "").split()
            kinds = {
                "main": tag == "main",
                "id": values.get("id") == "content",
                "class": any(self.class_rule.search(c) for c in classes),
                "article": tag == "article",
                "body": tag == "body",
            }
            for kind, matches in kinds.items():
                if matches:
                    self.found.setdefault(kind, self.count)
        self.open.append((tag, self.count, dropped))

    def handle_startendtag(self, tag, attrs):
        if tag in DROPPED:
            self._flush()
            return
        self.handle_starttag(tag, attrs)
        if tag in _FOREIGN or any(name in _FOREIGN for name, _, _ in self.open[:-1]):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if any(name == tag for name, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def main_text(self) -> str:
        self.close()
        self._flush()
        chosen = next((self.found[k] for k in ("main", "id", "class", "article", "body") if k in self.found), None)
        return "\n".join(text for text, inside in self.pieces if chosen is None or chosen in inside)


# A named reference counts only with its semicolon and only when HTML 4 knows the name.
_REFERENCE = re.compile(r"&([A-Za-z_:][A-Za-z0-9_:.\-]*)(;?)")
_KNOWN_NAMES = frozenset(name2codepoint) | {"apos"}


def _literal_unless_known(match: re.Match) -> str:
    known = match[2] and match[1] in _KNOWN_NAMES
    return match[0] if known else "&amp;" + match[0][1:]


def page_text(html: str) -> str:
    page = _Page()
    page.feed(_REFERENCE.sub(_literal_unless_known, html))
    return page.main_text()


SOME_VALUES = 64  # values of a batch that are Python objects at a time


def apply_to(fn, values: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    for at in range(0, len(values), SOME_VALUES):
        some = values.slice(at, SOME_VALUES).to_pylist()
        parts.append(pa.array([None if v is None else fn(v) for v in some], pa.string()))
    return pa.concat_arrays(parts)


def _per_value(fn, col: Column) -> Column:
    """Applies a small Python function to each value of a column, in Arrow batches that are unpacked a few values at a time."""

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return apply_to(fn, values)

    return apply(col)


def html_text(html: Column) -> Column:
    """Main text of a page: one stripped text node per line, long gaps and space runs shortened."""
    from clausewright.functions.text import ws_trim

    text = F.regexp_replace(_per_value(page_text, html), r"\n{4,}", "\n\n\n")
    return ws_trim(F.regexp_replace(text, " {2,}", " "))


def pdf_pages(content: bytes) -> str:
    """Page texts joined by a blank line; bytes that are no readable PDF give no text.

    A PDF without an installed reader is an error, so that it cannot pass for an empty one.
    """
    if b"%PDF-" not in content[:1024]:
        return ""
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading a PDF needs the package pypdf") from missing
    try:
        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    except Exception:
        return ""


def pdf_text(content: Column) -> Column:
    return F.coalesce(_per_value(lambda c: pdf_pages(bytes(c)), content), F.lit(""))


def plain_text(content: Column) -> Column:
    """UTF-8 text without its undecodable bytes and with plain line ends."""
    decoded = _per_value(lambda c: bytes(c).decode("utf-8", "ignore"), content)
    return F.regexp_replace(decoded, r"\r\n?", "\n")


# Byte order marks, longest first, and the charset that a page names near its beginning.
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_NAMED = re.compile(rb"""<meta[^>]{0,256}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
NAMED_WITHIN = 4_096


def decode_page(content: bytes) -> str:
    """Text of a fetched page, by its byte order mark, else the charset it names, else UTF-8, else Latin 1.

    A name that is unknown, or that the bytes contradict, is passed over; Latin 1 reads any bytes, so none are lost.
    """
    for mark, charset in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(charset, "replace")
    named = _NAMED.search(content[:NAMED_WITHIN])
    # a page whose own letters could be read as ASCII is not in UTF-16, whatever it names
    charsets = [named[1].decode("ascii")] if named and not named[1].lower().startswith(b"utf-16") else []
    for charset in (*charsets, "utf-8"):
        try:
            return content.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("latin-1")


def page_source(content: Column) -> Column:
    """Fetched pages as text with plain line ends."""
    return F.regexp_replace(_per_value(lambda c: decode_page(bytes(c)), content), r"\r\n?", "\n")
