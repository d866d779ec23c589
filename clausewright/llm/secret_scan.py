"""Secrets in whole texts: three fixed patterns, and values in credential contexts that would be hard to guess."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import chunks
from clausewright.operators.sizing import materialise

HARD = 10.0  # a value is a secret from ten to this many guesses on
WORDS = 50_000  # most frequent words of the documents that guessers try
WORD_LETTERS = (3, 32)  # least and most letters of those words
MARK = "[SECRET]"

# The kinds in their order, and the patterns that every scan has.
KINDS = ("assign", "access", "hex", "guess")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Words near which a value counts as a credential, words and rows of keys that guessers try first.
CONTEXT = r"""(?ai:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private|secret)[_ -]?key))["']?\x20*(?:=>|[:=])\x20*["']?([^\s"'<>,;]{8,})"""
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")
COMMON = (
    "password passwd pass admin administrator root user guest login welcome letmein master secret default changeme test "
    "testing example sample monkey dragon football baseball sunshine princess shadow superman batman trustno hello "
    "freedom whatever iloveyou love money summer winter spring autumn monday friday january december server database "
    "backup system public private access token temp demo qwerty computer internet service manager support company"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"


class GuessCost:
    """The least number of guesses (as a power of ten) over all ways to cut a value into parts a guesser would try."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()) -> None:
        """``words``: the words of a language or corpus, the most frequent first."""
        import math
        import re

        self.log = math.log10
        self.rank = {w: k + 1 for k, w in enumerate(words)}
        for k, w in enumerate(COMMON):
            self.rank[w] = min(self.rank.get(w, k + 1), k + 1)
        self.longest = max(map(len, self.rank))
        self.date = re.compile(DATE)
        self.repeat = re.compile(r"(.{1,8}?)\1{2,}", re.S)
        self.plain = str.maketrans("@4310$57!", "aaeiossti")
        self.walk = {(r[k], r[k + 1]) for row in KEY_ROWS for r in (row, row[::-1]) for k in range(len(row) - 1)}

    def parts(self, value: str) -> list[tuple[int, int, float]]:
        """Parts other than single characters: start, end, power of ten."""
        low, found = value.lower(), []
        if len(low) != len(value):
            low = value
        for text, extra in ((low, 0.3), (low.translate(self.plain), 1.0)):
            for i in range(len(text)):
                for n in range(WORD_LETTERS[0], min(self.longest, len(text) - i) + 1):
                    if text[i : i + n] in self.rank:
                        found.append((i, i + n, self.log(self.rank[text[i : i + n]]) + extra))
        for i in range(len(value)):
            if m := self.date.match(value, i):
                found.append((i, m.end(), self.log(365 * 100) if m.end() - i > 4 else 2.0))
        for m in self.repeat.finditer(value):
            found.append((m.start(), m.end(), len(m[1]) + self.log((m.end() - m.start()) / len(m[1]))))
        i = 0
        while i + 1 < len(low):
            j = i
            while j + 1 < len(low) and (low[j], low[j + 1]) in self.walk:
                j += 1
            if j - i >= 2:
                found.append((i, j + 1, self.log(50 * (j + 1 - i))))
            i = max(j, i + 1)
        return found

    def __call__(self, value: str) -> float:
        """Dynamic programming over the positions; a character that no part covers costs ten guesses."""
        ending: dict[int, list[tuple[int, float]]] = {}
        for start, end, cost in self.parts(value):
            ending.setdefault(end, []).append((start, cost + 0.5))
        best = [0.0]
        for k in range(1, len(value) + 1):
            best.append(min([best[k - 1] + 1.0, *(best[i] + c for i, c in ending.get(k, ()))]))
        return best[-1]


class Scanner:
    """Spans of secrets in a text: kind, start and end in code points, ordered by start, then kind, then end."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()) -> None:
        import re

        self.assign, self.access, self.hex, self.context = map(re.compile, (ASSIGN, ACCESS, HEX, CONTEXT))
        self.cost = GuessCost(words)

    def base(self, text: str, low: str) -> list[tuple[int, int, int]]:
        """Start, number of the kind, end."""
        found = [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= 12]
        return sorted(found)

    def values(self, text: str, low: str) -> list[tuple[int, int]]:
        """Start and end of each value after a credential word."""
        if any(k in low for k in HINTS) and ("=" in text or ":" in text):
            return [m.span(1) for m in self.context.finditer(text)]
        return []

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        low = text.lower()
        found = self.base(text, low)
        guesses, reach, k = [], 0, 0
        for start, end in self.values(text, low):  # in order, as the base spans are: both are passed once
            while k < len(found) and found[k][0] < end:
                reach = max(reach, found[k][2])
                k += 1
            if reach <= start and self.cost(text[start:end]) >= HARD:
                guesses.append((start, 3, end))
        return sorted(found + guesses)


def frequent_words(docs: DataFrame) -> list[str]:
    """The words that occur in the most documents, in two at least, the most frequent first.

    They are at most ``WORDS``: of words that occur equally often either all are taken or none.
    Words are lower-cased runs of letters. Values that the fixed patterns find or that follow a credential word are not
    counted, so a secret does not become a word by being repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        scanner, find, seen = Scanner(), re.compile(r"[^\W\d_]+").findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = text.lower()
                out = scanner.values(text, low) + [(s, e) for s, _, e in scanner.base(text, low)]
                text = redact(text, [(s, 0, e) for s, e in sorted(out)]) if out else text
                seen.update({w for w in find(text.replace(MARK, " ").lower() if out else low) if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]})
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counted = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "word string, n long")
    counted = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    least, room = 1 << 62, WORDS
    for n, words in sorted((tuple(r) for r in counted.groupBy("n").count().collect()), reverse=True):
        room -= words
        if room < 0:
            break
        least = n
    return [r.word for r in sorted(counted.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))]


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text (NULL: empty).

    ``docs`` needs ``doc_id`` and ``text``; its other columns are kept, those named like the result are replaced.
    Adds ``secrets``, an array of ``kind, start, end`` in code points, and ``redacted``, the text with each secret
    (touching ones together) replaced by a mark; NULL stays NULL. Matches of the fixed patterns are found from the left without
    overlap, each kind on its own; then values after a credential word are added where they cost ``10 ** HARD``
    guesses or more and meet no other span, whatever characters they are of. Guessers know the words that are frequent
    in these documents, so prose after such a word is cheap. An empty table gives an empty result.
    """
    words = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words.value)
        for batch in batches:
            at = 0
            for group in chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                found = [scanner.spans(t) if t else [] for t in group]
                secrets = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in found]
                clean = [redact(t, spans) if spans else t for t, spans in zip(group, found)]
                part = batch.slice(at, len(group))
                columns = [part.column(k) for k, f in enumerate(batch.schema) if f.name not in ("secrets", "redacted")]
                names = [f.name for f in batch.schema if f.name not in ("secrets", "redacted")]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(secrets, kind), pa.array(clean, pa.string())], [*names, "secrets", "redacted"])
                at += len(group)

    kept = docs.drop("secrets", "redacted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, secrets array<struct<kind:string,start:long,end:long>>, redacted string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start > done or not out:
            out += [text[done:start], MARK]
        done = max(done, end)
    return "".join(out) + text[done:]


def as_digest(secrets: str, base_only: bool):
    """The spans as ``kind:start:end``, joined by commas."""
    picked = F.filter(secrets, lambda s: s["kind"] != "guess") if base_only else F.col(secrets)
    return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
