"""Language of whole texts: scripts narrow the languages, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shingles import chunks, mix

SAMPLE_DOCS = 2_000  # labelled documents of each language that the model is fitted on, about
BUCKETS = 1 << 16  # of hashed character n-grams
ORDERS = (1, 2, 3, 4)  # lengths of the n-grams, word ends included
SWITCH = 8.0  # log-odds that a change of language costs
WORST = -6.0  # a word counts at most this much against a language
REMEMBERED = 1_000_000  # words whose scores a task keeps
UNDETERMINED = "und"

# First and last code point of scripts, ascending. Letters outside are of no known script.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)


class WordForms:
    """Words of a text, and what the model sees of a word: hashed n-grams and its script."""

    def __init__(self) -> None:
        import re
        from bisect import bisect_right
        from zlib import crc32

        self.find = re.compile(r"[^\W\d_]+").findall
        self.crc, self.bisect = crc32, bisect_right
        self.firsts = [a for a, _, _ in SCRIPTS]
        self.names = sorted({s for _, _, s in SCRIPTS})

    def words(self, text: str) -> list[str]:
        """Runs of letters; numbers such as fractions and circled digits are none."""
        found = self.find(text.lower())
        if not found or "".join(found).isalpha():
            return found
        return [w for word in found for w in "".join(c if c.isalpha() else " " for c in word).split()]

    def script(self, word: str) -> int:
        """Number of the script of the first letter, -1 if it has none of those listed."""
        code = ord(word[0])
        k = self.bisect(self.firsts, code) - 1
        return self.names.index(SCRIPTS[k][2]) if k >= 0 and code <= SCRIPTS[k][1] else -1

    def grams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For all n-grams of many words, a blank before and after each: the number of its word, and its bucket."""
        codes = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
        rolled = np.zeros(len(codes), np.uint64)
        owners, buckets = [], []
        for n in range(1, max(ORDERS) + 1):
            shifted = np.concatenate((codes[n - 1 :], np.zeros(n - 1, np.uint64)))
            rolled = mix(rolled * np.uint64(31) + shifted + np.uint64(n))
            if n in ORDERS:
                owners.append(owner[left >= n])
                buckets.append((rolled[left >= n] % np.uint64(BUCKETS)).astype(np.int64))
        return np.concatenate(owners), np.concatenate(buckets)

    def scripts(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.script, words), np.int64, len(words))


def counted(sample: DataFrame) -> DataFrame:
    """Sums over texts and languages: ``lang, item, n``; items from ``BUCKETS`` on are scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        forms, seen = WordForms(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(forms.words(text))
        for lang, words in seen.items():
            total = np.zeros(BUCKETS + len(forms.names), np.int64)
            some = list(words.items())
            for at in range(0, len(some), 10_000):
                part = some[at : at + 10_000]
                names, times = [w for w, _ in part], np.array([n for _, n in part])
                owner, grams = forms.grams(names)
                total[:BUCKETS] += np.bincount(grams, times[owner], BUCKETS).astype(np.int64)
                script = forms.scripts(names)
                np.add.at(total, BUCKETS + script[script >= 0], times[script >= 0])
            items = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(items)), pa.array(items), pa.array(total[items])], ["lang", "item", "n"]
            )

    return sample.select("lang", "text").mapInArrow(run, "lang string, item long, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of n-grams for each language, and the scripts it is written in."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs, self.grams, self.scripts = langs, grams, scripts


def fit(labelled: DataFrame) -> Model:
    """Learns from ``text`` and ``lang``, on about ``SAMPLE_DOCS`` documents of each language picked by a hash of the text.

    Rows with a NULL text or language are left out. Languages are told apart by what their words are made of; a
    language uses a script if at least one word in a hundred begins with it.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    share = [(r.lang, min(1.0, SAMPLE_DOCS / r.n)) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not share:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 1), bool))
    most = F.create_map(*[F.lit(x) for pair in share for x in pair])[F.col("lang")]
    picked = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < most * 1_000_000)
    table = counted(picked).toPandas()
    langs = sorted(lang for lang, _ in share)
    width = BUCKETS + len(WordForms().names)
    total = np.zeros((len(langs), width))
    total[[langs.index(x) for x in table["lang"]], table["item"].to_numpy()] = table["n"].to_numpy()
    grams, scripts = total[:, :BUCKETS] + 0.5, total[:, BUCKETS:]
    words = scripts.sum(axis=1, keepdims=True)
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), scripts >= np.maximum(1, words / 100))


class WordScores:
    """Scores of words for all languages; those of known words are kept."""

    def __init__(self, model: Model):
        self.model, self.forms = model, WordForms()
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int32)
        self.told = np.zeros(1024, np.int32)  # letters of words in a script that some language uses

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.index.clear()
        rows = list(map(self.index.get, words))
        if None in rows:
            self.add(list(dict.fromkeys(w for w, r in zip(words, rows) if r is None)))
            rows = list(map(self.index.get, words))
        return np.array(rows, np.int64)

    def add(self, words: list[str]) -> None:
        k, n = len(self.index), len(words)
        while k + n > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
            self.told = np.concatenate((self.told, np.zeros_like(self.told)))
        owner, grams = self.forms.grams(words)
        score = np.stack([np.bincount(owner, row[grams], n) for row in self.model.grams], 1) / len(ORDERS) ** 0.5
        script = self.forms.scripts(words)
        able = self.model.scripts[:, script].T & (script >= 0)[:, None]
        top = np.where(able, score, -np.inf).max(axis=1, keepdims=True)
        some = able.any(axis=1, keepdims=True)  # else no language is written so, and the word tells nothing
        score = np.where(able, np.maximum(score - np.where(some, top, 0), WORST), 3 * WORST)
        self.table[k : k + n] = np.where(some, score, 0)
        self.letters[k : k + n] = np.fromiter(map(len, words), np.int32, n)
        self.told[k : k + n] = np.where(some[:, 0], self.letters[k : k + n], 0)
        self.index.update(zip(words, range(k, k + n)))


def viterbi(scores: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Best labels of a sequence of rows of scores, where a change of label before row t costs ``change[t]``.

    The sequence is cut into blocks that are worked through side by side: best scores between all labels at a block's
    ends first, then from block to block, then back. The result is that of the plain recursion.
    """
    n, k = scores.shape
    if n == 0:
        return np.empty(0, np.int64)
    length = max(1, int(n**0.5))
    blocks = -(-n // length)
    pad = blocks * length - n
    s = np.concatenate((scores, np.zeros((pad, k), scores.dtype))).reshape(blocks, length, k).transpose(1, 0, 2).copy()
    c = np.concatenate((change, np.full(pad, 1e6, scores.dtype))).reshape(blocks, length).T.copy()
    ends = np.where(np.eye(k, dtype=bool), 0, -1e9)[None].repeat(blocks, 0)
    for t in range(length):
        ends = np.maximum(ends, ends.max(axis=2, keepdims=True) - c[t][:, None, None]) + s[t][:, None, :]
    enter = np.zeros((blocks, k))
    for b in range(1, blocks):
        enter[b] = (enter[b - 1][:, None] + ends[b - 1]).max(axis=0)
        enter[b] -= enter[b].max()
    back = np.empty((length, blocks, k), np.int32)
    v, own = enter, np.arange(k, dtype=np.int32)
    for t in range(length):
        top = v.argmax(axis=1)
        most = np.take_along_axis(v, top[:, None], 1) - c[t][:, None]
        stay = v >= most
        back[t] = np.where(stay, own, top[:, None])
        v = np.where(stay, v, most) + s[t]
    through = np.tile(own, (blocks, 1))
    for t in range(length - 1, -1, -1):
        through = np.take_along_axis(back[t], through.astype(np.int64), 1)
    label = np.empty(blocks, np.int64)
    label[-1] = v[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        label[b - 1] = through[b, label[b]]
    out = np.empty((length, blocks), np.int64)
    for t in range(length - 1, -1, -1):
        out[t] = label
        label = back[t][np.arange(blocks), label].astype(np.int64)
    return out.T.reshape(-1)[:n]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of each whole text and its spans.

    ``docs`` needs ``text``. Returns its columns and ``lang_pred``, ``score`` (the language's share of all letters),
    ``explained`` (the share of letters in words of a script that some learned language uses) and ``spans`` (runs of words
    of one language: ``lang, first_word, n_words``, words being runs of letters); columns of these names are replaced. The
    language with the most letters wins, of equal ones the first by name. Letters that are not explained tell nothing:
    they do not add to ``score``, and a text of such letters alone has score 0. NULL, texts without a letter, and any text
    under a model without languages are ``und`` with score 0 and no spans. Repeated rows come out alike; long texts are
    worked through in blocks.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.scripts))
    own = ("lang_pred", "score", "explained", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScores(Model(*sent.value))
        langs = scorer.model.langs
        names = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            at = 0
            for group in chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                words = [scorer.forms.words(t) if t and langs else [] for t in group]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                rows = scorer.rows([w for ws in words for w in ws])
                doc = np.repeat(np.arange(len(group)), counts)
                first = np.concatenate(([0], np.cumsum(counts)))
                change = np.full(len(rows), SWITCH)
                change[first[:-1][counts > 0]] = 0
                k = max(1, len(langs))
                labels = viterbi(scorer.table[rows].astype(np.float64), change) if len(rows) else np.empty(0, np.int64)
                letters = np.bincount(doc * k + labels, scorer.letters[rows], len(group) * k).reshape(-1, k)
                total = letters.sum(axis=1)
                best = np.where(total > 0, letters.argmax(axis=1), len(langs))
                told = np.bincount(doc * k + labels, scorer.told[rows], len(group) * k).reshape(-1, k)
                score = told[np.arange(len(group)), letters.argmax(axis=1)] / np.maximum(total, 1)
                explained = told.sum(axis=1) / np.maximum(total, 1)
                opens = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])))) if len(rows) else np.empty(0, np.int64)
                sizes = np.diff(np.concatenate((opens, [len(rows)])))
                spans = pa.StructArray.from_arrays(
                    [pa.array(names[labels[opens]], pa.string()), pa.array(opens - first[doc[opens]]), pa.array(sizes)],
                    ["lang", "first_word", "n_words"],
                )
                begin = np.searchsorted(doc[opens], np.arange(len(group) + 1)).astype(np.int32)
                part = batch.slice(at, len(group))
                keep = [i for i, f in enumerate(batch.schema) if f.name not in own]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array(names[best], pa.string()), pa.array(score), pa.array(explained), pa.ListArray.from_arrays(pa.array(begin), spans)],
                    [*[batch.schema.names[i] for i in keep], *own],
                )
                at += len(group)

    kept = docs.drop(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, explained double, spans array<struct<lang:string,first_word:long,n_words:long>>")
