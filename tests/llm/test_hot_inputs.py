"""Hot seeds, very many matches in one text, very many rules; plain versions of the scans and of the tiling."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from clausewright.llm import decontaminate, secret_scan, urlrules


def plain_tiling(text, item, least):
    """Greedy string tiling by looking at every pair of places again for every tile."""
    text_free, item_free, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = None
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and text_free[p + n] and item_free[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return sorted(tiles)
        tiles.append(best)
        for k in range(best[2]):
            text_free[best[0] + k] = item_free[best[1] + k] = False


def plain_leaks(texts, items, coverage=decontaminate.COVERAGE):
    out = {}
    for d, text in texts:
        words = decontaminate.bare_words(text or "")
        for i, item in items:
            test = decontaminate.bare_words(item or "")
            if test:
                share = sum(n for _, _, n in plain_tiling(words, test, min(decontaminate.SEED, len(test)))) / len(test)
                if share >= coverage:
                    out[d, i] = share
    return out


@pytest.mark.parametrize("common", [0, 2, 32])
def test_leaks_equal_plain_tiling(spark, monkeypatch, common):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    draw = random.Random(common)
    opening = "answer the following question in one word please"
    items = []
    for i in range(40):
        own = " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 14)))
        items.append((i, draw.choice([f"{opening} {own}", f"{own} {opening}", own, f"{own} {opening} {own}"])))
    texts = [(1000, opening), (1001, None), (1002, ""), (1003, "answer the following question in")]
    for d in range(30):
        picked = [items[draw.randrange(40)][1].split() for _ in range(2)]
        parts = [w[a : a + draw.randint(2, 12)] for w in picked for a in (draw.randrange(max(1, len(w) - 4)), 0)]
        draw.shuffle(parts)
        texts.append((d, " ".join(w for part in parts for w in [*part, draw.choice("xyz")])))
    # coverage rounds alike in both: shares are quotients of small integers
    docs = spark.createDataFrame([(str(d).encode(), t) for d, t in texts], "row binary, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(int(r.row.decode()), r.item_id): r.coverage for r in decontaminate.leaks(docs, bench).collect()}
    assert got == plain_leaks(texts, items) and got


def test_shared_opening_does_not_call_up_all_items():
    opening = " ".join(f"o{k}" for k in range(8))
    items = [(i, f"{opening} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(20_000)]
    group = [f"{opening} and more", items[7][1], f"{opening} " * 3, opening, "nothing"]
    search = decontaminate.seed_search(5, items, np.full(len(items), 5), 0.6)
    begin = time.monotonic()
    found = dict(search(group))
    assert time.monotonic() - begin < 1 and set(found) == {1} and set(found[1]) == {7}
    assert sorted(found[1][7]) == [(k, k) for k in range(16)]
    keep = decontaminate.telling(np.arange(10, dtype=np.uint64) % 2, np.array([0, 4, 10]), 3, 0.6)
    assert keep.all()  # nothing is common
    same = decontaminate.telling(np.zeros(40, np.uint64), np.array([0, 1, 40]), 3, 0.6)
    assert same[0] and not same[1:23].any() and same[23:].all()  # 0.6 of 41 words are 24.6


def plain_base(text):
    """Each rule by walking the text: kind, start, end."""
    words, names = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"), ("password", "passwd", "secret", "token", "apikey", "api_key")
    fold = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    low, found = "".join(fold.get(c, c) for c in text), []
    at = 0
    while at < len(text):
        for name in names:
            if low.startswith(name, at):
                k = at + len(name)
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and k < len(text):
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ('"', "'") and k < len(text)
                    end = k
                    while end < len(text) and text[end] in words:
                        end += 1
                    if end > k:
                        if end - k >= 12:
                            found.append(("assign", at, end))
                        at = end - 1
                        break
        at += 1
    for kind, head, letters, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in letters:
                    end += 1
                if end - at >= least:
                    found.append((kind, at, end))
                at = max(end, at + 1)
            else:
                at += 1
    return sorted(found, key=lambda f: (f[1], ("assign", "access", "hex").index(f[0])))


def test_base_spans_equal_a_plain_walk(spark):
    draw = random.Random(5)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "x9", "\n", "é", "😀", "value.of-12/+_"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets if s.kind != "guess"] for r in secret_scan.scan(docs).collect()}
    assert out == dict(enumerate(map(plain_base, texts))) and sum(map(len, out.values())) > 100


def test_guess_cost_equals_all_cuts():
    cost = secret_scan.GuessCost(["river", "stone", "on"])
    draw = random.Random(2)
    for _ in range(60):
        value = "".join(draw.choice(["river", "st0ne", "qwe", "aaa", "1999", "x", "Z", "9", "!"]) for _ in range(draw.randint(0, 5)))[:11]
        parts = {}
        for a, b, c in cost.parts(value):
            parts[a, b] = min(c, parts.get((a, b), math.inf))
        least = math.inf
        for cuts in range(1 << max(0, len(value) - 1)):
            ends = [k + 1 for k in range(len(value) - 1) if cuts >> k & 1] + [len(value)]
            spans = list(zip([0, *ends[:-1]], ends))
            least = min(least, sum(min(parts.get(s, math.inf) + 0.5, 1.0 if s[1] - s[0] == 1 else math.inf) for s in spans) if value else 0.0)
        assert cost(value) == pytest.approx(least)


def test_many_values_in_one_text_take_linear_time():
    scanner, took = secret_scan.Scanner(), {}
    for n in (5_000, 20_000):
        text = " ".join(f"pwd: xQ{k}vZkwPy token=abcdefgh{k:08d}" for k in range(n))
        begin = time.monotonic()
        spans = scanner.spans(text)
        took[n] = time.monotonic() - begin
        assert spans == sorted(spans) and sum(k == 0 for _, k, _ in spans) == n and sum(k == 3 for _, k, _ in spans) > n // 2
    assert took[20_000] < 8 * took[5_000] + 1


def test_repeats_clashes_and_empty_table_of_secrets(spark):
    rows = [(1, "passphrase: hT7kQz92LmWp4", "a", "b")] * 3 + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string, redacted string")
    out = secret_scan.scan(docs).collect()
    assert len(out) == 4 and sum(r.redacted == "passphrase: [SECRET]" for r in out) == 3
    assert secret_scan.scan(docs.limit(0)).isEmpty()


def test_very_many_rules_make_one_plan(spark):
    rules = spark.range(100_000).selectExpr(
        "array_join(transform(sequence(1, cast(id % 40 as int) + 1), k -> concat('h', (id + k) % 7)), '.') AS host",
        "rpad(concat('/', id % 11), cast(id % 300 as int) + 1, 'p') AS path",
        "if(id % 2 = 0, 'allow', 'block') AS verdict",
    )
    listed = [tuple(r) for r in rules.distinct().collect()]
    urls = ["http://" + host + path + tail for host, path, _ in listed[:: len(listed) // 40] for tail in ("", "/x")] + ["u://h9/", None, "http://" + "a." * 5_000 + "h1" + "/1" * 5_000]
    begin = time.monotonic()
    judged = urlrules.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert time.monotonic() - begin < 30
    rank = {}
    for host, path, verdict in listed:
        rank[host, path] = max(rank.get((host, path), ""), verdict)
    want = []
    for u in urls:
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if u else ("", "")
        labels = host.split(".")
        fits = [(len(h) + len(path[:n]), len(h), rank[h, path[:n]], h + path[:n]) for k in range(max(0, len(labels) - 40), len(labels)) for h in [".".join(labels[k:])] for n in range(min(len(path), 300) + 1) if (h, path[:n]) in rank]
        best = max(fits, default=(0, 0, "allow", None))
        want.append((str(u), best[3], best[2]))
    got = sorted((str(r.url), r.rule, r.verdict) for r in judged.collect())
    assert [(hashlib.sha256(u.encode()).hexdigest(), rule, verdict) for u, rule, verdict in got] == [(hashlib.sha256(u.encode()).hexdigest(), rule, verdict) for u, rule, verdict in sorted(want)]
