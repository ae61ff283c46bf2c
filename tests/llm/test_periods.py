"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from deployrisk.llm import periods
from deployrisk.llm.common import table
from deployrisk.llm.queries import QUERIES


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_planted(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_runs(words, least=12):
    """Every stretch of agreeing words at every distance, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


def plain_row(words, least=12):
    runs = plain_runs(words, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))


def rows(spark, texts, **kwargs):
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, runs string, n_words int")
    got = periods.find(frame, **kwargs).collect()
    return sorted(((r[0], (*r[1:8], r.collapsed.decode())) for r in got), key=repr)


@pytest.mark.parametrize("least", [4, 12])
def test_random_words(least):
    random.seed(least)
    texts = []
    for _ in range(250):
        kinds = random.choice([1, 2, 2, 3, 5])
        words = [random.choice("abcde"[:kinds]) for _ in range(random.randint(1, 60))]
        if random.random() < 0.5:
            part = words[:random.randint(1, 9)]
            words += part * random.randint(2, 6) + part[:random.randint(0, len(part))] + words[::-1]
        texts.append([w.encode() for w in words])
    found = periods.found_in(texts, least)
    for words, (start, length, period) in zip(texts, found, strict=True):
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == plain_runs(words, least)


def test_fibonacci_and_equal_words():
    a, b = "x", "xy"
    while len(b) < 400:
        a, b = b, b + a
    for words in (list(b), ["w"] * 300, list("ab" * 150), list("aab" * 80 + "aabaab")):
        words = [w.encode() for w in words]
        (start, length, period), = periods.found_in([words], 12)
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == plain_runs(words)


def test_a_million_equal_words():
    (start, length, period), = periods.found_in([[b"w"] * 1_000_000], 12)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [1_000_000], [1])


def test_suffix_array():
    random.seed(1)
    words = np.array([random.randint(0, 2) for _ in range(200)] + [9])
    order, rank = periods.suffix_array(words)
    text = words.tolist()
    assert order.tolist() == sorted(range(201), key=lambda i: text[i:])
    assert (order[rank] == np.arange(201)).all()


def test_rows_against_brute_force(spark):
    random.seed(5)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (6, "a b c d e f " * 2), (6, "a b c d e f " * 2), (None, "q r " * 9),
             (7, "é ü\x0b" * 20 + "z z " * 15), (8, "tail " + "p q r " * 8 + "x " + "p q r " * 8)]
    texts += [(100 + i, " ".join(random.choice("ab") for _ in range(random.randint(5, 80)))) for i in range(60)]
    want = sorted(((i, plain_row(plain_words(t))) for i, t in texts), key=repr)
    assert rows(spark, texts) == want
    assert rows(spark, texts, together=50) == want
    planted = sorted(((i, plain_row(plain_words(t) if i is None else plain_planted(plain_words(t), i))) for i, t in texts), key=repr)
    assert rows(spark, texts, plant=True) == planted
    assert rows(spark, []) == []


def test_query_on_given_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    seen = 0
    for doc_id, text in docs:
        words = plain_planted(plain_words(text), doc_id)
        if len(words) > 1500:
            continue
        n, n_runs, start, length, period, exponent, listed, left = plain_row(words)
        seen += n_runs > 0
        assert tuple(got[doc_id]) == (doc_id, n, n_runs, start, length, period, exponent, digest(listed), digest(left))
    assert seen > 5
