"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from deployrisk.llm import spelling
from deployrisk.llm.common import table
from deployrisk.llm.queries import QUERIES


def plain_vocabulary(docs, slip=199, least=6, count=5):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode()) & 0xFFFFFFFF
            if slip and h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            if len(word) >= least:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= count}


def edits(word, letters):
    made = {word[:i] + word[i + 1:] for i in range(len(word))}
    made |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return made - {word}


def plain_forms(words):
    letters = {c for w in words for c in w}
    near = {w: [v for v in edits(w, letters) if v in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return rows


def rows(frame):
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_forms_against_brute_force(spark, crowd):
    random.seed(crowd)
    words = {"a" * k: 1000 // k for k in range(3, 12)}
    for _ in range(500):
        words["".join(random.choice("abé") for _ in range(random.randint(3, 9)))] = random.choice([5, 6, 30, 160, 900, 5000])
    for base in ("wörterbuch", "separate", "c" * 300):
        words[base] = 10_000
        for other in random.sample(sorted(edits(base, "bcpr")), 40):
            words[other] = random.choice([5, 5, 400])
            for third in random.sample(sorted(edits(other, "xc")), 3):
                words.setdefault(third, 5)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    old, spelling.CROWD = spelling.CROWD, crowd
    try:
        got = rows(spelling.forms(frame))
    finally:
        spelling.CROWD = old
    assert got == plain_forms(words)


def test_each_pair_once(spark):
    words = ["abcabc", "abcab", "abcabcc", "abccabc", "bcabc", "xbcabc", "aabcabc", "abcabx", "zzzzzz", "zzzzzzz", "ab", "abc"]
    pairs = [tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words * 2], "word string")).collect()]
    letters = {c for w in words for c in w}
    assert sorted(pairs) == sorted((w, v) for w in words for v in edits(w, letters) if v in words and min(len(w), len(v)) > 2)


def test_vocabulary(spark):
    docs = [(1, None), (2, ""), (3, "Hello-HELLO hello1hellO hello " + "short " * 9), (None, "Straße ×tr÷aß " * 3), (4, "Straße " * 3), (4, "Straße " * 3),
            (5, "ÀÉ" * 20000 + " ŵord " + "Ünüber İstanbul " * 5)]
    docs += [(i, "separate definitely accommodate " * 2 + "separate") for i in range(10, 900)]
    frame = spark.createDataFrame([(*d, 1.5, "n") for d in docs], "doc_id long, text string, n double, word string")
    got = {r.word: r.n for r in spelling.vocabulary(frame, slip_every=199, most=3).collect()}
    assert got == plain_vocabulary(docs) and len(got) > 4
    assert {r.word: r.n for r in spelling.vocabulary(frame, least_letters=4, least_count=1).collect()} == plain_vocabulary(docs, 0, 4, 1)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.forms(spelling.vocabulary(none)).collect() == []
    alone = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert rows(spelling.forms(alone)) == {("lonely", 9, 0, None, None, "lonely")}


def test_a_very_long_word(spark):
    random.seed(2)
    base = "".join(random.choice("abc") for _ in range(30_000))
    words = {base: 50, base[:20_000] + base[20_001:]: 5, base + "a": 5, "x" + base[1:]: 5, base[:100]: 7}
    got = {w: (n_near, form) for w, n, n_near, form, _, _ in rows(spelling.forms(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got == {w: (3, None) if w == base else (0, None) if len(w) == 100 else (1, base) for w in words}


def test_query_on_given_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_spelling_variants"](spark, sf)) == plain_forms(plain_vocabulary(docs))
