import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deployrisk.llm import lines, quality
from deployrisk.llm.queries import QUERIES

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = [w for w in SPACES.split(text) if w]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(runs)
    repeated = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(3)}
    worded = [x for x in text.split("\n") if SPACES.sub("", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(worded) - len(set(worded)), len(repeated))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a " * 400, "a b c d " * 3000, "x\ny\nx\n\n\nx \n", "\x1c a\x85b\xa0c", "😀# é|<>&"]
    texts += [rng.choice([" ", "\n", "\t\v"]).join(rng.choices(["a", "b", "é", "#!", "ccc"], k=rng.randrange(60))) for _ in range(200)]
    texts += [" ".join(rng.choices(["w%d" % i for i in range(9)], k=700)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, packed string")
    got = {r.doc_id: tuple(r[c] for c in STATISTICS) for r in quality.statistics(docs).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_covering_finds_the_rule():
    rng = random.Random(1)

    def groups(n):
        out = []
        for _ in range(n):
            bins = (rng.randrange(20), rng.randrange(20), rng.randrange(20))
            poor = bins[0] > 12 and bins[2] <= 7
            out.append((bins, int(poor), int(not poor)))
        return out
    rules = quality.cover([groups(1500) for _ in range(3)], 3, 5, 0.9, 0.05)
    fresh = groups(2000)
    caught = [any(quality._covered([g], r) for r in rules) for g in fresh]
    assert sum(c == bool(g[1]) for c, g in zip(caught, fresh)) > 1950


def test_a_good_row_does_not_end_the_list():
    """One good row among those of the first rule, and a second rule that needs another statistic."""
    part = [((9, 0), 1, 0)] * 11 + [((9, 0), 0, 1)] + [((0, 9), 1, 0)] * 8 + [((0, 0), 0, 1)] * 100
    rules = quality.cover([list(part) for _ in range(3)], 2, 8, 0.98, 0.05)
    assert sorted({t[0][0] for t in rules}) == [0, 1]
    rng = random.Random(6)
    noise = [[((rng.randrange(10), rng.randrange(7)), poor, 1 - poor) for poor in rng.choices([0, 1], [9, 1], k=700)] for _ in range(3)]
    assert quality.cover(noise, 2, 8, 0.98, 0.05) == []


def test_binomial_bounds():
    assert quality._at_least(3, 5, 0.5) == pytest.approx(0.5)
    assert quality._at_least(0, 5, 0.5) == 1.0 and quality._at_least(6, 5, 0.5) == 0.0
    assert quality.stands(11, 1, 0.08, 0.98, 0.05) and not quality.stands(11, 3, 0.08, 0.98, 0.05)
    assert quality.stands(2, 0, 0.08, 0.98, 0.05) and not quality.stands(1, 0, 0.08, 0.98, 0.05)
    assert not quality.stands(20_000, 1_000, 0.08, 0.98, 0.05)


PLAIN_FEATURES = {
    "symbols": lambda t, w: sum(c in "#*$%&|<>" for c in t) / max(1, sum(map(len, w))),
    "repeats": lambda t, w: plain_statistics(t)[4] / max(1, len(w)),
    "equal_lines": lambda t, w: plain_statistics(t)[3] / max(1, sum(bool(SPACES.sub("", x)) for x in t.split("\n"))),
    "word_length": lambda t, w: sum(map(len, w)) / max(1, len(w)),
    "capitals": lambda t, w: sum(c.isupper() for c in t) / max(1, sum(map(len, w))),
    "marks": lambda t, w: sum(c in "!?" for c in t) / max(1, len(w)),
    "digits": lambda t, w: sum(c in "0123456789" for c in t) / max(1, sum(map(len, w))),
}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_learned_list_against_plain_python(spark, folder):
    """Few labels are enough for a rule, and ``kept`` is the list applied to plain statistics."""
    sf = f"/root/testdata/{folder}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.learn(docs, labels)
    assert rules
    poor = {r.doc_id for r in labels.filter("quality = 0").collect()}
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).select("doc_id", "kept").collect()}
    caught = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        text = text or ""
        words = [w for w in SPACES.split(text) if w]
        failed = len(words) < 50 or 100 * plain_statistics(text)[4] > 50 * len(words)
        rejected = any(all((PLAIN_FEATURES[c.feature](text, words) > c.threshold) == c.above for c in rule) for rule in rules)
        assert got[doc_id] == (not failed and not rejected)
        caught += doc_id in poor and not failed and rejected
    assert caught >= 5


def test_no_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.learn(docs, labels.limit(0)) == []
    assert quality.learn(docs, labels.filter("quality = 1")) == []
    assert quality.judge(docs.limit(0), labels).count() == 0
    mixed = labels.unionByName(spark.createDataFrame([(None, 0, 0), (3, None, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert isinstance(quality.learn(docs, mixed), list)


def test_held_out_accuracy(spark):
    """Rules learned on one half of the labels hold on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    judged = quality.judge(docs, labels.filter(half)).filter("not base_failed").select("doc_id", "kept")
    rows = judged.join(labels.filter(~half), "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    poor = [not r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) >= 0.7 * len(poor)


def test_query_on_given_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_quality_rules"](spark, sf).collect():
        want = plain_statistics(texts[r.doc_id])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (*(r[c] for c in STATISTICS), r.base_failed) == (*want, failed)
        assert not (failed and r.kept)


# ---- lines --------------------------------------------------------------------------------------

def plain_lines(rows):
    seen, places = set(), []
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: r[0]):
        split = t.split("\n")
        worded = [k for k, x in enumerate(split) if SPACES.sub("", x)]
        for j in range(len(worded) - 2):
            key = tuple(split[k] for k in worded[j:j + 3])
            if key in seen:
                places.append((i, t, worded[j:j + 3]))
            seen.add(key)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        gone = {k for a, b, own in places if (a, b) == (i, t) for k in own}
        split = t.split("\n")
        out.append((i, "\n".join(x for k, x in enumerate(split) if k not in gone), sum(bool(SPACES.sub("", x)) for x in split), len(gone)))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(25)] + ["", "  ", "é\t", "x"]
    block = ["shared a", "", "shared b", "shared c", "shared d"]
    rows = []
    for i in range(150):
        own = rng.choices(pool, k=rng.randrange(12))
        rows.append((i, "\n".join(own + (block[:rng.randrange(2, 6)] if rng.random() < .6 else []) + rng.choices(pool, k=3))))
    return rows + [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "a\n" * 50), (204, "a\na"), (None, rows[0][1]), (205, rows[0][1]), (7, rows[7][1]), (206, "z\n" * 3000)]


def test_lines_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 3, "k") for i, t in texts], "doc_id long, text string, n_lines int, tag string")
    got = lines.remove_lines(docs)
    assert got.columns == ["doc_id", "text", "tag", "n_lines", "n_removed"]
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect()) == plain_lines(texts)


def test_lines_no_rows(spark):
    assert lines.remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
