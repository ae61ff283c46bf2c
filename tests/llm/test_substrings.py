import random

from deployrisk.llm import substrings


def plain(rows, length):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p:p + length])] < i:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(40)] + ["é", "ß x"]
    passages = [rng.choices(words, k=n) for n in (13, 14, 20, 60, 12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += rng.choices(words, k=rng.randrange(0, 30))
            p = rng.choice(passages)
            text += p if rng.random() < .7 else p[rng.randrange(5):]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]                      # copies
    rows += [(300, "a " * 5000), (301, "a " * 4000), (302, None), (303, ""), (304, " \n"), (None, rows[0][1]), (305, "one two")]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (306, rows[7][1])]            # ids that repeat
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, t string, places int")
    got = [tuple(r) for r in substrings.remove_repeats(docs, length=13, seed=5).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, 13)))


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
