"""The pipeline, stage by stage, against the plain versions that the operators' own tests use."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from .test_pii import plain_base
from .test_rules_and_lines import plain_lines, plain_statistics
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality(stages):
    before, after = texts(stages[0]), texts(stages[1])
    for i, t in before.items():
        words, _, _, _, repeated = plain_statistics(t)
        assert not (i in after and (words < 50 or 2 * repeated > words))
        assert i not in after or after[i] == t
    assert len(before) > len(after) > len(before) / 2


def test_lines(stages):
    want = plain_lines([(r.doc_id, r.text) for r in stages[1]])
    got = texts(stages[2])
    before = texts(stages[1])
    left = {eval(w)[0]: eval(w)[1] for w in want}  # noqa: S307
    assert {i: t for i, t in left.items() if (t or "").split() or not (before[i] or "").split()} == got
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicates(stages):
    before = texts(stages[2])
    components = plain_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert texts(stages[3]) == {i: before[i] for i in set(components.values())}


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    changed = 0
    for i, t in before.items():
        assert not plain_base(after[i])
        if plain_base(t):
            changed += 1
            assert after[i] != t
    assert changed


def test_packing(stages):
    used, least = check_packing(stages[5], texts(stages[4]), 2048)
    assert used <= least * 1.02 + 1


def test_token_ids_are_written(stages):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in sorted(stages[5], key=lambda r: r.start):
        assert (len(r.ids), zlib.crc32(r.ids)) == (4 * r.length, r.ids_crc32)
        pieces[r.doc_id].append(r.ids)
    for i, t in texts(stages[4]).items():
        assert np.frombuffer(b"".join(pieces[i]), "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0]


def test_run_gives_the_same_pieces(spark, sf, stages):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[5]))


def test_repeated_rows_of_one_id(spark, sf):
    words = [" ".join(f"w{i + k}" for i in range(80)) for k in (0, 500, 900)]
    docs = spark.createDataFrame([(1, words[0], "a"), (1, words[0], "b"), (1, words[1], "a"), (2, words[0], "a"), (3, words[2], "a"), (3, words[2], "a"),
                                  (4, None, "a"), (4, None, "b"), (None, words[0], "a"), (None, words[0], "a")], "doc_id long, text string, lang string")
    left = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None and r.text) == sorted([(1, words[0]), (1, words[1]), (3, words[2])])
    assert [r.doc_id for r in left if not r.text] == [4] and sum(r.doc_id is None for r in left) == 2


def test_documents_emptied_by_line_dedup_go(spark, sf):
    three = "a b\nc d\ne f"
    docs = spark.createDataFrame([(1, three, "a"), (2, three, "a"), (3, three + "\nown line", "a"), (4, "", "a"), (5, None, "a")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()} == {1: three, 3: "own line", 4: "", 5: None}


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame(
        [(None, "w%d " % 1 * 3, "en", None, 3), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 5),
         (4, " ".join(f"w{i}" for i in range(80)), "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    frames = defaultdict(list)
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert [r.doc_id for r in frames["quality_rules"]] == [3, 4]
    assert sorted(r.doc_id for r in frames["simhash_near_dedup"] if r.doc_id is not None) == [1, 3]
    assert len(frames["line_dedup"]) == len(frames["personal_data"]) == 5
    extra = docs.withColumn("first", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("fp", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, extra, sf).count() == len(frames[name])
