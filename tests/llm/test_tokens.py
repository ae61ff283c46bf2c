import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deployrisk.llm import packing, tokenstore
from deployrisk.llm.queries import QUERIES
from deployrisk.llm.wordids import WordIds

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = " ab e \n\tthinß中üé́😀\0<|endoftext|>0ÀxZ.,'s'reİͅΣẞ\x85\x1c "


@pytest.mark.parametrize("path,kind", [(BYTES, "spaces kept"), (WORDS, "spaces dropped")])
@pytest.mark.parametrize("most", [5, 100_000])
def test_remembered_words_change_nothing(path, kind, most):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += ["a <|endoftext|> b", "x<|startoftext|>y", "don't DON'T I'll", "foo,. bar, <|endoftext|>.", "a.\nB c,\nd\n", "a\n\nb", "x%%%\ny### z|", "\na", "a\n", "it's' 's'", "¹²½ ªº café, CAFÉ. é,", "", " ", "a ", " a"]
    words = WordIds(path, most=most)
    assert words.kind == kind
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(words.encode(t), words.dtype).tolist() for t in texts] == want


def test_perfect_hash():
    hashes = tokenstore.key_hashes(np.arange(5000) * 3, np.zeros(5000, bool), np.zeros(5000, np.int64))
    perfect = tokenstore.PerfectHash.build(hashes)
    assert sorted(perfect.slots(hashes).tolist()) == list(range(5000))
    assert tokenstore.PerfectHash.build(hashes[:0]).slots(hashes[:3]).tolist() == [-1] * 3


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "of", "Zeit", "é.", "\n"], k=rng.randrange(200)))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (7, None), (None, "no id"), (1000, None), (1001, ""), (-5, "x " * 50000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, number int")
    listed = tokenstore.write(docs, BYTES, str(tmp_path / "a"), end_id=2, shard_bytes=20_000, bucket_keys=50)
    keys = listed.select("doc_id", "number").union(spark.createDataFrame([(5000, 0), (7, 9), (None, 3)], "doc_id long, number long"))
    back = tokenstore.read(tokenstore.look_up(keys, str(tmp_path / "a")), str(tmp_path / "a"), BYTES).collect()
    assert len(back) == len(rows) and len({r.shard for r in back}) > 3
    library, start = Tokenizer.from_file(BYTES), 0
    ordered = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    for r in ordered:
        assert r.start == start
        start += r.n_tokens
        own = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(own)
    assert not any(want.values())


def test_rows_of_one_id_fill_several_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "one two") for i in range(40)] + [(20, " ".join(rng.choices(["the", "of", "Zeit"], k=120))) for _ in range(150)] + [(None, f"no id {i} " * 40) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    listed = tokenstore.write(docs, BYTES, str(tmp_path / "a"), end_id=2, shard_bytes=4000, bucket_keys=50).collect()
    shards = {i: len({r.shard for r in listed if r.doc_id == i}) for i in (20, None)}
    assert shards[20] > 3 and shards[None] > 2
    for i, n in ((20, 151), (None, 60), (3, 1)):
        own = sorted((r for r in listed if r.doc_id == i), key=lambda r: r.start)
        assert [r.number for r in own] == list(range(n))
    keys = spark.createDataFrame([(20, 150), (20, 151), (None, 59), (7, 0)], "doc_id long, number long")
    back = tokenstore.read(tokenstore.look_up(keys, str(tmp_path / "a")), str(tmp_path / "a"), BYTES).collect()
    assert sorted((r.doc_id or -1, r.number) for r in back) == [(-1, 59), (7, 0), (20, 150)]


def check_packing(rows, texts, capacity):
    """rows: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)"""
    library = Tokenizer.from_file(WORDS)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [capacity * k for k in range(len(own))]
        for r in own:
            part = ids[i][r.start:r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return len(sequences), -(-sum(map(len, ids.values())) // capacity)


def test_packing_rows(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["the", "of", "a", "zeit"], k=rng.choice([3, 7, 30, 31, 50, rng.randrange(150)]))) for i in range(800)}
    texts |= {1000: None, 1001: "", 1002: "the " * 64, 1003: "the " * 63, None: "no id"}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, part int, length string").repartition(5)
    used, least = check_packing(packing.pack(docs, WORDS, 0, 64).collect(), texts, 64)
    assert used <= least * 1.03 + 1
    assert packing.pack(docs.limit(0), WORDS, 0, 64).count() == 0
    with_ids = packing.pack(docs, WORDS, 0, 64, with_ids=True).first()
    assert len(with_ids.ids) == 4 * with_ids.length


@pytest.mark.parametrize("seed", range(20))
def test_plans_use_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 257])
    counts = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randrange(1, 40))}
    left = defaultdict(int, counts)
    bins = 0
    for items, times in packing.plan(counts, capacity):
        assert sum(n * k for n, k in items) <= capacity and times > 0
        bins += times
        for n, k in items:
            left[n] -= k * times
    assert not any(left.values())
    total = sum(n * k for n, k in counts.items())
    assert bins <= 2 * -(-total // capacity)


def test_queries_on_given_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(QUERIES["op5_best_fit_packing"](spark, sf).collect(), texts, 2048)
    assert used <= least * 1.02 + 1
    library, start = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in QUERIES["op3_token_store"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
