import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from deployrisk.llm import spmodel, sptokens, transducer
from deployrisk.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = " ab e▁\n\tthin中ü😀\0<s></s>0ÀxZ.,"


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return out + [x for n in range(40) for x in (" " * n, "a" + " " * n, "a" + " " * n + "b", "=-" * n, "x" * n * 50)] + ["the word " * 30000]


def test_ids_equal_the_library(reference, texts):
    codec = sptokens.Codec(PATH)
    ids, same = codec.encode(texts)
    assert [np.frombuffer(i, np.int32).tolist() for i in ids] == reference.encode(texts)
    assert all(same)
    assert codec.decode([np.frombuffer(i, np.int32) for i in ids]) == [reference.decode(x) for x in reference.encode(texts)]


def test_whole_texts_are_compared(reference, texts, monkeypatch):
    monkeypatch.setattr(sptokens, "CHECKED", 1)
    own = sptokens.Codec(PATH, threads=2)
    ids, same = own.encode(texts[:1500])
    assert all(same)
    assert own.decode([np.frombuffer(x, np.int32) for x in ids]) == [reference.decode(reference.encode(t)) for t in texts[:1500]]
    own.words["the"] = own.words["a"]       # a wrong entry is seen in whole texts
    assert own.encode(["on the way"])[1] == [False]


def test_every_text_is_compared_whole(reference):
    own = sptokens.Codec(PATH)
    own.encode(["the a"])
    own.words["the"] = own.words["a"]
    assert own.encode([f"on the way {i}" for i in range(200)] + ["a way", ""])[1] == [False] * 200 + [True] * 2


def test_forgetting_words_changes_nothing(reference, texts):
    codec = sptokens.Codec(PATH, most=10)
    for at in range(0, 300, 50):
        ids, _ = codec.encode(texts[at:at + 50])
        assert [np.frombuffer(i, np.int32).tolist() for i in ids] == reference.encode(texts[at:at + 50])


def test_a_round_trip_decodes_once_and_sends_words_in_lines(reference, texts, monkeypatch):
    own, decoded, sent = sptokens.Codec(PATH, threads=2), [], []
    decode, learn = own.decode, sptokens.Codec.learn_lines
    monkeypatch.setattr(own, "decode", lambda ids: decoded.extend(map(len, ids)) or decode(ids))
    monkeypatch.setattr(sptokens.Codec, "learn_lines", lambda self, new: sent.append(len(left := learn(self, new))) or left)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    got = pa.Table.from_batches(sptokens._both(own, [batch])).to_pydict()
    wanted = reference.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got["ids"]] == wanted
    assert got["text"] == reference.decode(wanted) and all(got["parity"])
    assert decoded == [len(x) for x in wanted]
    assert sent and not any(sent)       # no word with one marker had to be sent alone
    assert max(map(len, own.words)) <= sptokens.LONG


def test_lines_that_do_not_add_up_are_sent_word_by_word():
    own = sptokens.Codec(PATH)
    assert own.learn_lines(["the", "a▁b"]) == ["the", "a▁b"] and not own.words     # three markers for two words
    own.learn(["the", "  way", ""])
    assert {w: np.frombuffer(x, np.int32).tolist() for w, x in own.words.items()} == {
        w: own.tokenizer.encode(w, add_special_tokens=False).ids or [own.marker] for w in ("the", "  way", "")}


def test_ids_of_no_text(reference):
    codec = sptokens.Codec(PATH)
    byte = next(i for i, (p, _, _) in enumerate(codec.model.pieces) if p == "<0xFF>")
    assert codec.decode([np.array([byte, 400], np.int32)]) == [codec.tokenizer.decode([byte, 400], skip_special_tokens=False)]


def test_unigram_model(tmp_path):
    """A small unigram model, written by hand: scores choose among segmentations, unknown characters fall back to bytes."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def part(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data
    pieces = [("<unk>", 0, 2)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    pieces += [("▁", -3, 1), ("▁ab", -2, 1), ("a", -3, 1), ("b", -3, 1), ("bc", -2.5, 1), ("c", -3, 1), ("abc", -4, 1)]
    data = b"".join(part(1, part(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    data += part(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + part(3, part(1, b"identity") + b"\x18\x01\x20\x00")
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = sptokens.Codec(str(path))
    assert codec.model.kind == spmodel.UNIGRAM
    texts = ["abc", "abcabc ab", "é a", "", "c b a", "a  b"]
    ids, same = codec.encode(texts)
    assert [np.frombuffer(i, np.int32).tolist() for i in ids] == library.encode(texts)
    assert all(same)


def test_counts_equal_the_library(reference, texts):
    machine, words = transducer.compiled(PATH)
    want = [len(x) for x in reference.encode(texts)]
    assert [machine.count(t, words) for t in texts] == want
    assert [machine.count(t, words, chunk=7) for t in texts[:3000]] == want[:3000]


def test_long_texts_without_spaces(reference):
    rng = random.Random(7)
    machine, words = transducer.compiled(PATH)
    han = "的一是不了在人有我他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生会自着去"
    for text in ("".join(rng.choice(han) for _ in range(1_000_000)), "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)),
                 "a" * 200_001, "ab" * 100_001, "".join(rng.choice(han) for _ in range(300_000)) + " tail " * 30_000):
        assert machine.count(text, words) == len(reference.encode(text))
    assert not any(len(w) > 64 for w in words)


def test_heads_of_chunks_depend_on_where_they_are_entered(reference):
    machine, words = transducer.compiled(PATH)
    rng = random.Random(8)
    for letters in ("a", "ab", "the", "的一a", "=-"):
        for chunk in (1, 2, 3, 5, 64):
            text = "".join(rng.choice(letters) for _ in range(500))
            assert machine.count(text, words, chunk=chunk) == len(reference.encode(text))


def test_forgetting_states_changes_nothing(reference, texts):
    machine = transducer.Transducer(spmodel.read_model(PATH), most_states=50)
    words = transducer.WordCounts(machine, most=20)
    want = [len(x) for x in reference.encode(texts[:300])]
    assert [machine.count(t, words) for t in texts[:300]] == want
    assert [machine.count(t, words, chunk=3) for t in texts[:300]] == want


def test_unequal_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    got = sptokens.decode(sptokens.encode(docs, PATH), PATH).collect()
    assert sorted((repr(r.doc_id), len(r.ids) // 4, r.text, r.parity) for r in got) == sorted(
        [("1", 0, "", True), ("2", 0, "", True), ("None", 2, "a b", True), ("3", 2, "a b", True), ("3", 2, "a b", True)])
    counts = transducer.count_tokens(docs.withColumn("n_bytes", docs.ids), PATH).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == sorted(
        [("1", 0, 0), ("2", 0, 0), ("None", 3, 2), ("3", 3, 2), ("3", 3, 2)])
    assert sptokens.encode(docs.limit(0), PATH).count() == 0 and transducer.count_tokens(docs.limit(0), PATH).count() == 0


def test_queries_on_given_table(spark, sf, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: reference.encode(t) for i, t in texts.items()}
    for r in QUERIES["op1_sentencepiece"](spark, sf).collect():
        want = np.array(ids[r.doc_id], "<i4").tobytes()
        assert (r.n_tokens, r.ids_crc32, r.decoded_crc32, r.parity) == (
            len(ids[r.doc_id]), zlib.crc32(want), zlib.crc32(reference.decode(ids[r.doc_id]).encode()), True)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, sf).collect()}
    assert got == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 4096) for i, t in texts.items()}
