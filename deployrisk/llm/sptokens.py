"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read field by field and rebuilt: its normaliser (the compiled character map, squeezed
spaces, the metaspace marker in place of spaces and before the text), a unigram model with its scores or
a BPE model whose merges follow them, and byte fallback. Merges of equal score take the leftmost place in
the original, which for runs of markers means that the left part grows first; their order here is the same.

If no piece holds a marker after another character, words are encoded apart and remembered; new ones of
a batch go to the library together, which encodes them on ``threads`` threads: two, or as many as Spark gives a
task (``spark.task.cpus``) if that is more. They are sent in lines of many words: a word has its marker in front and nowhere
else, so pieces that begin with a marker begin the words. The sentencepiece library encodes every whole text and decodes its
ids, and ``parity`` says of every row whether both libraries give the same ids and the same text.

Defined results: null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from deployrisk.llm import spmodel
from deployrisk.llm.common import slices
from deployrisk.llm.spmodel import SPACE


def merges(model: spmodel.Model) -> list[tuple[str, str]]:
    """Every pair of pieces that makes a piece: best score first, and longer left parts before shorter."""
    mergeable = {p: s for p, s, k in model.pieces if k in (spmodel.NORMAL, spmodel.USER_DEFINED)}
    found = [(-score, -cut, piece) for piece, score in mergeable.items() for cut in range(1, len(piece))
             if piece[:cut] in mergeable and piece[cut:] in mergeable]
    return [(piece[:-cut], piece[-cut:]) for _, cut, piece in sorted(found)]


def build(model: spmodel.Model) -> Tokenizer:
    """The model as a tokenizer."""
    unknown = next((p for p, _, k in model.pieces if k == spmodel.UNKNOWN), None)
    if model.kind == spmodel.UNIGRAM:
        at = next((i for i, (p, _, _) in enumerate(model.pieces) if p == unknown), None)
        engine = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=at, byte_fallback=model.byte_fallback)
    elif model.kind == spmodel.BPE:
        engine = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=unknown,
                            fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind}")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    tokenizer = Tokenizer(engine)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not model.crosses_words():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    parts = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


CHECKED = 1024  # texts compared in one call
LINE = 2048     # new words sent in one line
LONG = 64       # longer words (code points) are not remembered
SPELLED = 1 << 18   # ids spelled at once


@dataclass
class Codec:
    """One per model file and worker process."""

    path: str
    most: int = 600_000
    threads: int = 1
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.model = spmodel.read_model(self.path)
        self.by_word = self.model.dummy_prefix and not (self.model.charsmap or self.model.squeeze_spaces or self.model.crosses_words())
        spelled = [bytes([int(p[3:5], 16)]) if k == spmodel.BYTE else p.replace(SPACE, " ").encode() for p, _, k in self.model.pieces]
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(x) for x in spelled], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.marker = next((i for i, (p, _, _) in enumerate(self.model.pieces) if p == SPACE), None)
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])

    # decoding needs neither of these, so they are made when first used

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return build(self.model)

    @cached_property
    def liner(self) -> Tokenizer:
        """The same model for words that have their markers, with spaces between them."""
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        return out

    @cached_property
    def reference(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def split(self, text: str) -> list[str]:
        """The text's words, each without the one space before it (or the one put before the text)."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]

    def learn(self, new: list[str]) -> None:
        """Encode words not met before, in one call."""
        if self.by_word:
            new = self.learn_lines([w for w in new if not w.startswith(" ")]) + [w for w in new if w.startswith(" ")]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        if self.by_word and "" in new:  # a lone marker: the library puts none before an empty text
            ids[new.index("")] = [self.marker]
        for word, own in zip(new, ids, strict=True):
            self.words[word] = np.array(own, np.int32).tobytes()

    def learn_lines(self, new: list[str]) -> list[str]:
        """Encode words in lines; words of lines where the pieces with a marker are not as many as the words are given back."""
        lines, left = [new[i:i + LINE] for i in range(0, len(new), LINE)], []
        texts = [SPACE + f" {SPACE}".join(line) for line in lines]
        for line, found in zip(lines, self.liner.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int32)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(line) or cuts[0] != 0:
                left += line
                continue
            data, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            self.words.update(zip(line, map(data.__getitem__, map(slice, ends, ends[1:])), strict=True))
        return left

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Little-endian 32-bit ids of each text, and whether both libraries agree on it."""
        return self.round_trip(texts)[:2]

    def round_trip(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        """What ``encode`` gives, and the texts decoded from these ids."""
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        self.learn(new)
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        full = len(self.words) > self.most
        for word in new:  # frequent words came early and stay
            if full or len(word) > LONG:
                del self.words[word]
        ids, same = [np.frombuffer(x, np.int32) for x in out], []
        back = self.decode(ids)
        for i in range(0, len(texts), CHECKED):
            same += self.agree(texts[i:i + CHECKED], ids[i:i + CHECKED], back[i:i + CHECKED])
        return out, same, back

    def agree(self, texts: list[str], ids: list[np.ndarray], back: list[str]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each whole text, and the same text for them."""
        wanted, spelled = self.reference.encode(texts, num_threads=self.threads, return_type="numpy"), self.reference.decode(ids, num_threads=1)
        return [np.array_equal(a, b) and c == d for a, b, c, d in zip(wanted, ids, spelled, back, strict=True)]

    def spell(self, ids: np.ndarray) -> bytes:
        """The pieces' bytes, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.letters[at].tobytes()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts; ids whose bytes are no UTF-8 (never the ids of a text) go through the library's decoder chain."""
        if not ids:
            return []
        every = np.concatenate(ids)
        data = b"".join([self.spell(every[i:i + SPELLED]) for i in range(0, len(every), SPELLED)])
        ends = np.concatenate([[0], np.cumsum(self.sizes[every], dtype=np.int64)])[np.cumsum([0, *map(len, ids)])].tolist()
        out = []
        for own, start, end in zip(ids, ends, ends[1:], strict=False):
            try:
                text = data[start:end].decode()
                out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(own.tolist(), skip_special_tokens=False))
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str, threads: int) -> Codec:
    if path not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _CODECS[path] = Codec(path, threads=threads)
    return _CODECS[path]


def _threads(frame: DataFrame) -> int:
    """Two, or as many as the cluster gives a task."""
    return max(2, int(frame.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def _encoded(own: Codec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        ids, same = own.encode([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["doc_id", "ids", "parity"])


def _both(own: Codec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        ids, same, texts = own.round_trip([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(same, pa.bool_()), pa.array(texts, pa.string())],
                                         ["doc_id", "ids", "parity", "text"])


def _decoded(own: Codec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "ids", 1 << 20):
        texts = own.decode([np.frombuffer(x or b"", np.int32) for x in batch.column("ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])


_ENCODED = "doc_id long, ids binary, parity boolean"


def encode(docs: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """(doc_id, ids: little-endian 32-bit ids, parity) of every row."""
    threads = threads or _threads(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _encoded(codec(path, threads), batches), _ENCODED)


def decode(encoded: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """The rows of ``encode`` with ``text`` decoded from their ids."""
    threads = threads or _threads(encoded)
    return encoded.select("doc_id", "ids", "parity").mapInArrow(lambda batches: _decoded(codec(path, threads), batches), f"{_ENCODED}, text string")


def round_trip(docs: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """Both in the same worker, so that one copy of the model serves a task; the decoding compared is the one returned."""
    threads = threads or _threads(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _both(codec(path, threads), batches), f"{_ENCODED}, text string")
