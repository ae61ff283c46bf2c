"""Token counts by a finite-state tokenizer.

A SentencePiece BPE model is compiled into a deterministic transducer over characters whose transitions
carry the number of tokens that the prefix's encoding gains. In such a model a sequence of pieces is the
encoding of its text exactly if every piece encodes to itself and every two neighbours stay apart when
encoded together. So the last piece of each prefix follows from the last pieces of shorter prefixes, as
far back as a piece can still grow, and these make up the state: for each such start, the place in the
trie of pieces, the last piece before it, and the token count there relative to here. States are made
when first reached, and forgotten together when there are too many.

Where a space follows another character no piece goes on, so the state is the same whatever came before.
A chunk of text is then a map of states: a head that still depends on the state it is entered in, a count,
and the state it leaves. A head is read from the start state; entered in another state, it is read again only until
both ways meet. So maps compose in a few steps, also in long texts without spaces: chunks are counted
independently and combined pairwise, as in a prefix scan. Whole words are remembered with their counts.

Defined results: null and empty texts have no tokens. Models need BPE pieces and no normalisation tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deployrisk.llm import spmodel
from deployrisk.llm.common import slices


class State(dict):
    """Transitions by character: (next state, tokens gained); missing ones are compiled when asked for."""

    __slots__ = ("active", "machine")

    def __init__(self, machine: Transducer, active: tuple) -> None:
        self.machine, self.active = machine, active

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.step(self.active, char)
        return found


@dataclass(frozen=True)
class StateMap:
    """What a piece of text does to a state.

    ``head`` (in chunks) still depends on the state it is entered in: from the start state it gains ``gained`` tokens and is
    left in ``left``. If the text has a ``tail``, that gains ``count`` more and is left in ``exit``, whatever came before.
    """

    head: tuple[str, ...]
    gained: int
    left: State
    tail: bool = False
    count: int = 0
    exit: State | None = None

    def entered(self, state: State, start: State) -> tuple[int, State]:
        """Tokens gained in the head from ``state``, and where that leads.

        Both ways of reading the head are followed only until they meet, mostly within a few characters.
        """
        other, more = start, 0
        for char in chain.from_iterable(self.head):
            if state is other or state.active == other.active:
                return self.gained + more, self.left
            state, a = state[char]
            other, b = other[char]
            more += a - b
        return self.gained + more, state

    def then(self, other: StateMap, start: State) -> StateMap:
        gained, state = other.entered(self.exit if self.tail else self.left, start)
        if self.tail:
            return StateMap(self.head, self.gained, self.left, True, self.count + gained + other.count, other.exit if other.tail else state)
        return StateMap(self.head + other.head, self.gained + gained, state, other.tail, other.count, other.exit)


def run(state: State, text: str) -> tuple[int, State]:
    count = 0
    for char in text:
        state, gained = state[char]
        count += gained
    return count, state


def composed(maps: list[StateMap], start: State) -> StateMap:
    """All maps in order, by halves: the rising half of a prefix scan, as only its last element is wanted."""
    while len(maps) > 1:
        maps = [a.then(b, start) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1:]
    return maps[0]


class Transducer:
    def __init__(self, model: spmodel.Model, most_states: int = 1_000_000) -> None:
        if model.kind != spmodel.BPE or model.charsmap or model.crosses_words():
            raise ValueError("a BPE model without normalisation tables and without pieces across words is needed")
        self.model, self.most_states = model, most_states
        self.scores = {p.replace(spmodel.SPACE, " "): s for p, s, k in model.pieces if k in (spmodel.NORMAL, spmodel.USER_DEFINED)}
        self.trie: dict = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        for piece in self.scores:
            if len(piece) == 1 or self.encode(piece) == [piece]:
                node = self.trie
                for char in piece:
                    node = node.setdefault(char, {})
                node[""] = piece
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state((("", "", 0),))

    def encode(self, text: str) -> list[str]:
        """Plain encoding of a short text: merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are next to each other; "" stands for the start and unknown characters."""
        if not left:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.most_states:
                self.pairs.clear()
            found = self.pairs[left, right] = self.encode(left + right) == [left, right]
        return found

    def state(self, active: tuple) -> State:
        found = self.states.get(active)
        if found is None:
            found = self.states[active] = State(self, active)
        return found

    def node(self, prefix: str) -> dict:
        node = self.trie
        for char in prefix:
            node = node[char]
        return node

    def step(self, active: tuple, char: str) -> tuple[State, int]:
        """active: (prefix of a piece read since a start, last piece before the start, count there less the count here)."""
        if char not in self.trie:  # spelled in bytes, or one unknown piece
            return self.state((("", "", 0),)), len(char.encode()) if self.model.byte_fallback else 1
        last, gained, grown = None, 0, []
        for prefix, before, count in active:
            node = self.node(prefix).get(char)
            if node is None:
                continue
            piece = node.get("")
            if last is None and piece is not None and self.apart(before, piece):
                last, gained = piece, count + 1
            if len(node) > (piece is not None):
                grown.append((prefix + char, before, count))
        if last is None:
            raise AssertionError(f"no piece ends after {active!r} {char!r}")
        return self.state((*((p, b, c - gained) for p, b, c in grown), ("", last, 0))), gained

    def chunk_map(self, chunk: str, words: WordCounts) -> StateMap:
        """The map of a chunk; ``words`` has the counts of whole words behind one space."""
        edge = re.search("[^ ] ", chunk)
        if edge is None:
            return StateMap((chunk,), *run(self.start, chunk))
        head, tail = chunk[:edge.start() + 1], chunk[edge.start() + 1:]
        *whole, last = re.findall(" +[^ ]*", tail)
        count, state = run(self.start, last)
        return StateMap((head,), *run(self.start, head), True, count + sum(words[w[1:]] for w in whole), state)

    def count(self, text: str, words: WordCounts, chunk: int = 1 << 16) -> int:
        text = text.replace(spmodel.SPACE, " ")
        if self.model.squeeze_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return 0
        if self.model.dummy_prefix:
            text = " " + text
        if len(self.states) > self.most_states:
            self.reset()
        if len(text) <= chunk and text[0] == " ":
            if "  " not in text:
                return sum(map(words.__getitem__, text[1:].split(" ")))
            return sum(words[w[1:]] for w in re.findall(" +[^ ]*", text))
        maps = []
        for i in range(0, len(text), chunk):
            if len(self.states) > self.most_states:
                self.reset()
            maps.append(self.chunk_map(text[i:i + chunk], words))
        whole = composed(maps, self.start)
        return whole.gained + whole.count


class WordCounts(dict):
    """Tokens of a word with a space before it; up to ``most`` words are remembered."""

    def __init__(self, machine: Transducer, most: int = 1_000_000) -> None:
        self.machine, self.most = machine, most

    def __missing__(self, word: str) -> int:
        count, _ = run(self.machine.start, " " + word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = count
        return count


_COMPILED: dict[str, tuple[Transducer, WordCounts]] = {}


def compiled(path: str) -> tuple[Transducer, WordCounts]:
    """One machine for each model file in a worker process."""
    if path not in _COMPILED:
        machine = Transducer(spmodel.read_model(path))
        _COMPILED[path] = machine, WordCounts(machine)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = compiled(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            counts = [machine.count(t, words) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
