"""Spelling variants: words one edit apart, grouped under their more frequent form, by a walk through a trie of tables.

The vocabulary and its words read backwards are two tries, kept as one table of edges. A chain of nodes that
neither branch nor end a word is one edge with a long label. A frontier of states (word, position, node, edits) is
joined with the edges of its nodes, level by level: a state follows a label that agrees with the rest of its
word, and one without an edit yet may put one, inserted, deleted or replaced, where label and word first
differ. A state with one edit that ends where a word ends has found a neighbour.

An edit lies in the second half of a word or in its first half, which is the second one backwards. So the walk starts
behind the first half, at the node that the word itself passes there, and a pair found forwards is left
out backwards. The frontier then starts among the rarer nodes instead of crossing the crowded root for every word.

Nodes are named by 64-bit hashes of their prefixes; two that fell together would share their edges, and each pair is
checked letter by letter at the end. A node through which very many words pass is written several
times, and its states are dealt over these copies. Everything is dealt by node or by word; counts are added up
in each task before they are dealt.

Defined results: null texts have no words; a null id counts as an empty one; an empty vocabulary gives no rows.
Words of any length are walked whole; the number of levels is that of the branchings along a word, not its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deployrisk.llm.common import slices, written

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
CROWD = 20_000      # words through one copy of a node


# ---- the vocabulary -----------------------------------------------------------------------------

def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, slip_every: int = 0, most: int = 200_000) -> DataFrame:
    """(word, n): runs of letters in lower case (A to Z alone) with their number of occurrences.

    ``slip_every`` takes a letter from one run in so many: those whose checksum with the document's id it divides, at
    the checksum modulo the length. Each task adds up its words in a table of about ``most`` words before they are dealt.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(pattern.findall(text or "")).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if slip_every:
                        h = zlib.crc32(word.encode(), begun)
                        if h % slip_every == 0:
                            place = h % len(word)
                            word = word[:place] + word[place + 1:]
                            if len(word) < least_letters:
                                continue
                    counts[word] += n
                if len(counts) >= most:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


# ---- the trie -----------------------------------------------------------------------------------

def _start(size: int, side: int) -> int:
    """Letters that a word of ``size`` follows before its walk, forwards (0) or backwards (1)."""
    return size // 2 if side == 0 else size - size // 2


def prefixes(words: DataFrame) -> DataFrame:
    """(side, id, depth, node, next, start): the nodes a word passes from where a word one letter shorter starts."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["side", "id", "depth", "node", "next", "start"])
            rows.clear()
            return batch

        for batch in batches:
            for own, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for side, spelled in ((0, word), (1, word[::-1])):
                    start, first = _start(len(word), side), _start(len(word) - 1, side)
                    state = xxhash.xxh3_64(f"{side}{spelled[:first]}")
                    for depth in range(first, len(word) + 1):
                        after = spelled[depth:depth + 1]
                        rows.append((side, own, depth, state.intdigest() - (1 << 63), after or None, depth == start))
                        state.update(after)
                        if len(rows) >= 50_000:
                            yield made()
        yield made()

    return words.select("id", "word").mapInArrow(spell, "side int, id string, depth int, node long, next string, start boolean")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges of each node, written once for each of its copies; the first states of all words)."""
    # long words are named by a hash, or each of their prefixes would carry all of them
    words = written(words.select("word", F.when(F.char_length("word") <= 64, F.col("word")).otherwise(F.concat(F.lit("\0"), F.sha2("word", 256))).alias("id")), "trie-words")
    passed = written(prefixes(words), "word-prefixes")
    nodes = passed.groupBy("node").agg(
        F.min("next").alias("least"), F.max("next").alias("most"), F.max(F.col("next").isNull()).alias("ends"), F.max("start").alias("starts"),
        F.count(F.lit(1)).alias("words"), F.array_join(F.collect_set("next"), "").alias("letters"))
    kept = nodes.filter("ends OR starts OR least <> most").select(
        F.col("node").alias("kept"), (F.floor(F.col("words") / CROWD) + 1).cast("int").alias("copies"), "letters")
    stops = passed.join(written(kept, "trie-nodes"), F.col("node") == F.col("kept")).select("side", "id", "depth", "node", "copies", "letters", "next", "start")
    named = written(stops.join(words.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of"), "trie-stops")
    along = Window.partitionBy("side", "id").orderBy("depth")
    spelled = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    steps = named.withColumns({"from": F.lag("node").over(along), "at": F.lag("depth").over(along), "from_copies": F.lag("copies").over(along)})
    steps = steps.filter("at is not null").select(
        "from", "from_copies", "node", "copies", "letters", F.substring(spelled, F.col("at") + 1, F.col("depth") - F.col("at")).alias("label"),
        F.when(F.col("next").isNull(), F.col("word")).alias("end"))
    # one row an edge; the word that ends there comes from the row of that word alone
    edges = steps.groupBy("from", "node").agg(
        *(F.first(c).alias(c) for c in ("label", "copies", "letters", "from_copies")), F.max("end").alias("end"))
    table = edges.select(F.col("from"), F.explode(F.sequence(F.lit(0), F.col("from_copies") - 1)).alias("edge_copy"), F.left("label", F.lit(1)).alias("letter"),
                         "label", F.col("node").alias("to"), F.col("copies").alias("to_copies"), "letters", "end")
    first = named.filter("start").select(
        "side", "word", F.col("depth").alias("position"), "node", F.pmod(F.hash("word"), F.col("copies")).alias("copy"), F.lit(0).alias("edits"))
    return written(table, "trie-edges"), written(first, "first-states")


# ---- the walk -----------------------------------------------------------------------------------

def _after(text: Column, letters: Column | int) -> Column:
    """The text without its first letters."""
    return F.substring(text, F.lit(letters) + 1 if isinstance(letters, int) else letters + 1, F.lit((1 << 31) - 1))


def _followed(states: DataFrame) -> DataFrame:
    """States without an edit behind an edge: none yet if its label agrees with ``rest``, else one where the two first differ."""
    rest, label, m = F.col("rest"), F.col("label"), F.col("m")
    size, there = F.char_length("label"), F.char_length("rest")
    # -1 where they agree; behind an equal first letter, every place that it could be is tried
    places = F.when(F.startswith(rest, label), F.array(F.lit(-1))).when(F.left(rest, F.lit(1)) != F.col("letter"), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(1), F.greatest(F.least(size - 1, there), F.lit(1))))
    differ = (F.left(rest, m) == F.left(label, m)) & (F.substring(rest, m + 1, F.lit(1)) != F.substring(label, m + 1, F.lit(1)))
    states = states.withColumn("m", F.explode(places)).filter((m <= 0) | differ)
    more = (m >= 0) & (there > m)
    ways = F.explode(F.array(
        F.when(m < 0, size * 2),
        F.when(more & F.startswith(_after(rest, m + 1), _after(label, m + 1)), size * 2 + 1),                  # a letter replaced
        F.when((m >= 0) & F.startswith(_after(rest, m), _after(label, m + 1)), size * 2 - 1),                  # one more in the label
        F.when(more & F.startswith(_after(rest, m + 1), _after(label, m)), size * 2 + 3)))                     # one more in the word
    states = states.withColumn("way", ways).filter("way is not null")
    return states.withColumns({"used": F.floor(F.col("way") / 2).cast("int"), "made": F.col("way") % 2})


def _level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further, and the word that such a state has become (``near``)."""
    spelled = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    states = frontier.withColumn("rest", _after(spelled, F.col("position")))
    edges = edges.hint("shuffle_hash")      # saves sorting the states; a share of the edges is small wherever states are many
    here = (F.col("node") == F.col("from")) & (F.col("copy") == F.col("edge_copy"))
    columns = ["side", "word", "position", "rest", "to", "to_copies", "letters", "end", "used", "made"]
    plain = _followed(states.filter("edits = 0").join(edges, here)).select(*columns)
    edited = states.filter("edits = 1").withColumn("first", F.left("rest", F.lit(1)))
    edited = edited.join(edges, here & (F.col("first") == F.col("letter")) & F.startswith("rest", "label"))
    edited = edited.withColumns({"used": F.char_length("label"), "made": F.lit(1)}).select(*columns)
    found = plain.unionByName(edited)
    left = F.char_length("rest") - F.col("used")
    half = F.floor(F.char_length("word") / 2).cast("int")
    # an edit made and nothing left, or none and the last letter is one too many
    near = (left == 1 - F.col("made")) & ((F.col("side") == 0) | (F.left("word", half) != F.left("end", half)))
    # a letter that no edge begins with leads nowhere once an edit is made
    goes_on = F.when(F.col("made") == 0, F.col("letters") != "").otherwise(
        (left > 0) & F.contains("letters", F.substring("rest", F.col("used") + 1, F.lit(1))))
    return found.select(
        "side", "word", (F.col("position") + F.col("used")).alias("position"), F.when(goes_on, F.col("to")).alias("node"),
        F.pmod(F.hash("word"), F.col("to_copies")).alias("copy"), F.col("made").alias("edits"), F.when(near, F.col("end")).alias("near")
    ).filter("node is not null or near is not null")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words of the table that are one edit apart, each once.

    Words of fewer than three letters take no part: halves of two words an edit apart could both be empty.
    """
    edges, frontier = trie(words.select("word").filter(F.char_length("word") >= 3).distinct())
    every = words.select("word", F.col("word").alias("near")).limit(0)
    while not frontier.isEmpty():
        found = written(_level(frontier, edges), "trie-level")
        every = every.unionByName(found.filter("near is not null").select("word", "near"))
        frontier = found.filter("node is not null").drop("near")
    return every.filter(F.levenshtein("word", "near", 1) == 1)


# ---- forms --------------------------------------------------------------------------------------

def forms(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) with distinct words.

    A word's form is its near word of largest n (ties: the first in code-point order), if that is at least ``times`` its own;
    forms are followed to the last, the root.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = written(neighbours(words), "near-words")
    sized = pairs.join(words.select(F.col("word").alias("of"), F.col("n").alias("near_n")), F.col("near") == F.col("of"))
    best = sized.groupBy(F.col("word").alias("w")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))
    joined = words.join(best, words.word == best.w, "left")
    more = -F.col("best.less") >= times * F.col("n")
    named = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(more, F.col("best.word")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n")), "forms")
    # follow forms twice as far each time; n grows fivefold at each form, so few turns are needed
    roots = named.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        jumped = written(roots.join(onward, roots.root == onward.at, "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    last = roots.select(F.col("word").alias("of"), "root")
    return named.join(last, named.word == last.of, "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
