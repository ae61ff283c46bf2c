"""Quality rules learned as a decision list.

Statistics of each text are Spark expressions over its words and lines. A bounded sample of labelled
documents that pass the base rule is reduced to counts of statistics in bins, and sequential covering on these
counts grows rules against poor documents: conditions ``statistic > threshold`` or ``<= threshold`` are added while
they gain information on two thirds of the sample, and cut back from the end to what separates best on the last
third. Each third takes its turn as the last one, so that few labels are enough.

A rule is judged on the third that it was not grown on. It stands unless a binomial test (level ``doubt``, 0.05)
finds its share of poor documents below ``precision`` (0.98), and if another one (0.01) finds that share above that
of all documents there; both allow for the number of rows. If no beginning of it stands, it is grown anew
from another statistic. Of the rules that stand the one of the highest lower bound of precision is taken, covered rows
leave, and the next one is grown, up to ``most_rules`` (8). The list becomes one conditional expression that
Spark evaluates on every document. Thresholds lie halfway between values met.

The sample has about ``sample_rows`` (20,000) labelled documents, chosen by a hash of their ids; everything else
covers all rows.

Defined results: null and blank texts have no words and fail the base rule; without labels of both kinds
the list is empty and the base rule decides alone; of several labels of an id the highest counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import SPACE, WORD, settled, written

#: Statistics that rules may use, as expressions over the columns of ``statistics``.
FEATURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "equal_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}
BINS = 32
THIRDS = 3


def _only(text: Column, kept: str) -> Column:
    """How many characters of a class a text has."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """The rows with their statistics, all long: see FEATURES and the base rule."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.columns
    name = {c: f"__{c}" for c in ("words", "lines", "hashes", "bits", "packed", "near", "starts")}
    rows = docs.withColumns({
        name["words"]: F.array_remove(F.split(text, SPACE), ""),
        name["lines"]: F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
        "n_symbols": _only(text, "#*$%&|<>"),
        "n_capitals": _only(text, r"\p{Lu}"),
        "n_marks": _only(text, "!?"),
        "n_digits": _only(text, "0-9"),
    })
    words, lines = F.col(name["words"]), F.col(name["lines"])
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        name["hashes"]: F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))),
        name["bits"]: F.char_length(F.bin(F.size(words))),
    }).drop(name["words"], name["lines"])
    # equal windows: hashes sorted with their places in the low bits, then neighbours compared by whole hashes
    hashes, bits, packed, near, starts = (F.col(name[c]) for c in ("hashes", "bits", "packed", "near", "starts"))
    shift = lambda x: F.call_function("shiftright", x, bits)
    rows = rows.withColumn(name["packed"], F.sort_array(F.transform(
        hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    alike = F.filter(packed, lambda x, i: (shift(x) == shift(F.get(packed, i - 1))) | (shift(x) == shift(F.get(packed, i + 1))))
    rows = rows.withColumn(name["near"], F.sort_array(F.transform(alike, lambda x: F.struct(
        F.get(hashes, x.bitwiseAND(mask).cast("int")).alias("h"), x.bitwiseAND(mask).alias("p"))))).drop(name["packed"], name["hashes"])
    equal = F.filter(near, lambda x, i: (x.h == F.get(near, i - 1).h) | (x.h == F.get(near, i + 1).h))
    rows = rows.withColumn(name["starts"], F.sort_array(F.transform(equal, lambda x: x.p))).drop(name["near"], name["bits"])
    gained = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(3).cast("long"), p - F.get(starts, i - 1)), F.lit(3).cast("long")))
    rows = rows.withColumn("n_repeat_words", F.aggregate(gained, F.lit(0).cast("long"), lambda a, b: a + b)).drop(name["starts"])
    found = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_digits"]
    return settled(rows, [c for c in own if c not in found], found)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


# ---- learning -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


Rule = list[Condition]
#: A group of equal rows: bin of each feature, poor and good documents.
Group = tuple[tuple[int, ...], int, int]


def _covered(groups: list[Group], tests: list[tuple[int, bool, int]]) -> list[Group]:
    """tests: (feature, above, cut): the bin is over the cut, or at most the cut."""
    return [g for g in groups if all((g[0][f] > cut) == above for f, above, cut in tests)]


def _totals(groups: list[Group]) -> tuple[int, int]:
    return sum(g[1] for g in groups), sum(g[2] for g in groups)


def grow(groups: list[Group], features: int, passed: frozenset[int] = frozenset()) -> list[tuple[int, bool, int]]:
    """Add the condition of highest information gain until no good document is covered or nothing is gained.

    The first condition is on none of the ``passed`` features.
    """
    tests: list[tuple[int, bool, int]] = []
    poor, good = _totals(groups)
    while poor and good:
        best, chosen = 1e-9, None
        before = math.log2(poor / (poor + good))
        for f in range(features):
            if not tests and f in passed:
                continue
            by_bin = [[0, 0] for _ in range(BINS + 1)]
            for bins, p, g in groups:
                by_bin[bins[f]][0] += p
                by_bin[bins[f]][1] += g
            p = g = 0
            for cut in range(BINS):
                p, g = p + by_bin[cut][0], g + by_bin[cut][1]
                for above, a, b in ((False, p, g), (True, poor - p, good - g)):
                    gain = a * (math.log2(a / (a + b)) - before) if a else 0
                    if gain > best:
                        best, chosen = gain, (f, above, cut)
        if chosen is None:
            break
        tests.append(chosen)
        groups = _covered(groups, [chosen])
        poor, good = _totals(groups)
    return tests


def _at_least(hits: int, rows: int, share: float) -> float:
    """Chance of so many hits or more among so many rows."""
    if hits <= 0:
        return 1.0
    if not 0 < share < 1:
        return float(share >= 1)
    log = math.lgamma(rows + 1)
    terms = (math.exp(log - math.lgamma(k + 1) - math.lgamma(rows - k + 1) + k * math.log(share) + (rows - k) * math.log1p(-share)) for k in range(hits, rows + 1))
    return min(1.0, math.fsum(terms))


def _lower_bound(hits: int, rows: int, z: float = 1.64) -> float:
    """Wilson's lower bound of a share."""
    share = hits / rows
    return (share + z * z / (2 * rows) - z * math.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


def stands(poor: int, good: int, share: float, precision: float, doubt: float) -> bool:
    """Whether a rule that covers so many may be used, where ``share`` of all documents are poor."""
    return poor > 0 and 1 - _at_least(poor + 1, poor + good, precision) >= doubt and _at_least(poor, poor + good, share) <= 0.01


def candidate(growing: list[Group], pruning: list[Group], features: int, precision: float, doubt: float) -> tuple[float, list[tuple[int, bool, int]]] | None:
    """The lower bound of precision and the conditions of a rule that stands on rows it was not grown on."""
    poor, good = _totals(pruning)
    if not poor or not good:
        return None
    share, passed = poor / (poor + good), frozenset()
    while tests := grow(growing, features, passed):
        found = []
        for size in range(1, len(tests) + 1):
            p, g = _totals(_covered(pruning, tests[:size]))
            if stands(p, g, share, precision, doubt):
                found.append((_lower_bound(p, p + g), -size))
        if found:
            bound, size = max(found)
            return bound, tests[:-size]
        passed |= {tests[0][0]}
    return None


def cover(parts: list[list[Group]], features: int, most_rules: int, precision: float, doubt: float) -> list[list[tuple[int, bool, int]]]:
    """Rules against poor documents, in order."""
    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < most_rules:
        found = [candidate([g for j, other in enumerate(parts) if j != i for g in other], part, features, precision, doubt) for i, part in enumerate(parts)]
        found = [f for f in found if f]
        if not found:
            break
        tests = max(found, key=lambda f: (f[0], -len(f[1])))[1]
        rules.append(tests)
        parts = [[g for g in part if not _covered([g], tests)] for part in parts]
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_rules: int = 8, precision: float = 0.98, doubt: float = 0.05) -> list[Rule]:
    """The decision list; ``sample_rows`` bounds what is looked at and brought to the driver."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    there = labels.count()
    part = 1 << 30
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(part)) < int(part * min(1.0, sample_rows / max(1, there))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = statistics(texts.join(F.broadcast(written(chosen, "label-sample")), F.col("doc_id") == F.col("id"))).filter(~base_failed())
    values = written(sample.select("quality", F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(THIRDS)).cast("int").alias("part"),
                                   *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items())), "label-statistics")
    steps = [i / (4 * BINS) for i in range(4 * BINS + 1)]
    met = values.agg(*(F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: _halfway(met[f] or []) for f in FEATURES}
    bins = [_bin(f, cuts[f]).alias(f) for f in FEATURES]
    counts = values.groupBy("part", *bins).agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") != 0).alias("good"))
    parts: list[list[Group]] = [[] for _ in range(THIRDS)]
    for r in counts.collect():  # at most as many rows as the sample has
        parts[r["part"]].append((tuple(r[f] for f in FEATURES), r["poor"], r["good"]))
    names = list(FEATURES)
    for own in parts:
        own.sort()
    rules = cover(parts, len(names), most_rules, precision, doubt)
    return [[Condition(names[f], above, cuts[names[f]][cut]) for f, above, cut in tests] for tests in rules
            if all(cut < len(cuts[names[f]]) for f, _, cut in tests)]


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the thresholds a value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < F.col(feature)))


def _halfway(values: list[float]) -> list[float]:
    """At most BINS thresholds between the values met: the widest gaps, of those evenly spread ranks."""
    values = sorted(set(values))
    gaps = sorted(((b - a, (a + b) / 2) for a, b in zip(values, values[1:], strict=False)), reverse=True)
    return sorted(middle for _, middle in gaps[:BINS])


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects; rules are tried in order."""
    kept = F.when(base_failed(), F.lit(False))
    for rule in rules:
        whole = rule[0].column()
        for condition in rule[1:]:
            whole = whole & condition.column()
        kept = kept.when(whole, F.lit(False))
    return kept.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """The rows with statistics, ``base_failed`` and ``kept``."""
    rules = learn(docs, labels, **parameters)
    return statistics(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})
