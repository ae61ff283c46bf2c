"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Four kinds need no context: e-mail addresses, IP addresses (parts up to 255), card numbers (12 to 19 digits
passing Luhn's test) and phone numbers (9 to 15 digits). Further kinds are scored: bank accounts by their
mod-97 check, access keys, and hex secrets and social security numbers, which count only near a word that
names them. All of it is array expressions inside the row.

Patterns start where a run of their characters starts or where the last match ended, and their loops keep
what they took, so that long runs cost no more than their length. As an account number may be followed by words
that look like more of it, every end that it can have is tested. Places count code points, ends exclusive;
they follow from the lengths of the matches and of what lies between them, added up in blocks.

Defined results: null texts have no spans and stay null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import settled

BLOCK = 256
#: Characters before a span in which words count, and the score that a span needs.
NEAR, ENOUGH = 32, 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str
    pattern: str
    base: bool = False
    score: float = 1.0
    words: str = ""
    gain: float = 0.0
    #: The pattern matches only the head; its group, ahead of the match, holds all that can follow.
    ahead: bool = False


KINDS = [
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", base=True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", base=True),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?+[0-9])++", base=True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", base=True),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))", score=0.5, words="iban|account|konto|compte|cuenta", gain=0.2, ahead=True),
    Kind("key", "AKIA", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", score=0.9),
    Kind("secret", "[0-9a-f]{32}", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])", score=0.3, words="token|secret|api.?key|passw", gain=0.4),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", score=0.3, words="ssn|social security", gain=0.4),
]
BASE = [k.name for k in KINDS if k.base]
#: Characters of an account number by its country.
LENGTHS = {code: int(n) for n, codes in {
    "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE",
    "31": "MT SC", "32": "LC", "33": "RU"}.items() for code in codes.split()}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less nine if over nine; the sum ends in zero."""
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.char_length(back)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(account: Column) -> Column:
    """The first four characters moved to the end, letters as two digits; the remainder by 97 is one."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.char_length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)) == 1


def account(head: Column, rest: Column) -> Column:
    """The account number that starts with the head, or null.

    It can end with any word of the rest. Of the ends that mod-97 confirms, the one at the length of the head's
    country is taken, or else the last.
    """
    words = F.split(rest, " ")
    ends = F.transform(words, lambda _, i: F.concat(head, F.array_join(F.slice(words, F.lit(1), i + 1), " ")))
    good = F.filter(ends, lambda e: e.rlike(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}$") & mod97(e))
    length = F.create_map(*(F.lit(x) for pair in LENGTHS.items() for x in pair))[F.substring(head, 1, 2)]
    return F.coalesce(F.get(F.filter(good, lambda e: F.char_length(F.replace(e, F.lit(" "), F.lit(""))) == length), F.lit(0)), F.get(good, F.size(good) - 1))


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(match)
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    if kind == "iban":
        return match.isNotNull()  # account() has tested it
    return F.lit(True)


def find(docs: DataFrame) -> DataFrame:
    """The rows with ``spans``: (start, rank, end, kind, score), by start and kind."""
    own = [c for c in docs.columns if c != "spans"]
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    col = lambda part, kind: F.col(f"__{part}_{kind.name}")
    rows = docs.withColumns({f"__match_{k.name}": F.when(text.rlike(k.guard), F.regexp_extract_all(text, F.lit(k.pattern), 0)).otherwise(none) for k in KINDS})
    rows = rows.withColumns({f"__rest_{k.name}": F.when(F.size(col("match", k)) > 0, F.regexp_extract_all(text, F.lit(k.pattern), 1)).otherwise(none) for k in KINDS if k.ahead})
    # what lies before each match, and up to its end
    rows = rows.withColumns({f"__step_{k.name}": F.when(F.size(col("match", k)) > 0, F.zip_with(
        F.slice(F.split(text, k.pattern), 1, F.size(col("match", k))), col("match", k), lambda gap, m: F.char_length(gap) + F.char_length(m)))
        .otherwise(F.array().cast("array<int>")) for k in KINDS})
    zero = F.lit(0)
    total = lambda numbers: F.aggregate(numbers, zero, lambda a, b: a + b)
    blocks = lambda steps: F.sequence(zero, F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    rows = rows.withColumns({f"__sum_{k.name}": _block_sums(col("step", k), blocks, total) for k in KINDS})
    rows = rows.withColumns({f"__end_{k.name}": _ends(col("step", k), col("sum", k), total) for k in KINDS})
    rows = rows.withColumns({f"__span_{k.name}": _spans(k, rank, _placed(col("match", k), col("end", k), col("rest", k) if k.ahead else None), text) for rank, k in enumerate(KINDS)})
    spans = F.sort_array(F.flatten(F.array(*(col("span", k) for k in KINDS)))).alias("spans")
    return settled(rows.select(*own, spans), own, ["spans"])


def _block_sums(steps: Column, blocks, total) -> Column:
    sums = F.transform(blocks(steps), lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(steps) > 0, sums).otherwise(F.array().cast("array<int>"))


def _ends(steps: Column, sums: Column, total) -> Column:
    """Running totals of the steps: whole blocks before, then the steps of the own block."""
    before = F.transform(sums, lambda s, b: total(F.slice(sums, F.lit(1), b)))
    inside = lambda i: total(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
    # pairs (block, steps before it) are few; the steps of one block are at most BLOCK
    return F.flatten(F.transform(before, lambda base, b: F.transform(
        F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), lambda _, i: base + inside(b * BLOCK + i))))


def _placed(matches: Column, ends: Column, rests: Column | None) -> Column:
    """(m, start, end) of each match, or of the account number that it is the head of."""
    placed = F.zip_with(matches, ends, lambda m, e: F.struct(m.alias("m"), (e - F.char_length(m)).alias("start"), e.alias("end")))
    if rests is None:
        return placed
    whole = F.zip_with(placed, rests, lambda p, r: F.struct(account(p.m, r).alias("m"), p.start.alias("start")))
    return F.transform(whole, lambda p: F.struct(p.m.alias("m"), p.start.alias("start"), (p.start + F.char_length(p.m)).alias("end")))


def _spans(kind: Kind, rank: int, placed: Column, text: Column) -> Column:
    good = F.filter(placed, lambda p: confirmed(kind.name, p.m))

    def scored(p: Column) -> Column:
        score = F.lit(kind.score)
        if kind.name == "iban":
            score = score + 0.3  # its checksum holds
        if kind.words:
            before = F.lower(F.substring(text, F.greatest(F.lit(1), p.start - NEAR + 1), F.least(F.lit(NEAR), p.start)))
            score = score + F.when(before.rlike(kind.words), kind.gain).otherwise(0.0)
        return F.struct(p.start.alias("start"), F.lit(rank).alias("rank"), p.end.alias("end"), F.lit(kind.name).alias("kind"), score.cast("double").alias("score"))

    found = F.transform(good, scored)
    return found if kind.base else F.filter(found, lambda s: s.score >= ENOUGH)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _reach(ends: Column) -> Column:
    """For each place the largest end before it, 0 at first: whole blocks before, then the own block up to there."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int"))
    tops = F.transform(blocks, lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.transform(tops, lambda _, b: F.coalesce(F.array_max(F.slice(tops, F.lit(1), b)), F.lit(0)))
    inside = lambda b, i: F.array_max(F.slice(ends, b * BLOCK + 1, i))
    reach = F.flatten(F.transform(before, lambda base, b: F.transform(
        F.slice(ends, b * BLOCK + 1, F.lit(BLOCK)), lambda _, i: F.greatest(base, inside(b, i)))))
    return F.when(F.size(ends) > 0, reach).otherwise(F.array().cast("array<int>"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with each union of overlapping spans replaced by the kind of its first span in brackets."""
    own = docs.columns
    rows = find(docs).withColumn("__ends", F.transform("spans", lambda s: s.end))
    rows = rows.withColumn("__reach", _reach(F.col("__ends")))
    # a union starts where no earlier span reaches past, and ends where the spans before the next one reach
    firsts = F.filter(F.zip_with("spans", "__reach", lambda s, r: F.struct(s.start.alias("start"), s.kind.alias("kind"), r.alias("before"))), lambda s: s.before <= s.start)
    rows = rows.withColumn("__firsts", firsts)
    firsts, last, text = F.col("__firsts"), F.array_max("__ends"), F.col("text").cast("string")
    parts = F.transform(firsts, lambda s: F.concat(F.substring(text, s.before + 1, s.start - s.before), F.lit("["), F.upper(s.kind), F.lit("]")))
    tail = F.substring(text, last + 1, F.char_length(text))
    made = rows.withColumn("text", F.when(F.size(firsts) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text")))
    return settled(made, [c for c in own if c != "text"], ["text"]).select(*own)
