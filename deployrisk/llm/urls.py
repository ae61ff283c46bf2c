"""URL filters: rules for hosts and paths, and a list of blocked addresses.

The longest rule that fits decides. Every other address is blocked if its canonical form is on the list. The
listed forms are hashed into a blocked Bloom filter: a form sets one bit in each of the eight 64-bit words of
one block, so a lookup reads a single row. The filter is a table of blocks, built by OR within each task and
then by block, and grows with the list; whether it is broadcast is left to Spark's size check. Only the few
addresses that it lets through are joined with the list itself, by hash and text, which removes the false ones.

Canonical form: no scheme, user, default port, fragment, leading ``www.``, trailing slashes, index page or
tracking parameters; the host in lower case and the remaining parameters in order.

Defined results: the host of an address is what lies between the first ``://`` and the next ``/``, ``?``, ``#``
or its end, with A to Z in lower case, the path what follows up to ``?``, ``#`` or the end. Null addresses and
those without ``://`` have an empty host and path and no canonical form: no rule fits, nor does the list, and they are
allowed. An empty list blocks nothing. Every row is returned, repeated ones too; further columns stay, except
those named like a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import written

WORDS = 8           # 64-bit words in a block, one bit of each is set by a key
KEYS_PER_BLOCK = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(utm_.*|ref|fbclid|gclid)(=.*)?"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(:80|:443)?\z", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?\z", "/"), r"/+\z", "")
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    asked = F.array_join(F.sort_array(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(f"(?s)^{TRACKING}\\z"))), "&")
    whole = F.concat(F.regexp_replace(host, r"^www\.", ""), F.lit("/"), F.regexp_replace(path, r"^/+", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(host != "", whole)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(key, blocks)


def _bit(key: Column, word: int) -> Column:
    """The key's bit in a word of its block, by a hash apart from the one that chose the block."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(word // 4)), 6 * (word % 4)).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the 64-bit ``key`` column; empty blocks have no row."""
    return keys.groupBy(_block(F.col("key"), F.lit(blocks)).alias("block")).agg(*(F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)))


def listed(urls: DataFrame) -> DataFrame:
    """(key, form): the distinct canonical forms of a ``url`` column."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    forms = urls.select(canonical(F.col("url"), host, path).alias("form")).filter("form is not null").distinct()
    return forms.select(F.xxhash64("form").alias("key"), "form")


def possible(rows: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """The rows and ``__possible``: whether the filter of ``keys`` holds the row's ``__key``; never false for one it was built from."""
    table = bloom(keys, blocks)
    names = ["__block", *(f"__w{i}" for i in range(WORDS))]
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(_bit(F.col("__key"), i)) != 0)
    asked = rows.withColumn("__at", _block(F.col("__key"), F.lit(blocks)))
    joined = asked.join(table.toDF(*names), F.col("__at") == F.col("__block"), "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("__possible"))


def judge(pages: DataFrame, blocked: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with host, path, rule and verdict.

    ``blocked`` has a ``url`` column; ``rules`` is a short list that becomes one conditional expression.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col("url").cast("string")
    rows = pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = (F if rule is None else rule).when(fits, F.lit(r.name))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(r.verdict))
    form = canonical(url, F.col("host"), F.col("path"))
    rows = rows.withColumns({
        "rule": F.lit(None).cast("string") if rule is None else rule,
        "verdict": F.lit(None).cast("string") if verdict is None else verdict}).withColumn("__form", F.when(F.col("rule").isNull(), form))
    rows = rows.withColumn("__key", F.xxhash64("__form"))

    list_ = written(listed(blocked), "listed-urls")
    blocks = max(1, -(-list_.count() // KEYS_PER_BLOCK))
    found = written(possible(rows, list_, blocks), "possible-urls")
    through = F.col("__possible") & F.col("__form").isNotNull()
    exact = list_.select(F.col("key").alias("__listed_key"), F.col("form").alias("__listed"))
    hits = found.filter(through).join(exact, (F.col("__key") == F.col("__listed_key")) & (F.col("__form") == F.col("__listed")), "left")
    hits = hits.withColumn("verdict", F.when(F.col("__listed").isNotNull(), "block").otherwise("allow"))
    others = found.filter(~through).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    shown = [*own, "host", "path", "rule", "verdict"]
    return hits.select(*shown).unionByName(others.select(*shown))


def with_host_label(pages: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Addresses with one of the labels in their host, as a list to block."""
    parts = F.split(host_of(F.col("url").cast("string")), r"\.")
    return pages.select("url").filter(F.arrays_overlap(parts, F.array(*map(F.lit, labels))))
