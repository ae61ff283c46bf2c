"""JUnit test reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deployrisk.functions.scalars import number
from deployrisk.functions.text import strip

# report locations and directories to leave out (fixed values)
GLOBS = [
    "**/junit*.xml",
    "**/TEST-*.xml",
    "**/test-results/**/*.xml",
    "**/surefire-reports/*.xml",
    "**/reports/**/*.xml",
    "**/*junit*.xml",
    "**/test-report*.xml",
    "**/pytest.xml",
]
SKIPPED = ["node_modules", ".venv", "venv", ".git", "site-packages",
           ".tox", "dist", "build/tmp", ".mypy_cache", ".pytest_cache"]


def glob_pattern(globs: Sequence[str] = GLOBS) -> str:
    """One regular expression for paths below a root."""
    out = []
    for g in globs:
        part = "".join("\\" + c if c in ".+()[]{}^$|" else c for c in g)
        part = part.replace("**/", "\0").replace("*", "[^/]*").replace("\0", "(?:[^/]+/)*")
        out.append(part)
    return "^(?:" + "|".join(out) + ")$"


def discover(spark: SparkSession, root: str, build: Column, globs: Sequence[str] = GLOBS,
             max_files: int | None = None) -> DataFrame:
    """Report files below ``root``: build, path, modification time and text.

    ``build`` reads the build's name from ``path``. All files are taken in one pass; a
    number in ``max_files`` keeps a build's newest ones, ranked on listings alone.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.xml").load(root))
    below = F.regexp_replace("path", "^.*?" + root.split(":")[-1].rstrip("/").replace(".", "\\.") + "/", "")
    kept = found.withColumn("_below", below).filter(F.col("_below").rlike(glob_pattern(globs)))
    for word in SKIPPED:
        kept = kept.filter(~F.col("_below").contains(word))
    if max_files is None:
        return kept.select(build.alias("build"), "path", "modificationTime", F.col("content").cast("string").alias("xml"))
    listing = kept.select(build.alias("build"), "path", "modificationTime")
    newest = Window.partitionBy("build").orderBy(F.col("modificationTime").desc(), "path")
    chosen = listing.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= max_files).drop("_r")
    return chosen.join(found.select("path", F.col("content").cast("string").alias("xml")), "path")


#: Attributes read from a suite's tag; of the last three the first that holds a number counts.
COUNTS = {"tests": ["tests"], "failures": ["failures"], "errors": ["errors"], "skipped": ["skipped", "skip", "disabled"]}
ATTRIBUTE = r"\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')"
# suites only, up to the ">" that is not inside quotes
SUITE = r"<((?:[\w.-]+:)?(?i:testsuites?)(?:" + ATTRIBUTE + r")*)\s*/?>"


def _resolved(tag: Column) -> Column:
    """A tag whose references to digits and points are resolved; only quoted values hold references."""
    forms = [(form.format(ord(digit)), digit) for digit in "0123456789." for form in ("&#{};", "&#x{:x};", "&#X{:x};")]
    listed = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(digit).alias("digit")) for form, digit in forms])
    out = F.aggregate(listed, F.regexp_replace(tag, "&#([xX]?)0+(?=[0-9a-fA-F])", "&#$1"), lambda a, r: F.replace(a, r["form"], r["digit"]))
    return F.when(tag.contains("&#"), out).otherwise(tag)


def _kind(tag: Column) -> Column:
    """A suite's name in small letters, without its prefix."""
    plain = F.when(F.lower(F.substring(tag, 1, 10)) == "testsuites", "testsuites").otherwise("testsuite")
    return F.when(tag.contains(":"), F.lower(F.regexp_extract(tag, r"^(?:[\w.-]+:)?([\w.-]+)", 1))).otherwise(plain)


def _attribute(tag: Column, name: str) -> Column:
    """The trimmed value of an attribute, or null. Values before it are passed as a whole, as they may look like attributes."""
    found = F.regexp_extract(tag, rf"^[\w:.-]+(?:{ATTRIBUTE})*?\s+{name}\s*=\s*([\"'])((?s:.*?))\1", 2)
    return F.when(tag.contains(name), strip(found))


def _count(values: Callable[[str], Column], names: Sequence[str]) -> Column:
    return F.coalesce(*[number(values(n)).try_cast("int") for n in names], F.lit(0))


def suite_counts(df: DataFrame, xml: str) -> DataFrame:
    """tests, failures, errors, skipped per report; null when it cannot be read.

    A wrapper's own totals win when it has any tests, else all suites below it are summed.
    ``from_xml`` only decides whether the text is well formed: malformed reports give
    nulls instead of failing the job. The root's tag is read first; the other tags are looked for
    only below a wrapper without totals. Every step is a column of its own, or it would be
    computed anew by each expression that uses it.
    """
    raw = F.col(xml)
    cleaned = F.regexp_replace(raw, r"(?s)<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|!DOCTYPE[^>]*>)", "")
    rows = df.withColumn("_text", F.when(raw.contains("<!") | raw.contains("<?"), cleaned).otherwise(raw))
    # PERMISSIVE keeps the job alive; the corrupt-record field is filled for broken text
    checked = F.from_xml(raw, "struct<_corrupt_record:string,_any:string>",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    text = F.col("_text")
    # most often the root's tag is whole in front, else the first whole one is taken
    root_is_suite = text.rlike(r"^\s*<(?:[\w.-]+:)?(?i:testsuites?)(?:[\s/>])")
    first = F.when(F.col("_root") != "", F.col("_root")).when(root_is_suite, F.regexp_extract(text, SUITE, 1))
    names = [n for alternatives in COUNTS.values() for n in alternatives]
    read = (rows.withColumn("_root", F.when(checked["_corrupt_record"].isNull(), F.regexp_extract(text, r"^\s*" + SUITE, 1)))
            .withColumn("_root", F.when(F.col("_root").isNotNull(), first)).withColumn("_root", _resolved(F.col("_root")))
            .withColumns({"_kind": _kind(F.col("_root")), **{f"_raw_{n}": _attribute(F.col("_root"), n) for n in names}})
            .withColumns({f"_{c}": _count(lambda n: F.col(f"_raw_{n}"), n) for c, n in COUNTS.items()}))

    def texts(tag: Column) -> Column:
        return F.struct(_kind(tag).alias("kind"), *[_attribute(tag, n).alias(n) for n in names])

    def numbers(tag: Column) -> Column:
        return F.struct(*[_count(lambda n: tag[n], n).alias(c) for c, n in COUNTS.items()])

    below = F.transform(F.slice(F.regexp_extract_all(text, F.lit(SUITE), F.lit(1)), 2, 2147483646), _resolved)
    suites = F.transform(F.filter(F.transform(below, texts), lambda s: s["kind"] == "testsuite"), numbers)
    zero = F.struct(*[F.lit(0).alias(c) for c in COUNTS])
    summed = F.aggregate(suites, zero, lambda a, s: F.struct(*[(a[c] + s[c]).alias(c) for c in COUNTS]))
    own = (F.col("_kind") == "testsuite") | (F.col("_tests") > 0)
    totals = read.withColumn("_sum", F.when((F.col("_root") != "") & ~own, summed))
    return totals.select(*df.columns, *[F.when((F.col("_root") != "") & own, F.col(f"_{c}")).when(F.col("_sum.tests") > 0, F.col(f"_sum.{c}")).alias(c)
                                        for c in COUNTS])
