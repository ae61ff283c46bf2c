"""Structural measures of a change from its unified diff.

Everything about one file of a diff is computed inside its row with array functions, so
no shuffle is needed until files are summed per change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.functions.scalars import lookup

# --- fixed values -----------------------------------------------------------------
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".scala": "scala",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".swift": "swift", ".m": "objc",
    ".sh": "shell", ".bash": "shell",
    ".sql": "sql",
}
CONFIG_EXTENSIONS = [".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".env",
                     ".tf", ".tfvars", ".properties", ".conf", ".xml"]
CONFIG_NAMES = ["dockerfile", "makefile", "jenkinsfile", "procfile",
                "docker-compose.yml", "requirements.txt", "package.json",
                "go.mod", "cargo.toml", "pom.xml", "build.gradle"]
TEST_MARKERS = ["test_", "_test.", "/tests/", "/test/", ".test.", ".spec.",
                "spec_", "_spec.", "/spec/", "__tests__"]
COMMENT_PREFIXES = ["#", "//", "/*", "*", "--", "<!--", '"""', "'''"]
BRANCH_PATTERN = (r"\b(if|elif|else\s+if|for|foreach|while|case|when|catch|except|"
                  r"rescue|and|or|&&|\|\||\?)\b|\?\.|\?\?")
DECLARATION_PATTERN = r"\b(def|function|func|fn|class|interface|struct|impl)\b"
REMOVED_DECLARATION_PATTERN = r"\b(def|function|func|class)\b"
HUNK_PATTERN = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
# ----------------------------------------------------------------------------------

UNICODE = "(?U)"
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def is_comment(stripped: Column) -> Column:
    hit = F.lit(False)
    for prefix in COMMENT_PREFIXES:
        hit = hit | stripped.startswith(prefix)
    return hit


def diff_files(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per file of each diff: path, added and removed lines, hunks.

    A change without files has one row of nulls, so that it is not lost.
    """
    unix = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINE_BREAKS, "\n")
    chunks = F.slice(F.split(unix, r"(?md)^diff --git"), 2, 2147483646)
    files = df.select(*keys, F.posexplode_outer(chunks).alias("file_no", "_chunk"))
    lines = F.split("_chunk", "\n", -1)
    cut = files.select(*keys, "file_no", lines.alias("_lines"))
    head = F.concat(F.lit("diff --git"), F.get("_lines", F.lit(0)))
    at = F.locate(" b/", head)
    path = F.when(at > 0, F.substring(head, at + 3, 2147483646)).otherwise(
        F.element_at(F.split(_stripped(head), r"(?U)\s+"), -1))
    body = F.slice("_lines", 2, 2147483646)
    header = lambda l: l.startswith("+++") | l.startswith("---") | l.startswith("@@")

    def starting(sign: str) -> Column:
        kept = F.filter(body, lambda l: l.startswith(sign) & ~header(l))
        return F.transform(kept, lambda l: F.substring(l, 2, 2147483646))

    hunk_lines = F.filter(body, lambda l: l.rlike(HUNK_PATTERN))
    hunks = F.transform(hunk_lines, lambda l: F.struct(
        F.regexp_extract(l, HUNK_PATTERN, 1).cast("int").alias("start"),
        F.coalesce(F.nullif(F.regexp_extract(l, HUNK_PATTERN, 2), F.lit("")).cast("int"), F.lit(1)).alias("length")))
    return cut.select(*keys, "file_no", path.alias("path"), starting("+").alias("added"),
                      starting("-").alias("removed"), hunks.alias("hunks"))


def classify(files: DataFrame) -> DataFrame:
    """Extension, language, test and config flags from the path."""
    low = F.lower("path")
    name = F.element_at(F.split(low, "/"), -1)
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    test = F.lit(False)
    for marker in TEST_MARKERS:
        test = test | low.contains(marker)
    return (files.withColumn("ext", ext)
            .withColumn("language", F.coalesce(lookup(LANGUAGES, ext), F.lit("other")))
            .withColumn("is_test", test)
            .withColumn("is_config", ext.isin(*CONFIG_EXTENSIONS) | name.isin(*CONFIG_NAMES)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v.cast("int"))


def line_measures(files: DataFrame) -> DataFrame:
    """Complexity, nesting, declarations and comment counts of the added lines."""
    prepared = files.withColumn("_rows", F.transform("added", lambda l: F.struct(
        l.alias("raw"), _stripped(l).alias("text"))))
    code = F.filter("_rows", lambda r: (r["text"] != "") & ~is_comment(r["text"]))
    prepared = prepared.withColumn("_code", code)

    def braces(text: Column, brace: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(brace), F.lit("")))

    def step(state: Column, r: Column) -> Column:
        depth = state["depth"] + braces(r["text"], "{") - braces(r["text"], "}")
        indent = F.floor((F.length(r["raw"]) - F.length(F.regexp_replace(r["raw"], r"(?U)^\s+", ""))) / 4).cast("int")
        return F.struct(depth.alias("depth"), F.greatest(state["deepest"], depth, indent).alias("deepest"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    measured = prepared.select(
        *files.columns,
        _total(F.transform("_code", lambda r: F.regexp_count(r["text"], F.lit(UNICODE + BRANCH_PATTERN)))).alias("complexity"),
        F.aggregate("_code", start, step, lambda s: s["deepest"]).alias("nesting"),
        F.size(F.filter("_code", lambda r: r["text"].rlike(UNICODE + DECLARATION_PATTERN))).alias("decls_added"),
        F.size(F.filter("removed", lambda l: l.rlike(UNICODE + REMOVED_DECLARATION_PATTERN))).alias("decls_removed"),
        F.size(F.filter("_rows", lambda r: is_comment(r["text"]))).alias("comment_lines"),
        F.size("_code").alias("code_lines"))
    return measured


def structure(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structural features per change from measured and classified files."""
    comments, code = F.sum("comment_lines"), F.sum("code_lines")
    none = lambda value: F.coalesce(value, F.lit(0))  # noqa: E731  a change without files has zeros
    return files.groupBy(*keys).agg(
        F.count("file_no").alias("files"),
        none(F.sum("complexity")).alias("added_complexity"),
        none(F.max("nesting")).alias("max_nesting_depth"),
        none(F.sum("decls_added")).alias("decls_added"),
        none(F.sum("decls_removed")).alias("decls_removed"),
        none(F.sum(F.size("hunks"))).alias("hunk_count"),
        none(F.max(F.array_max(F.transform("hunks", lambda h: h["length"])))).alias("max_hunk_size"),
        none(F.round(comments / F.greatest(F.lit(1), comments + code), 4)).alias("comment_ratio"),
        none(F.round(F.avg(F.col("is_test").cast("int")), 4)).alias("test_file_ratio"),
        none(F.round(F.avg(F.when(F.col("file_no").isNotNull(), F.col("is_config").cast("int"))), 4)).alias("config_file_ratio"),
        F.countDistinct(F.when(F.col("file_no").isNotNull(), F.col("language"))).alias("languages_touched"),
        # a fixed list of languages bounds this set
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("file_no").isNotNull(), F.col("language")))), ",").alias("languages"))
