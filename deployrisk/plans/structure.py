"""Diff and structural-measure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk.operators import change
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()

# The rendered diff in SQL: one row per changed line of the document's file, then Dockerfile.
LINES_SQL = """WITH ext AS (SELECT doc_id, ['.py', '.ts', '.go', '.yml', '.java', '.md', '.sql'][doc_id % 7 + 1] AS ext,
        CASE WHEN doc_id % 3 = 0 THEN 'src/tests/' ELSE 'src/' END || 'm' || doc_id AS stem, string_split(text, chr(10)) AS lines FROM documents),
    raw AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM ext),
    l AS (SELECT doc_id, i, CASE i % 4 WHEN 3 THEN '-' WHEN 2 THEN ' ' ELSE '+' END AS sign,
        CASE i % 5 WHEN 0 THEN '    if (a && b) { ' || line WHEN 1 THEN '// ' || line
          WHEN 2 THEN '        def f' || i || '(): return x or y # ' || line WHEN 3 THEN '} ' || line ELSE line END AS raw FROM raw),
    t AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM l),
    c AS (SELECT *, starts_with(text, '#') OR starts_with(text, '//') OR starts_with(text, '/*') OR starts_with(text, '*') OR starts_with(text, '--')
          OR starts_with(text, '<!--') OR starts_with(text, '\"\"\"') OR starts_with(text, '''''''') AS comment,
        regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS ascii FROM t),
    m AS (SELECT *, text <> '' AND NOT comment AS code,
        len(regexp_extract_all(ascii, '\\b(if|elif|else\\s+if|for|foreach|while|case|when|catch|except|rescue|and|or|&&|\\|\\||\\?)\\b|\\?\\.|\\?\\?')) AS branches,
        regexp_matches(ascii, '\\b(def|function|func|fn|class|interface|struct|impl)\\b') AS decl,
        regexp_matches(regexp_replace(raw, '[^\\x00-\\x7F]', 'x', 'g'), '\\b(def|function|func|class)\\b') AS removed_decl,
        len(raw) - len(regexp_replace(raw, '^\\s+', '')) AS lead,
        len(text) - len(replace(text, '{', '')) - len(text) + len(replace(text, '}', '')) AS step FROM c)"""


def files(spark, sf):
    return change.diff_files(views.diffs(spark, sf), "diff_text", ["change_id"])


@TOPIC.query("src_unified_diff", LINES_SQL + """
    SELECT doc_id AS change_id, CAST(0 AS INTEGER) AS file_no, any_value(stem || ext) AS path, count(*) FILTER (WHERE sign = '+') AS n_added,
        count(*) FILTER (WHERE sign = '-') AS n_removed, coalesce(sum(len(raw)) FILTER (WHERE sign = '+'), 0)::BIGINT AS added_chars,
        any_value(doc_id % 50 + 1 || ',' || len(lines)) AS hunks FROM m JOIN ext USING (doc_id) GROUP BY doc_id
    UNION ALL SELECT doc_id, 1, 'Dockerfile', 1, 1, len('RUN build --if-needed'), (doc_id % 9 + 1) || ',1' FROM documents""")
def src_unified_diff(spark, sf):
    return files(spark, sf).select(
        "change_id", "file_no", "path", F.size("added").cast("long").alias("n_added"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("added", F.lit(0).cast("long"), lambda a, l: a + F.length(l)).alias("added_chars"),
        F.array_join(F.transform("hunks", lambda h: F.concat(h["start"].cast("string"), F.lit(","), h["length"].cast("string"))), ";").alias("hunks"))


@TOPIC.query("sx_file_class", LINES_SQL + """
    SELECT doc_id AS change_id, stem || ext AS path, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go'
        WHEN '.java' THEN 'java' WHEN '.sql' THEN 'sql' ELSE 'other' END AS language, doc_id % 3 = 0 AS is_test, ext = '.yml' AS is_config FROM ext
    UNION ALL SELECT doc_id, 'Dockerfile', 'other', false, true FROM documents""")
def sx_file_class(spark, sf):
    return change.classify(files(spark, sf)).select("change_id", "path", "language", "is_test", "is_config")


def measured(spark, sf):
    return change.line_measures(files(spark, sf))


@TOPIC.query("sx_complexity", LINES_SQL + """
    SELECT doc_id AS change_id, coalesce(sum(branches) FILTER (WHERE sign = '+' AND code), 0)::BIGINT + 1 AS complexity FROM m GROUP BY doc_id""")
def sx_complexity(spark, sf):
    return measured(spark, sf).groupBy("change_id").agg(F.sum("complexity").alias("complexity"))


@TOPIC.query("sx_nesting", LINES_SQL + """
    SELECT doc_id AS change_id, CAST(greatest(0, max(greatest(depth, lead // 4))) AS INTEGER) AS nesting FROM (
        SELECT doc_id, lead, sum(step) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM m WHERE sign = '+' AND code
        UNION ALL SELECT doc_id, 0, 0 FROM documents) GROUP BY doc_id""")
def sx_nesting(spark, sf):
    return measured(spark, sf).groupBy("change_id").agg(F.max("nesting").alias("nesting"))


@TOPIC.query("sx_decls", LINES_SQL + """
    SELECT doc_id AS change_id, count(*) FILTER (WHERE sign = '+' AND code AND decl) AS decls_added,
        count(*) FILTER (WHERE sign = '-' AND removed_decl) + 1 AS decls_removed FROM m GROUP BY doc_id""")
def sx_decls(spark, sf):
    return measured(spark, sf).groupBy("change_id").agg(
        F.sum("decls_added").alias("decls_added"), F.sum("decls_removed").alias("decls_removed"))


@TOPIC.query("sx_comment_ratio", LINES_SQL + """
    SELECT change_id, comments, code, CAST(CAST(CAST(comments / CAST(greatest(1, comments + code) AS DOUBLE) AS VARCHAR) AS DECIMAL(18, 4)) AS DOUBLE) AS comment_ratio
    FROM (SELECT doc_id AS change_id, count(*) FILTER (WHERE sign = '+' AND comment) AS comments, count(*) FILTER (WHERE sign = '+' AND code) + 1 AS code FROM m GROUP BY doc_id)""")
def sx_comment_ratio(spark, sf):
    comments, code = F.sum("comment_lines"), F.sum("code_lines")
    return measured(spark, sf).groupBy("change_id").agg(
        comments.alias("comments"), code.alias("code"),
        F.round(comments / F.greatest(F.lit(1), comments + code), 4).alias("comment_ratio"))


@TOPIC.query("sx_hunks", LINES_SQL + """
    SELECT doc_id AS change_id, 2::BIGINT AS hunk_count, CAST(greatest(1, len(lines)) AS INTEGER) AS max_hunk_size FROM ext""")
def sx_hunks(spark, sf):
    return files(spark, sf).groupBy("change_id").agg(
        F.sum(F.size("hunks")).alias("hunk_count"),
        F.max(F.array_max(F.transform("hunks", lambda h: h["length"]))).alias("max_hunk_size"))


@TOPIC.query("sx_ratios", LINES_SQL + """
    SELECT doc_id AS change_id, 2::BIGINT AS files, CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS test_file_ratio,
        CASE WHEN ext = '.yml' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS config_file_ratio,
        CASE WHEN ext IN ('.yml', '.md') THEN 1 ELSE 2 END::BIGINT AS languages_touched,
        CASE ext WHEN '.py' THEN 'other,python' WHEN '.ts' THEN 'other,typescript' WHEN '.go' THEN 'go,other'
            WHEN '.java' THEN 'java,other' WHEN '.sql' THEN 'other,sql' ELSE 'other' END AS languages FROM ext""")
def sx_ratios(spark, sf):
    rows = change.line_measures(change.classify(files(spark, sf)))
    return change.structure(rows, ["change_id"]).select(
        "change_id", "files", "test_file_ratio", "config_file_ratio", "languages_touched", "languages")
