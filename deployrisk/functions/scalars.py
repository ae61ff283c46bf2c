"""Row-level expressions: score, verdict, reasons, rule risk, parsing helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deployrisk import contract as K
from deployrisk.functions.text import strip


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """A literal map lookup, null when absent."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-folded substring test against fixed words; null text is false."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


# --- score and verdict --------------------------------------------------------

def score(p: Column) -> Column:
    """0-100, halves to even."""
    return F.bround(p * 100, 0).cast("int")


def verdict(s: Column, yellow: Column | int = K.YELLOW, red: Column | int = K.RED) -> Column:
    return F.when(s <= yellow, "SAFE").when(s <= red, "WARNING").otherwise("BLOCKED")


def colour(v: Column) -> Column:
    return F.when(v == "SAFE", "green").when(v == "WARNING", "yellow").otherwise("red")


def gate_exit_code(v: Column, fail_open: Column) -> Column:
    """1 stops the deploy. No verdict (service unavailable) lets it through."""
    return F.when((F.coalesce(v, F.lit("UNAVAILABLE")) == "BLOCKED") & ~fail_open, 1).otherwise(0)


def gate_decision(v: Column, fail_open: Column) -> Column:
    known = F.coalesce(v, F.lit("UNAVAILABLE"))
    return (F.when(known == "UNAVAILABLE", "proceed_unavailable")
            .when((known == "BLOCKED") & fail_open, "proceed_fail_open")
            .when(known == "BLOCKED", "stop").otherwise("proceed"))


# --- rule risk ----------------------------------------------------------------

def _step(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def rule_risk() -> Column:
    """Hand-weighted risk in 0..1 over the ten feature columns (fixed weights)."""
    fail, tests = F.col("recent_failure_rate"), F.col("test_pass_rate")
    hotfix, diff, hour = F.col("is_hotfix") == 1, F.col("diff_size"), F.col("hour_of_day")
    day, gap = F.col("day_of_week"), F.col("days_since_deploy")
    terms = [
        F.when(fail > 0.20, 0.27).when(fail > 0.10, 0.15).otherwise(0.0),
        _step(hotfix, 0.22),
        F.when(tests < 0.60, 0.20).when(tests < 0.75, 0.10).otherwise(0.0),
        F.when(diff > 400, 0.18).when(diff > 150, 0.08).otherwise(0.0),
        _step(hour.between(16, 19), 0.12),
        _step((hour >= 22) | (hour <= 5), 0.10),
        F.when(day == 4, 0.10).when(day >= 5, 0.07).otherwise(0.0),
        _step(gap > 14, 0.08),
        _step(gap > 30, 0.05),
        _step(F.col("deployer_exp") <= 5, 0.05),
        _step(F.col("files_changed") > 20, 0.03),
        # combinations
        _step((day == 4) & (diff > 200), 0.08),
        _step(hotfix & (hour >= 16), 0.06),
        _step((fail > 0.15) & (tests < 0.80), 0.06),
        _step((diff > 300) & (tests < 0.85), 0.06),
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def rule_risk_v2() -> Column:
    """Superseded shorter rule (fixed weights)."""
    fail, tests = F.col("recent_failure_rate"), F.col("test_pass_rate")
    diff, hour, day = F.col("diff_size"), F.col("hour_of_day"), F.col("day_of_week")
    total = (
        F.when(fail > 0.20, 0.28).when(fail > 0.10, 0.14).otherwise(0.0)
        + _step(F.col("is_hotfix") == 1, 0.22)
        + F.when(tests < 0.60, 0.20).when(tests < 0.75, 0.10).otherwise(0.0)
        + F.when(diff > 400, 0.18).when(diff > 150, 0.08).otherwise(0.0)
        + F.when(hour.between(16, 19), 0.12).when((hour >= 22) | (hour <= 5), 0.10).otherwise(0.0)
        + F.when(day == 4, 0.10).when(day >= 5, 0.07).otherwise(0.0)
        + _step(F.col("days_since_deploy") > 14, 0.08))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def rule_label(risk: Column) -> Column:
    return (risk > 0.44).cast("int")


# --- texts --------------------------------------------------------------------

def _percent(value: Column) -> Column:
    return F.bround(value * 100, 0).cast("int")


def number_text(value: Column) -> Column:
    """A fractional number in its shortest form: at least one decimal, an exponent below 0.0001 and from 1e16 on."""
    size, plain = F.abs(value), value.cast("string")
    digits = plain.cast("decimal(38, 18)").cast("string")
    written = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(plain, r"\.0E", "E")
    power = F.regexp_extract(short, r"E-?(\d+)$", 1)
    exponent = F.concat(F.regexp_extract(short, "^[^E]+", 0), F.lit("e"), F.when(short.contains("E-"), "-").otherwise("+"),
                        F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    return (F.when(plain.isNull() | (value == 0) | ((size >= 1e-3) & (size < 1e7)) | F.isnan(value), plain)
            .when((size < 1e-4) | (size >= 1e16), exponent).otherwise(written))


def value_texts() -> dict[str, Column]:
    """Human text per feature column; its words and limits are fixed values."""
    diff, hour, day = F.col("diff_size"), F.col("hour_of_day"), F.col("day_of_week")
    rate, delta = _percent(F.col("recent_failure_rate")), _percent(F.col("build_time_delta"))
    hour12 = F.when(hour == 0, 12).when(hour <= 12, hour).otherwise(hour - 12)
    days = F.array(*[F.lit(d) for d in K.DAY_NAMES])
    return {
        "diff_size": F.concat(diff.cast("string"), F.when(diff > 500, " lines (very large)")
                              .when(diff > 200, " lines (large)").otherwise(" lines")),
        "files_changed": F.col("files_changed").cast("string"),
        "hour_of_day": F.concat(hour12.cast("string"), F.when(hour < 12, ":00 AM").otherwise(":00 PM"),
                                F.when(hour.between(16, 19), " (end of day)").otherwise("")),
        "day_of_week": F.concat(
            F.coalesce(F.try_element_at(days, (day + 1).cast("int")), day.cast("string")),
            F.when(day >= 4, " (risky!)").otherwise("")),
        "recent_failure_rate": F.when(rate == 0, "0% (all recent builds passed)").otherwise(
            F.concat(rate.cast("string"), F.lit("% of last 10 builds failed"))),
        "test_pass_rate": F.concat(_percent(F.col("test_pass_rate")).cast("string"), F.lit("% tests passing")),
        "is_hotfix": F.when(F.col("is_hotfix") == 1, "Yes (hotfix branch)").otherwise("No"),
        "deployer_exp": F.concat(F.col("deployer_exp").cast("string"), F.lit(" past deploys")),
        "days_since_deploy": F.concat(number_text(F.col("days_since_deploy")), F.lit(" days")),
        "build_time_delta": F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"), F.lit("% slower than average")))
        .when(delta < 0, F.concat(delta.cast("string"), F.lit("% faster than average"))).otherwise("normal"),
    }


# --- reasons ------------------------------------------------------------------

def rank_features(importances: Column, count: int = 3) -> Column:
    """The heaviest features of a model: array of (place, importance).

    ``importances`` is an array in contract order. It is rounded to three places before
    ranking and equal ones keep contract order. Ranking is a property of the model, so it
    is done on the model table, before the join with builds.
    """
    entries = F.transform(importances, lambda v, i: F.struct(
        (-F.round(v, 3)).alias("order_by"), i.alias("place")))
    return F.transform(F.slice(F.array_sort(entries), 1, count), lambda e: F.struct(
        e["place"].alias("place"), (-e["order_by"]).alias("importance")))


def top_reasons(ranked: Column, imputed: Column, sources: Column | None = None) -> Column:
    """Reasons for a score from :func:`rank_features`; a filled value says so.

    Only the texts of the ranked features are built for a row.
    """
    texts = value_texts()

    def pick(place: Column, values: Sequence[Column]) -> Column:
        chosen = F.when(place == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            chosen = chosen.when(place == i, v)
        return chosen

    def reason(entry: Column) -> Column:
        place = entry["place"]
        name = F.get(F.array(*[F.lit(f) for f in K.FEATURES]), place)
        guessed = F.array_contains(imputed, name)
        source = F.when(guessed, "imputed").otherwise("provided")
        if sources is not None:
            source = F.coalesce(F.element_at(sources, name), source)
        return F.struct(
            name.alias("feature"),
            F.get(F.array(*[F.lit(K.DISPLAY_LABELS[f]) for f in K.FEATURES]), place).alias("label"),
            entry["importance"].alias("importance"),
            pick(place, [F.col(f).cast("double") for f in K.FEATURES]).alias("value"),
            F.concat(pick(place, [texts[f] for f in K.FEATURES]),
                     F.when(guessed, " — estimated").otherwise("")).alias("value_str"),
            guessed.alias("imputed"), source.alias("source"))

    return F.transform(ranked, reason)


# --- parsing helpers ----------------------------------------------------------

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Finite number in a trimmed text, else null.

    The pattern comes first: a failed ``try_cast`` builds an exception per row.
    """
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def clean_count(raw: Column) -> Column:
    """Text to a whole non-negative count; empty, NaN, infinite and junk become null."""
    value = number(strip(raw))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), value.try_cast("int")))


def epoch_seconds(value: Column) -> Column:
    """ISO-8601 or numeric text to epoch seconds, null when neither."""
    text = strip(value)
    zoned = F.regexp_replace(text, r"Z$", "+00:00")
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    stamped = F.when(zoned.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?[+-]\d\d:\d\d$"),
                     F.unix_micros(zoned.try_cast("timestamp")) / F.lit(1e6))
    return F.coalesce(number(text), stamped)


def hotfix_flag(branch: Column, words: Sequence[str] = tuple(K.HOTFIX_WORDS)) -> Column:
    return contains_any(branch, words).cast("int")


def sensitive_key(key: Column) -> Column:
    return contains_any(key, K.CREDENTIAL_WORDS)


def redact_map(m: Column) -> Column:
    """Values under credential-looking keys are replaced whole."""
    return F.transform_values(m, lambda k, v: F.when(sensitive_key(k), F.lit("[REDACTED]")).otherwise(v))


def redact(value: Column, kind: T.DataType) -> Column:
    """Values under credential-looking names replaced at every depth of maps, lists and structs.

    What a sensitive map key or field names becomes the mark if it is text and null otherwise, as a
    column keeps its type.
    """
    def mark(inner: T.DataType) -> Column:
        return F.lit("[REDACTED]") if isinstance(inner, T.StringType) else F.lit(None).cast(inner)

    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: F.when(sensitive_key(k), mark(kind.valueType)).otherwise(redact(v, kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redact(v, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [(mark(f.dataType) if any(w in f.name.lower() for w in K.CREDENTIAL_WORDS) else redact(value[f.name], f.dataType)).alias(f.name)
                  for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def limiter_key(api_key: Column, forwarded_for: Column, path: Column | None = None,
                ops_paths: Sequence[str] = ()) -> Column:
    """Rate-limit identity: hashed key, else the first forwarded address."""
    by_key = F.concat(F.lit("k:"), F.substring(F.sha2(api_key, 256), 1, 32))
    by_ip = F.concat(F.lit("ip:"), strip(F.element_at(F.split(F.coalesce(forwarded_for, F.lit("?")), ","), 1)))
    chosen = F.when(F.length(F.coalesce(api_key, F.lit(""))) > 0, by_key).otherwise(by_ip)
    if path is not None and ops_paths:
        chosen = F.when(path.isin(*ops_paths), F.lit("ops")).otherwise(chosen)
    return chosen


# --- outcome signals ----------------------------------------------------------

def detect_label(result: Column, branch: Column, message: Column) -> Column:
    """struct(label, source, weight) from build result, branch and commit message."""
    def signal(name: str, weight: float) -> Column:
        return F.struct(F.lit(weight).alias("weight"), F.lit(name).alias("source"))

    found = F.array_compact(F.array(
        F.when(result == "FAILURE", signal("failure", 1.0)),
        F.when(contains_any(branch, K.OUTCOME_BRANCH_WORDS), signal("hotfix_branch", 0.8)),
        F.when(contains_any(message, K.OUTCOME_COMMIT_WORDS), signal("revert_commit", 0.7))))
    best = F.array_max(found)
    none = F.size(found) == 0
    return F.struct(
        F.when(none, 0).otherwise(1).alias("label"),
        F.when(none, "success").otherwise(best["source"]).alias("source"),
        F.when(none | (F.size(found) >= 2), F.lit(1.0)).otherwise(best["weight"]).alias("weight"))
