"""Alert texts and payloads as column expressions; posting them is left to a notifier.

The words of all messages below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# colours, icons and notes per verdict (fixed values)
COLOURS = {"SAFE": "#2eb886", "WARNING": "#f2c744", "BLOCKED": "#e01e5a"}
ICONS = {"SAFE": ":white_check_mark:", "WARNING": ":warning:", "BLOCKED": ":no_entry:"}
UNKNOWN_COLOUR, UNKNOWN_ICON = "#cccccc", ":question:"
TITLE = "Deploy risk"
PHASE_NOTES = {
    "tenant": "Personalised model (trained on your builds)",
    "base": "Base model (personalising as your builds accumulate)",
}


def score_bar(score: Column) -> Column:
    filled = F.floor(score / 5).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(20) - filled))


def _by_verdict(verdict: Column, values: dict[str, str], other: str) -> Column:
    found = F.when(F.lit(False), F.lit(other))
    for name, value in values.items():
        found = found.when(verdict == name, F.lit(value))
    return found.otherwise(F.lit(other))


def score_payload(job: Column, number: Column, score: Column, verdict: Column, phase: Column, reasons: Column,
                  yellow: Column, red: Column, title: str = TITLE) -> Column:
    """JSON message for one scored build. ``reasons`` is an array of (label, value_str)."""
    colour, icon = _by_verdict(verdict, COLOURS, UNKNOWN_COLOUR), _by_verdict(verdict, ICONS, UNKNOWN_ICON)
    header = F.concat(icon, F.lit(f"  *{title} — "), verdict, F.lit("*"), F.when(
        verdict == "BLOCKED", "  _(add `DEPLOY_FORCE=true` to override)_").otherwise(""))
    numbered = F.transform(F.slice(reasons, 1, 3), lambda r, i: F.concat(
        F.lit("\n  "), (i + 1).cast("string"), F.lit(". *"), r["label"], F.lit("* — "), r["value_str"]))
    note = F.when(phase == "tenant", PHASE_NOTES["tenant"]).otherwise(PHASE_NOTES["base"])

    def text(value: Column) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"), value.alias("text"))

    fields = F.array(
        text(F.concat(F.lit("*Job*\n"), job, F.lit(" #"), number)),
        text(F.concat(F.lit("*Risk Score*\n`["), score_bar(score), F.lit("]`  *"), score.cast("string"), F.lit("/100*"))))
    factors = text(F.concat(F.lit("*Top risk factors:*"), F.array_join(numbered, ""), F.lit("\n\n_Model: "), note, F.lit("_")))
    limits = F.array(text(F.concat(
        F.lit("Thresholds: green <"), yellow.cast("string"), F.lit("  |  yellow "), yellow.cast("string"), F.lit("-"),
        red.cast("string"), F.lit("  |  red >"), red.cast("string"))))

    def block(kind: str, fields_: Column | None = None, text_: Column | None = None, elements: Column | None = None) -> Column:
        string_pair = "struct<type:string,text:string>"
        return F.struct(
            F.lit(kind).alias("type"),
            (fields_ if fields_ is not None else F.lit(None).cast(f"array<{string_pair}>")).alias("fields"),
            (text_ if text_ is not None else F.lit(None).cast(string_pair)).alias("text"),
            (elements if elements is not None else F.lit(None).cast(f"array<{string_pair}>")).alias("elements"))

    blocks = F.array(block("section", fields_=fields), block("section", text_=factors), block("context", elements=limits))
    return F.to_json(F.struct(header.alias("text"), F.array(F.struct(
        colour.alias("color"), blocks.alias("blocks"))).alias("attachments")))


def retrain_text(tenant: Column, passed: Column, precision: Column, auc: Column, size: Column, failed_checks: Column,
                 title: str = TITLE) -> Column:
    good = F.concat(
        F.lit(f":white_check_mark: *{title} — Model Updated*\nTenant `"), tenant,
        F.lit("` has a new personalised model.\nPrecision: *"), F.format_string("%.1f", precision * 100),
        F.lit("%*  |  AUC-ROC: *"), F.format_string("%.3f", auc), F.lit("*  |  Trained on *"), size.cast("string"), F.lit("* builds"))
    bad = F.concat(
        F.lit(f":warning: *{title} — Retrain Failed*\nTenant `"), tenant,
        F.lit("` — keeping old model.\nFailed checks: "), F.array_join(failed_checks, ", "))
    return F.when(passed, good).otherwise(bad)


def drift_text(tenant: Column, features: Column, title: str = TITLE) -> Column:
    """``features`` is an array of (feature, p_value)."""
    lines = F.transform(features, lambda f: F.concat(
        F.lit("  • "), f["feature"], F.lit(" (p="), F.format_string("%.4f", f["p_value"]), F.lit(")")))
    return F.concat(
        F.lit(f":chart_with_upwards_trend: *{title} — Feature Drift Detected*\nTenant `"), tenant,
        F.lit("` — build patterns have shifted.\nDrifted features:\n"), F.array_join(lines, "\n"),
        F.lit("\n_Model will be force-retrained tonight at 2am._"))


def health_text(reasons: Column) -> Column:
    return F.concat(F.lit(":rotating_light: *Deploy DEGRADED*\n"), F.array_join(reasons, "; "))
