"""Model quality and calibration over (key, p, y) predictions.

Threshold counts are one conditional aggregate. Ranking metrics first count rows per
distinct score, then use prefix sums cut into score bands, so neither a large key nor a
popular score lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.ordered import running_sums

BLOCK = 0.70


def ratio(top: Column, bottom: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def confusion(df: DataFrame, keys: Sequence[str], flagged: Column) -> DataFrame:
    def n(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    risky = F.col("y") == 1
    return df.groupBy(*keys).agg(
        n(~flagged & ~risky).alias("tn"), n(flagged & ~risky).alias("fp"),
        n(~flagged & risky).alias("fn"), n(flagged & risky).alias("tp"))


def prf(counts: DataFrame) -> DataFrame:
    """precision, recall, F1 from confusion counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)))


def mcc(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumn("mcc", ratio(tp * tn - fp * fn, root))


def block_quality(df: DataFrame, keys: Sequence[str], threshold: float = BLOCK) -> DataFrame:
    """Precision, recall and share of builds above the blocking threshold."""
    counts = prf(confusion(df, keys, F.col("p") > threshold))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(*keys, F.col("precision").alias("precision_at_block"), F.col("recall").alias("recall_at_block"),
                         ((F.col("tp") + F.col("fp")) / total).alias("blocked_share"))


def brier(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.col("p") - F.col("y")
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def score_steps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: risky and fine rows, those at lower scores, and totals."""
    counts = df.groupBy(*keys, "p").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("_pos"), F.sum((F.col("y") != 1).cast("long")).alias("_neg"))
    return running_sums(counts, keys, F.floor(F.col("p") * 4096), ["p"], {"_pos": "pos", "_neg": "neg"})


def auc_roc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chance a risky build outranks a fine one, ties half; 0.5 with one class only."""
    steps = score_steps(df, keys)
    wins = F.sum(F.col("_pos") * (F.col("neg_before") + F.col("_neg") / 2))
    pairs = F.max("pos_total") * F.max("neg_total")
    return steps.groupBy(*keys).agg(F.when(pairs == 0, 0.5).otherwise(wins / pairs).alias("auc_roc"))


def auc_pr(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision, stepwise over falling scores."""
    steps = score_steps(df, keys)
    hits = F.col("pos_total") - F.col("pos_before")
    flagged = hits + F.col("neg_total") - F.col("neg_before")
    gained = F.sum(F.col("_pos") * hits / flagged)
    return steps.groupBy(*keys).agg(ratio(gained, F.max("pos_total")).alias("auc_pr"))


def calibration_error(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Row-weighted mean gap between predicted and observed share per bin."""
    binned = df.withColumn("_bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("p") * bins))))
    gaps = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), (F.avg("p") - F.avg("y")).alias("_gap"))
    return gaps.groupBy(*keys).agg((F.sum(F.abs("_gap") * F.col("_n")) / F.sum("_n")).alias("ece"))


def reliability(df: DataFrame, keys: Sequence[str], bins: int = 5, least_rows: int = 10) -> DataFrame:
    """Predicted against observed share per band; thin bands are hidden."""
    edge = sum(((F.col("p") >= F.lit((b + 1) / bins)).cast("int") for b in range(bins - 1)), F.lit(0))
    inside = (F.col("p") >= 0) & (F.col("p") <= 1)
    return (df.filter(inside).groupBy(*keys, edge.cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
        .filter(F.col("rows") >= least_rows))


def lift(counts: DataFrame) -> DataFrame:
    """Precision against the base rate, and the precision a promotion needs."""
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return (prf(counts).withColumn("base_rate", (F.col("tp") + F.col("fn")) / total)
            .withColumn("precision_lift", F.when(F.col("base_rate") > 0, F.col("precision") / F.col("base_rate")).otherwise(0.0))
            .withColumn("precision_required", F.greatest(
                F.lit(K.MIN_PRECISION_ABS), F.col("base_rate") * K.MIN_PRECISION_LIFT)))


def plain(df: DataFrame, keys: Sequence[str], flagged: Column) -> DataFrame:
    """The confusion counts in words."""
    c = confusion(df, keys, flagged)
    return c.select(*keys, (F.col("tp") + F.col("fp")).alias("flagged"), F.col("tp").alias("correct"),
                    F.col("fp").alias("false_alarms"), (F.col("tp") + F.col("fn")).alias("truly_risky"),
                    F.col("fn").alias("missed"))


def evaluate(df: DataFrame, keys: Sequence[str], threshold: float = BLOCK, bins: int = 10) -> DataFrame:
    """All headline metrics, one row per key.

    Everything follows from the counts per distinct score, so the rows are read once for
    those and the metrics need no join among themselves.
    """
    keys = list(keys)
    pos, neg, p = F.col("_pos"), F.col("_neg"), F.col("p")
    rows, blocked = pos + neg, p > threshold
    hits = F.col("pos_total") - F.col("pos_before")
    flagged = hits + F.col("neg_total") - F.col("neg_before")
    binned = score_steps(df, keys).withColumn(
        "_bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(p * bins))))
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.sum(F.when(blocked, pos).otherwise(0)).alias("tp"), F.sum(F.when(blocked, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(blocked, 0).otherwise(pos)).alias("fn"), F.sum(F.when(blocked, 0).otherwise(neg)).alias("tn"),
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("_wins"), F.sum(pos * hits / flagged).alias("_gained"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("_squares"),
        F.sum(rows).alias("_rows"), (F.sum(rows * p) - F.sum(pos)).alias("_gap"),
        F.max("pos_total").alias("_p"), F.max("neg_total").alias("_n"))
    total = per_bin.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "_wins", "_gained", "_squares", "_rows")],
        F.sum(F.abs("_gap")).alias("_gaps"), F.max("_p").alias("_p"), F.max("_n").alias("_n"))
    pairs = F.col("_p") * F.col("_n")
    return prf(mcc(total)).select(
        *keys, "mcc", F.when(pairs == 0, 0.5).otherwise(F.col("_wins") / pairs).alias("auc_roc"),
        ratio(F.col("_gained"), F.col("_p")).alias("auc_pr"),
        F.col("precision").alias("precision_at_block"), F.col("recall").alias("recall_at_block"),
        ((F.col("tp") + F.col("fp")) / F.col("_rows")).alias("blocked_share"),
        (F.col("_squares") / F.col("_rows")).alias("brier"), (F.col("_gaps") / F.col("_rows")).alias("ece"))


# --- promotion gates ----------------------------------------------------------

def held_out_summary(df: DataFrame, keys: Sequence[str], old: bool = False) -> DataFrame:
    """What a gate looks at: counts, precision, recall and AUC on held-out rows.

    With ``old`` the rows also carry the incumbent's probability ``p_old``.
    """
    keys = list(keys)
    quality = lift(confusion(df, keys, F.col("p") > 0.5)).select(
        *keys, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("test_rows"),
        (F.col("tp") + F.col("fn")).alias("test_risky"), "precision", "recall", "f1",
        "base_rate", "precision_lift", "precision_required")
    quality = quality.join(auc_roc(df, keys), keys)
    if old:
        known = df.filter(F.col("p_old").isNotNull())
        incumbent = prf(confusion(known, keys, F.col("p_old") > 0.5)).select(*keys, F.col("precision").alias("old_precision"))
        return quality.join(incumbent, keys, "left")
    return quality.withColumn("old_precision", F.lit(None).cast("double"))


def _passed(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    every = F.lit(True)
    for check in checks.values():
        every = every & check
    return df.withColumns({f"ok_{name}": c for name, c in checks.items()}).withColumn("passed", every)


def failed_checks(gated: DataFrame) -> Column:
    """Names of the checks that a gated row did not pass, in the gate's order."""
    names = [c.removeprefix("ok_") for c in gated.columns if c.startswith("ok_")]
    return F.array_compact(F.array(*[F.when(~F.col(f"ok_{n}"), F.lit(n)) for n in names]))


def gate(summary: DataFrame) -> DataFrame:
    """Promotion gate; reads ``dataset_size`` besides the held-out summary."""
    return _passed(summary, {
        "dataset_size": F.col("dataset_size") >= K.MIN_BUILDS,
        "test_rows": F.col("test_rows") >= K.MIN_TEST_ROWS,
        "test_risky": F.col("test_risky") >= K.MIN_TEST_RISKY,
        "precision": F.col("precision") >= F.col("precision_required"),
        "auc_roc": F.col("auc_roc") >= K.MIN_AUC,
        "risky_ratio": F.col("base_rate") >= K.MIN_RISKY_RATIO,
        "not_regressing": F.coalesce(F.col("precision") >= F.col("old_precision") - K.INCUMBENT_SLACK, F.lit(True)),
    })


def gate_v1(summary: DataFrame) -> DataFrame:
    """Superseded fixed gate (fixed limits)."""
    return _passed(summary, {
        "dataset_size": F.col("dataset_size") >= 80, "precision": F.col("precision") >= 0.75,
        "auc_roc": F.col("auc_roc") >= 0.70, "risky_ratio": F.col("base_rate") >= 0.05})


def gate_base(summary: DataFrame) -> DataFrame:
    """Base-model gate and the stricter evaluation checks (fixed limits)."""
    base = _passed(summary, {
        "precision_min": F.col("precision") >= 0.55, "auc_roc_min": F.col("auc_roc") >= 0.65,
        "recall_min": F.col("recall") >= 0.40})
    return base.withColumns({
        "ok_precision_target": F.col("precision") >= 0.75, "ok_auc_separation": F.col("auc_roc") >= 0.70,
        "ok_f1_balanced": F.col("f1") >= 0.60})
