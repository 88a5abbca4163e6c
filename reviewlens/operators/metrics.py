"""Binary classification metrics as DataFrame aggregations.

Confusion counts by conditional sums; rates as exact integer ratios; ROC area
as the Mann-Whitney statistic over distinct scores (ties count one half) and
PR area as average precision (precision at each distinct score, weighted by
the recall it adds).  All run as distributed aggregates over any row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.ordered import prefix_sums


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _weight(column: str | None) -> Column:
    return (F.lit(1) if column is None else F.col(column)).cast("bigint")


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   weight: str | None = None) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision / recall / F1 of the
    positive class, precision / recall of the negative class (NULL when a
    denominator is 0).  A row counts ``weight`` times."""
    y, p, w = F.col(label).cast("int"), F.col(prediction).cast("int"), _weight(weight)

    def count_if(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w).otherwise(0)).cast("bigint"), F.lit(0).cast("bigint"))

    counts = df.agg(count_if((y == 1) & (p == 1)).alias("tp"), count_if((y == 0) & (p == 1)).alias("fp"),
                    count_if((y == 0) & (p == 0)).alias("tn"), count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp", "fp", "tn", "fn",
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision_pos"),
        _ratio(tp, tp + fn).alias("recall_pos"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_pos"),
        _ratio(tn, tn + fn).alias("precision_neg"),
        _ratio(tn, tn + fp).alias("recall_neg"))


def _by_score(df: DataFrame, label: str, score: str, weight: str | None) -> DataFrame:
    y, w = F.col(label).cast("int"), _weight(weight)
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).cast("bigint").alias("neg"), F.sum(w).cast("bigint").alias("n"))


def score_metrics(df: DataFrame, label: str = "label", score: str = "score", digits: int = 9,
                  weight: str | None = None) -> DataFrame:
    """One row: positives, negatives, unscored, auc_roc, auc_pr from the distinct scores.

    auc_roc = P(score+ > score-) + P(tie)/2; auc_pr = sum over distinct scores
    of precision at that score or higher * added recall, rounded to ``digits``
    (a double sum).  Rows without a score are left out and counted; NaN is the
    highest score; a row counts ``weight`` times.
    """
    by_score = _by_score(df, label, score, weight)
    ranked = prefix_sums(by_score, "score", ["pos", "neg"])
    unscored = by_score.where(F.col("score").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))).scalar()
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    agg = ranked.withColumn("_tp", tp).withColumn("_fp", fp).agg(
        # pairs of rows: more than a long counts
        F.sum(F.col("pos").cast("decimal(18,0)") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)"))
        .alias("u2"),
        F.sum(F.col("pos").cast("double") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("s"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return agg.select(
        "positives", "negatives", unscored.alias("unscored"),
        _ratio(F.col("u2"), 2 * F.col("positives").cast("decimal(18,0)") * F.col("negatives").cast("decimal(18,0)"))
        .alias("auc_roc"),
        F.round(_ratio(F.col("s"), F.col("positives")), digits).alias("auc_pr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return score_metrics(df, label, score).select("positives", "negatives", "unscored", "auc_roc")


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 9) -> DataFrame:
    return score_metrics(df, label, score, digits).select("positives", "unscored", "auc_pr")
