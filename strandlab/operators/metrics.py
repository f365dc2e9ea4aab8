"""Metrics of binary predictions, as aggregates over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.ranges import before, dealt


def predicted(logit0: str = "logit0", logit1: str = "logit1") -> Column:
    """The larger logit's class; 0 for equal ones."""
    return F.when(F.col(logit1) > F.col(logit0), 1).otherwise(0)


def cell(label: int, pred: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("pred") == pred))


def accuracy() -> Column:
    return F.avg((F.col("label") == F.col("pred")).cast("int"))


def f1() -> Column:
    """2 TP / (2 TP + FP + FN), 0 where that is undefined."""
    tp, fp, fn = cell(1, 1), cell(0, 1), cell(1, 0)
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def confusion() -> Column:
    """[[TN, FP], [FN, TP]]."""
    return F.array(F.array(cell(0, 0), cell(0, 1)), F.array(cell(1, 0), cell(1, 1)))


def mcc() -> Column:
    """Matthews correlation from the four cells; 0 where a margin is empty."""
    tn, fp, fn, tp = (cell(a, b).cast("double") for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, under), F.lit(0.0))


def evaluated(rows: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, the better of it and of flipped labels, F1 of the unflipped predictions, and the confusion matrix."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), accuracy().alias("acc_raw"), f1().alias("f1"), confusion().alias("confusion"))
    return out.withColumn("acc_flipbest", F.greatest(F.col("acc_raw"), 1 - F.col("acc_raw")))


def scored(rows: DataFrame, metric_of: dict[str, str], *keys: str, task: str = "task") -> DataFrame:
    """keys (task among them), metric, score, acc and f1 to 4 places; score is the task's own metric, mcc or accuracy (the
    default)."""
    named = F.element_at(F.create_map(*(F.lit(x) for pair in metric_of.items() for x in pair)), F.col(task)) if metric_of else F.lit(None)
    out = rows.groupBy(*keys).agg(accuracy().alias("acc"), mcc().alias("__mcc"), f1().alias("f1"), F.count("*").alias("n"))
    out = out.withColumn("metric", F.coalesce(named, F.lit("accuracy")))
    score = F.when(F.col("metric") == "mcc", F.col("__mcc")).otherwise(F.col("acc"))
    return out.select(*keys, "metric", F.round(score, 4).alias("score"), F.round("acc", 4).alias("acc"), F.round("f1", 4).alias("f1"), "n")


def guarded(rows: DataFrame, *keys: str) -> DataFrame:
    """Where accuracy is under one half all predictions flip before any metric is taken; label_flipped says so.

    The flip only swaps the matrix's columns, so one pass is enough.
    """
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(cell(a, b).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    out = out.withColumn("label_flipped", (F.col("c00") + F.col("c11")) / F.col("n") < 0.5)
    pick = lambda a, b: F.when(F.col("label_flipped"), F.col(f"c{a}{1 - b}")).otherwise(F.col(f"c{a}{b}"))
    out = out.select(*keys, "n", "label_flipped", *(pick(a, b).alias(n) for (a, b), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), ("tn", "fp", "fn", "tp"), strict=True)))
    return out.withColumns({"accuracy": (F.col("tn") + F.col("tp")) / F.col("n"), "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})


def auc(rows: DataFrame, score: str, *keys: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null without both classes. Flipping is independent of accuracy's.

    Equal scores are counted together first. Scores are dealt out by ranges of (keys, score): pairs of one range are counted
    within it, pairs across ranges by the ranges' sums, so a large group's scores never meet in one task.
    """
    ties = rows.groupBy(*keys, F.col(score).alias("__v")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    own = [*keys, "__range"]
    ties = dealt(ties, list(keys), "__v").withColumn("under", F.coalesce(F.sum("q").over(before(own, "__v")), F.lit(0)))
    pairs = F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0))
    ranges = ties.groupBy(*own).agg(F.min("__v").alias("__low"), F.sum("p").alias("p"), F.sum("q").alias("q"), pairs.alias("pairs"))
    ranges = ranges.withColumn("under", F.coalesce(F.sum("q").over(before(list(keys), "__low")), F.lit(0)))
    whole = F.sum(F.col("pairs") + F.col("p") * F.col("under").cast("double"))
    out = ranges.groupBy(*keys).agg(F.try_divide(whole, (F.sum("p").cast("double") * F.sum("q"))).alias("auc"))
    return out.withColumn("auc_flipbest", F.greatest(F.col("auc"), 1 - F.col("auc")))
