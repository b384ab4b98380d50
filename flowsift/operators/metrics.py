"""Evaluation of scores and detectors: counts, curves, areas, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.scalars import INF, count_where, q, ratio, scored as _score
from flowsift.operators.order import _bucketize, _cuts, default_buckets

# The 17 sweep thresholds, 0.1 to 0.9. The step is the double between the first two, as numpy's
# arange takes it; thresholds are compared as they are and rounded only for display.
SWEEP = [0.1 + ((0.1 + 0.05) - 0.1) * i for i in range(17)]


def _pick_counts(flag: Column, label: Column) -> dict[str, Column]:
    return {"tp": count_where(flag & (label == 1)), "fp": count_where(flag & (label == 0)),
            "fn": count_where(~flag & (label == 1)), "tn": count_where(~flag & (label == 0))}


def _quality(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates from four counts; a zero denominator gives 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)}


def _cells(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in ("tp", "fp", "fn", "tn"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Benign rows per attack row; 1 without attacks."""
    attack, benign = count_where(q(label) == 1), count_where(q(label) == 0)
    return df.agg(F.when(attack > 0, benign / attack).otherwise(1.0).alias("scale_pos_weight"))


def split_summary(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    benign, attack = count_where(q(label) == 0), count_where(q(label) == 1)
    return df.groupBy(q(split).alias("split")).agg(
        F.count("*").alias("n"), benign.alias("benign"), attack.alias("attack"),
        (attack / F.greatest(benign, F.lit(1))).alias("attack_ratio"))


def cumulative_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score with its positives and negatives (pos, neg) and the counts at
    or above it (tp, fp), all in descending score order; P and N are the totals.

    Rows are first counted per score. Distinct scores go to range buckets cut at quantiles of
    the score; running sums are taken inside a bucket and shifted by the totals of the buckets
    above, a table with as many rows as buckets. Rows without a score or with NaN stand below all others. ``next_pos``/``next_neg`` are the counts of the
    next lower score, also across a bucket border.
    """
    n = default_buckets(df)
    # A row without a score is below every threshold, as in a verdict.
    scored = df.select(F.coalesce(_score(q(score)), F.lit(-INF)).alias("score"), q(label).alias("label"))
    quantiles = scored.approxQuantile("score", [i / n for i in range(1, n)], 1.0 / (4 * n))
    per_score = scored.groupBy("score").agg(F.sum(F.col("label").cast("bigint")).alias("pos"),
                                            F.count("*").alias("k"))
    per_score = per_score.select("score", "pos", (F.col("k") - F.col("pos")).alias("neg"))
    bucketed = _bucketize(per_score, "score", "_b", _cuts(quantiles)[0])
    above = Window.orderBy(F.col("_b").desc())
    totals = (bucketed.groupBy("_b")
              .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
                   F.max_by("pos", "score").alias("_hp"), F.max_by("neg", "score").alias("_hn"))
              .select("_b", (F.sum("_p").over(above) - F.col("_p")).alias("_tp"),
                      (F.sum("_n").over(above) - F.col("_n")).alias("_fp"),
                      F.sum("_p").over(Window.partitionBy()).alias("P"),
                      F.sum("_n").over(Window.partitionBy()).alias("N"),
                      F.lead("_hp").over(above).alias("_np"), F.lead("_hn").over(above).alias("_nn")))
    inside = Window.partitionBy("_b").orderBy(F.col("score").desc())
    return (bucketed.join(totals, "_b")
            .select("score", "pos", "neg",
                    (F.col("_tp") + F.sum("pos").over(inside)).alias("tp"),
                    (F.col("_fp") + F.sum("neg").over(inside)).alias("fp"), "P", "N",
                    F.coalesce(F.lead("pos").over(inside), F.col("_np")).alias("next_pos"),
                    F.coalesce(F.lead("neg").over(inside), F.col("_nn")).alias("next_neg")))


def _area_under_roc() -> Column:
    """Sum over score groups of the trapezoid between the points before and after it."""
    before = (F.col("tp") - F.col("pos")).cast("double")
    return F.coalesce(F.try_divide(F.sum(F.col("neg") * (before + F.col("pos") / 2)),
                                   F.max(F.col("P")).cast("double") * F.max("N")), F.lit(0.0))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return cumulative_counts(df, score, label).agg(_area_under_roc().alias("roc_auc"))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", drop_intermediate: bool = True) -> DataFrame:
    """Points (threshold, fpr, tpr) and the start point at threshold infinity.

    ``drop_intermediate`` leaves out points inside a straight run of the curve.
    """
    points = cumulative_counts(df, score, label)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        corner = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        points = points.filter(first | F.col("next_pos").isNull() | corner)
    rows = points.select(F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("N")).alias("fpr"),
                         ratio(F.col("tp"), F.col("P")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(INF, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return rows.unionByName(start)


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Points (threshold, precision, recall) and the end point (recall 0, precision 1)."""
    rows = cumulative_counts(df, score, label).select(
        F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(1.0).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return rows.unionByName(end)


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Trapezoid area under the precision-recall points."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    now = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    area = F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * (now + before) / 2).otherwise(0.0))
    return cumulative_counts(df, score, label).agg(F.coalesce(area, F.lit(0.0)).alias("pr_auc"))


def binary_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row with 13 metrics at a threshold, counts and area from one pass over score groups."""
    flag = F.col("score") >= threshold

    def total(cond: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(0)), F.lit(0))

    counts = cumulative_counts(df, score, label).agg(
        total(flag, "pos").alias("tp"), total(flag, "neg").alias("fp"),
        total(~flag, "pos").alias("fn"), total(~flag, "neg").alias("tn"), _area_under_roc().alias("roc_auc"))
    m = _quality(*_cells())
    return counts.select(
        m["accuracy"].alias("accuracy"), m["precision"].alias("precision"), m["recall"].alias("recall"),
        m["f1"].alias("f1_score"), "roc_auc", m["fpr"].alias("false_positive_rate"),
        m["recall"].alias("true_positive_rate"), F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
        F.col("tp").alias("true_positives"), F.lit(float(threshold)).alias("threshold"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("total_samples"))


def class_report(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support: both classes, accuracy, macro and weighted average."""
    counts = _pick_counts(F.coalesce(_score(q(score)) >= threshold, F.lit(False)), q(label))
    row = df.agg(*[c.alias(n) for n, c in counts.items()])
    tp, fp, fn, tn = _cells()
    n0, n1 = tn + fp, tp + fn
    benign = [ratio(tn, tn + fn), ratio(tn, n0), ratio(2 * tn, 2 * tn + fn + fp)]
    attack = [ratio(tp, tp + fp), ratio(tp, n1), ratio(2 * tp, 2 * tp + fp + fn)]
    accuracy = ratio(tp + tn, n0 + n1)

    def line(name: str, cells: list[Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("class_name"), cells[0].alias("precision"), cells[1].alias("recall"),
                        cells[2].alias("f1_score"), support.alias("support"))

    macro = [(a + b) / 2 for a, b in zip(benign, attack)]
    weighted = [ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(benign, attack)]
    return row.select(F.inline(F.array(
        line("BENIGN", benign, n0), line("ATTACK", attack, n1), line("accuracy", [accuracy] * 3, n0 + n1),
        line("macro avg", macro, n0 + n1), line("weighted avg", weighted, n0 + n1))))


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Metrics at 17 thresholds, all counted in one pass. Thresholds are compared unrounded."""
    sums: list[Column] = [count_where(q(label) == 1).alias("P"), count_where(q(label) == 0).alias("N")]
    for i, t in enumerate(SWEEP):
        flag = _score(q(score)) >= t
        sums += [count_where(flag & (q(label) == 1)).alias(f"tp{i}"), count_where(flag & (q(label) == 0)).alias(f"fp{i}")]
    lines = F.array(*[F.struct(F.lit(round(t, 2)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                               F.col(f"fp{i}").alias("fp"), (F.col("P") - F.col(f"tp{i}")).alias("fn"),
                               (F.col("N") - F.col(f"fp{i}")).alias("tn")) for i, t in enumerate(SWEEP)])
    m = _quality(*_cells())
    return df.agg(*sums).select(F.inline(lines)).select("threshold", *[c.alias(n) for n, c in m.items()])


def threshold_best(sweep: DataFrame) -> DataFrame:
    """Sweep rows of best F1, best recall and lowest false-positive rate; ties go to the lowest
    threshold."""
    cells = ["threshold", "accuracy", "precision", "recall", "f1", "fpr"]
    row = F.struct(*cells)

    def best(measure: Column) -> Column:
        return F.min_by(row, F.struct(measure, F.col("threshold")))

    picked = sweep.agg(best(-F.col("f1")).alias("best_f1"), best(-F.col("recall")).alias("best_recall"),
                       best(F.col("fpr")).alias("lowest_fpr"))
    goals = F.array(*[F.struct(F.lit(g).alias("objective"), *[F.col(f"{g}.{c}").alias(c) for c in cells])
                      for g in ("best_f1", "best_recall", "lowest_fpr")])
    return picked.select(F.inline(goals))


def compare_detectors(df: DataFrame, ml: str = "ml_flag", signature: str = "sig_flag", label: str = "label") -> DataFrame:
    """Counts and rates of the classifier, the signatures and their union, in one pass."""
    flags = {"ml": q(ml), "signature": q(signature), "hybrid": q(ml) | q(signature)}
    sums = [c.alias(f"{d}_{n}") for d, f in flags.items() for n, c in _pick_counts(f, q(label)).items()]
    lines = []
    for detector in flags:
        tp, fp, fn, tn = _cells(f"{detector}_")
        lines.append(F.struct(F.lit(detector).alias("detector"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"),
                              fn.alias("fn"), *[c.alias(n) for n, c in _quality(tp, fp, fn, tn).items()]))
    return df.agg(*sums).select(F.inline(F.array(*lines)))


def complementarity(df: DataFrame, ml: str = "ml_flag", signature: str = "sig_flag") -> DataFrame:
    a, b = q(ml), q(signature)
    return df.agg(count_where(a & ~b).alias("ml_only"), count_where(~a & b).alias("signature_only"),
                  count_where(a & b).alias("both"), count_where(~a & ~b).alias("neither"))
