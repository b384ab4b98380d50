import random

import numpy as np
import pytest

from flowsift.operators import metrics

SCHEMA = "score double, label int"


def case(seed, n=800):
    rng = random.Random(seed)
    # A third of the scores is one value; the rest mixes ties and distinct ones.
    return [(0.2 if rng.random() < 0.33 else round(rng.random(), rng.choice([1, 2, 9])), rng.randrange(2)) for _ in range(n)]


def points(rows):
    out, tp, fp = [], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(y for x, y in rows if x == s)
        fp += sum(1 - y for x, y in rows if x == s)
        out.append((s, tp, fp))
    return out


def corners(pts):
    keep = []
    for i, p in enumerate(pts):
        inner = 0 < i < len(pts) - 1
        if not inner or any(pts[i + 1][k] - 2 * p[k] + pts[i - 1][k] for k in (1, 2)):
            keep.append(p)
    return keep


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 6)])
def test_curves_and_areas(spark, seed, partitions):
    rows = case(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    pts, P = points(rows), sum(y for _, y in rows)
    N = len(rows) - P
    everything = sorted((r.threshold, r.fpr, r.tpr) for r in metrics.roc_curve(df, drop_intermediate=False).collect())
    np.testing.assert_allclose(everything, sorted([(s, fp / N, tp / P) for s, tp, fp in pts] + [(float("inf"), 0.0, 0.0)]))
    kept = {r.threshold for r in metrics.roc_curve(df).collect()}
    assert kept == {s for s, _, _ in corners(pts)} | {float("inf")}
    pairs = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(pairs / (P * N))
    pr = sorted((r.recall, r.precision) for r in metrics.pr_curve(df).collect())
    np.testing.assert_allclose(pr, sorted([(tp / P, tp / (tp + fp)) for _, tp, fp in pts] + [(0.0, 1.0)]))
    area, last = 0.0, (0.0, 1.0)
    for _, tp, fp in pts:
        here = (tp / P, tp / (tp + fp))
        area += (here[0] - last[0]) * (here[1] + last[1]) / 2
        last = here
    assert metrics.pr_auc(df).first()[0] == pytest.approx(area)


def test_zero_denominators_give_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], SCHEMA)
    m = metrics.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1_score, m.roc_auc, m.accuracy, m.true_negatives) == (0.0, 0.0, 0.0, 0.0, 1.0, 2)
    assert metrics.class_weight(df).first()[0] == 1.0
    assert metrics.pr_auc(df).first()[0] == 0.0


def test_sweep_has_17_thresholds_and_ties_take_the_lowest(spark):
    assert metrics.SWEEP == [float(t) for t in np.arange(0.1, 0.95, 0.05)]
    df = spark.createDataFrame([(0.5, 1), (0.05, 0)], SCHEMA)
    sweep = metrics.threshold_sweep(df)
    assert sweep.count() == 17
    best = {r.objective: r.threshold for r in metrics.threshold_best(sweep).collect()}
    assert best == {"best_f1": 0.1, "best_recall": 0.1, "lowest_fpr": 0.1}
    # 0.45 + 0.05 is above 0.5 as a double, and is compared as such.
    assert {r.threshold: r.recall for r in sweep.collect()}[0.5] == 0.0


def test_detector_comparison(spark):
    rows = [(1, True, False), (1, False, True), (0, True, True), (0, False, False), (1, False, False)]
    df = spark.createDataFrame(rows, "label int, ml_flag boolean, sig_flag boolean")
    got = {r.detector: (r.tp, r.tn, r.fp, r.fn) for r in metrics.compare_detectors(df).collect()}
    assert got == {"ml": (1, 1, 1, 2), "signature": (1, 1, 1, 2), "hybrid": (2, 1, 1, 1)}
    assert tuple(metrics.complementarity(df).first()) == (1, 1, 1, 2)
