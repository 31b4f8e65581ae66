"""The curve against counting, and the threshold it gives."""

import random

import pytest
from conftest import rows

from medallion.operators import curve

SCHEMA = "label int, score double, place int, tp string"


def _scored(spark, data):
    return spark.createDataFrame([(y, s, 0, "x") for y, s in data], SCHEMA)


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_curve_counts_scores_from_each_on(spark, ranges):
    pick = random.Random(1)
    data = [(pick.randint(0, 1), pick.choice([0.5, 0.5, pick.random(), -1.0, float("inf")]))
            for _ in range(500)] + [(2, 0.25), (None, 0.5), (1, None), (0, 1e300)]
    known = [(y, s) for y, s in data if y is not None and s is not None]
    expected = sorted((s, sum(y == 1 and t >= s for y, t in known),
                       sum(y != 1 and t >= s for y, t in known)) for s in {s for _, s in known})
    found = curve.precision_recall_curve(_scored(spark, data).repartition(3), "label", ranges=ranges)
    assert rows(found) == expected
    positives = sum(y == 1 for y, _ in known)
    best = max((2 * tp / (tp + fp + positives), s, tp, fp) for s, tp, fp in expected)
    (threshold, tp, fp, f1), = rows(curve.best_threshold(found))
    assert (f1, threshold, tp, fp) == pytest.approx(best)


def test_curve_of_little(spark):
    nothing = curve.precision_recall_curve(_scored(spark, []), "label")
    assert nothing.count() == 0 and curve.best_threshold(nothing).count() == 0
    one = curve.precision_recall_curve(_scored(spark, [(0, 0.5)] * 3), "label")
    assert rows(one) == [(0.5, 0, 3)]
    assert rows(curve.best_threshold(one)) == [(0.5, 0, 3, 0.0)]
