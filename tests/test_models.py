"""Fitted models and the gate on windows of known separation."""

import random

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import evaluate as E, models as L, reports as R
from tapewatch.operators.measures import MICRO, STATS


@pytest.fixture(scope="module")
def windows(spark):
    """Windows whose events differ from the others in every tenth measure, by ``gap`` deviations."""
    rnd = random.Random(3)
    names = [*dict.fromkeys([*STATS, *MICRO])]

    def rows(gap):
        out = []
        for i in range(400):
            y = int(i % 8 == 0)
            out.append((f"p{i % 5}", i * 900_000, y, *[rnd.gauss(gap * y if j % 10 == 0 or n in MICRO else 0, 1) for j, n in enumerate(names)]))
        return spark.createDataFrame(out, ", ".join(["pair string, end_ms bigint, y int", *[f"`{n}` double" for n in names]])).coalesce(1).cache()

    return {gap: rows(gap) for gap in (0.0, 6.0)}


FITS = {
    "microstructure": L.fit_microstructure,
    "logistic": L.fit_stat_logistic,
    "forest": lambda w: L.fit_forest(w, trees=20, depth=6),
    "boosted": lambda w: L.fit_boosted(w, rounds=8, depth=3, rate=0.3),
}


@pytest.mark.parametrize("name", FITS)
def test_scores_tell_events_apart(windows, name):
    w = windows[6.0]
    s = L.score_model(FITS[name](w), w)
    means = {r.y: r.m for r in s.groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert s.count() == 400 and s.filter("score < 0 or score > 1").count() == 0
    assert means[1] - means[0] > 0.5
    best = E.tune_threshold(s).select(F.col("f1"), R.gate(F.col("f1"), 0.60).alias("verdict")).first()
    assert best.f1 > 0.95 and best.verdict == "PASS"


def test_the_gate_fails_on_chance(windows):
    w = windows[0.0]
    fit = L.fit_forest(w.filter("end_ms < 180000000"), trees=20, depth=6)
    best = E.tune_threshold(L.score_model(fit, w.filter("end_ms >= 180000000"))).select(F.col("f1"), R.gate(F.col("f1"), 0.60).alias("verdict")).first()
    assert best.f1 < 0.6 and best.verdict == "FAIL"


def test_reconstruction_errors_rise_for_events(windows):
    w = windows[6.0]
    s = L.score_reconstruction(L.fit_reconstruction(w.filter("y = 0")), w)
    means = {r.y: r.m for r in s.groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > 2 * means[0] > 0
