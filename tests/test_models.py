"""Models over Gold."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import models


def test_centres_that_move_for_long_end_where_the_cost_of_the_fit_was_taken(spark):
    """Nothing but noise, so the centres wander for dozens of rounds before they rest."""
    rows = spark.range(0, 9000, 1, 2).select(
        "id", *[F.rand(i).alias(c) for i, c in enumerate(models.PROFILE)])
    model, assigned = models.cluster_keys(rows)
    summary = model.stages[-1].summary
    report = models.cluster_report(assigned, models.centres(model, rows)).first()
    assert report["keys"] == 9000 and report["clusters"] == 4 and report["misassigned"] == 0
    assert report["cost"] == pytest.approx(summary.trainingCost, rel=1e-6)
    assert summary.numIter > 20
