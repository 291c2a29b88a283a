"""Queries of the models. What a fit finds is beyond SQL; what has to hold of it is not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.derived import EVENTS, table
from tidemark.catalog.registry import query
from tidemark.operators.history import find_cut_points
from tidemark.plans import models
from tidemark.plans.layers import to_gold


def _gold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return to_gold(events, EVENTS, "value", None, find_cut_points(events, EVENTS))


@query
def key_clusters(spark, sf_dir):
    """Clusters of the users, checked from the stored centres: every user is with the nearest one,
    and the distances add up to the cost of the fit."""
    profiles = models.key_profiles(_gold(spark, sf_dir), EVENTS, "value")
    model, assigned = models.cluster_keys(profiles)
    report = models.cluster_report(assigned, models.centres(model, profiles))
    cost = model.stages[-1].summary.trainingCost
    agrees = F.abs(F.col("cost") - cost) <= 1e-6 * cost
    return report.select("keys", "clusters", "misassigned", agrees.alias("cost_agrees"))


@query
def trend_check(spark, sf_dir):
    """Whether a value rises, learned from the first part of the time and judged on the rest."""
    rows = models.trend_rows(_gold(spark, sf_dir), EVENTS, "value")
    train, test = models.split_by_time(rows, "ts")
    report = models.trend_report(models.trend_model(train), train, test, "ts")
    better = F.col("accuracy") > F.col("majority")
    return report.select("train_rows", "test_rows", "leaks", better.alias("beats_majority"))
