"""Models over Gold: clusters of keys, and the direction of a key's next change."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalar, series
from tidemark.operators.history import CutPoints, Timeline, over_history
from tidemark.session import scratch_path

PROFILE = ("log_return_mean", "log_return_spread", "volatility_mean", "price_spread")
_SEED = 7
# Spark's cost of a fit is that of the centres before their last move, so they have to rest.
_MOST_MOVES = 1_000


def key_profiles(
    gold: DataFrame, timeline: Timeline = Timeline(), value: str = "quote_USD_price"
) -> DataFrame:
    """One row per key: what its history looks like on average. What a key lacks is 0."""
    spread = scalar.ratio(F.stddev_samp(value), F.avg(value))
    return (
        gold.filter(F.col(timeline.key).isNotNull())
        .groupBy(timeline.key)
        .agg(
            F.avg("observed_log_return").alias("log_return_mean"),
            F.stddev_samp("observed_log_return").alias("log_return_spread"),
            F.avg("volatility_3").alias("volatility_mean"),
            spread.alias("price_spread"),
        )
        .fillna(0.0, list(PROFILE))
    )


def cluster_keys(
    profiles: DataFrame, k: int = 4, columns: Sequence[str] = PROFILE
) -> tuple[PipelineModel, DataFrame]:
    """A fitted pipeline of k-means over scaled profiles, and the profiles with ``scaled`` (an
    array) and ``cluster``."""
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_features"),
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True),
        KMeans(featuresCol="_scaled", predictionCol="cluster", k=k, seed=_SEED,
               maxIter=_MOST_MOVES),
    ]).fit(profiles)
    found = _stored(model, profiles).transform(profiles).withColumn("scaled", vector_to_array("_scaled"))
    return model, found.drop("_features", "_scaled")


def _stored(model: PipelineModel, rows: DataFrame) -> PipelineModel:
    """The model as written to the shared folder and read again.

    A model that was just fitted holds its training rows and with them the session, which
    tasks cannot be sent once rows have been counted while they were written.
    """
    path = scratch_path(rows.sparkSession, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def centres(model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """The centres of a fitted pipeline as a table, one row per cluster."""
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return profiles.sparkSession.createDataFrame(found, "cluster INT, centre ARRAY<DOUBLE>")


def cluster_report(assigned: DataFrame, centre: DataFrame) -> DataFrame:
    """Keys, clusters, keys that another centre is nearer to, and the summed squared distances
    to the own centre, computed from the stored centres."""
    def distance(to: list[float]) -> Column:
        parts = [F.pow(F.get("scaled", F.lit(i)) - x, F.lit(2)) for i, x in enumerate(to)]
        return reduce(Column.__add__, parts)

    # One row per cluster.
    stored = sorted((r["cluster"], r["centre"]) for r in centre.collect())
    ways = F.array(*[distance(c) for _, c in stored])
    own = F.element_at(F.create_map(*[
        x for i, (name, _) in enumerate(stored) for x in (F.lit(name), F.get("_d", F.lit(i)))
    ]), F.col("cluster"))
    return assigned.withColumn("_d", ways).withColumn("_own", own).agg(
        F.count("*").alias("keys"),
        F.count_distinct("cluster").alias("clusters"),
        F.count_if(F.col("_own") > F.array_min("_d") + 1e-9).alias("misassigned"),
        F.sum("_own").alias("cost"),
    )


TREND = ("last_change", "last_volatility", "over_mean")


def trend_rows(
    gold: DataFrame, timeline: Timeline = Timeline(), value: str = "quote_USD_price",
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Rows with ``label``, whether the value rose, and what was known at the row before: its
    change, its volatility, and its value against its mean of seven. Rows without these go."""
    def known(rows: DataFrame, w: WindowSpec) -> DataFrame:
        def before(c: Column) -> Column:
            return timeline.masked(series.previous(c, w))

        return rows.withColumns({
            "last_change": before(F.col("price_delta_pct")),
            "last_volatility": before(F.col("volatility_3")),
            "over_mean": before(scalar.ratio(value, "price_sma_7")),
        })

    reads = ["price_delta_pct", "volatility_3", value, "price_sma_7"]
    rows = over_history(gold, known, timeline, 1, reads, cuts)
    label = (F.col("price_delta_pct") > 0).cast("double")
    return rows.withColumn("label", label).dropna(subset=["label", *TREND])


def split_by_time(rows: DataFrame, time: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Rows of the first ``share`` of the time they span, and those after it."""
    at = series.micros(F.col(time))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        return rows, rows
    border = first + int((last - first) * share)
    return rows.filter(at <= border), rows.filter(at > border)


def trend_model(train: DataFrame) -> PipelineModel:
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(TREND), outputCol="_features"),
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol="label", maxIter=50),
    ]).fit(train)
    return _stored(model, train)


def trend_report(model: PipelineModel, train: DataFrame, test: DataFrame, time: str) -> DataFrame:
    """Rows of both periods, test rows no later than a train row, accuracy on the test rows, and
    that of always saying what is more frequent there."""
    hits = (F.col("prediction") == F.col("label")).cast("double")
    rose = F.avg("label")
    end = train.select(F.max(time)).scalar()
    return model.transform(test).withColumn("_end", end).agg(
        F.count("*").alias("test_rows"),
        F.count_if(F.col(time) <= F.col("_end")).alias("leaks"),
        F.avg(hits).alias("accuracy"),
        F.greatest(rose, 1 - rose).alias("majority"),
    ).withColumn("train_rows", train.select(F.count("*")).scalar())
