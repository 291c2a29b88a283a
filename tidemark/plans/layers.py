"""The layers as lazy transforms; nothing here writes.

bronze: one row per listing per snapshot, as it came. silver: typed, flagged, enriched,
one row per (symbol, collected_at). gold: silver with features along each symbol's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar, series
from tidemark.operators.dedup import keep_first, keep_first_new
from tidemark.operators.history import (
    CutPoints, Timeline, carried_forward, first_value, key_aggregate, over_history,
)
from tidemark.operators.nested import array_length, explode_records, flatten_structs
from tidemark.sources.landing import RAW
from tidemark.sources.schemas import (
    AUDIT, BRONZE, COIN, ORIGIN, SILVER, SILVER_KEY, STATUS, TIME_COLUMNS,
)
from tidemark.sources.tables import conform

# Symbols that are flagged as stablecoins.
STABLECOINS = ("USDT", "USDC", "BUSD", "DAI", "TUSD", "FRAX")

# Percent column and the log return made of it.
LOG_RETURNS = {
    "quote_USD_percent_change_1h": "log_return_1h",
    "quote_USD_percent_change_24h": "log_return_24h",
    "quote_USD_percent_change_7d": "log_return_7d",
}

# sma_7 reads six rows back; volatility_3 reads three log returns, so three rows back.
GOLD_LOOK_BACK = 6


def date_of(time: str) -> Column:
    return F.to_date(scalar.parse_time(time))


_MISFIT = "_misfit"


def _is_text(payloads: DataFrame, column: str) -> bool:
    kind = payloads.schema[column].dataType
    return isinstance(getattr(kind, "elementType", kind), T.StringType)


def parsed(
    payloads: DataFrame, coin: T.StructType = COIN, status: T.StructType = STATUS
) -> DataFrame:
    """Payloads with their status and records typed, and the text of both kept beside.

    A value that does not fit its type is NULL, and its payload counts as malformed.
    """
    out = payloads
    if _is_text(out, "status"):
        out = out.withColumns({"raw_status": F.col("status"), "status": F.from_json("status", status)})
    if _is_text(out, "data"):
        fields = T.StructType([*coin.fields, T.StructField(_MISFIT, T.StringType())])
        options = {"columnNameOfCorruptRecord": _MISFIT}
        records = F.transform(
            "data",
            lambda text: F.struct(F.from_json(text, fields, options).alias("r"), text.alias("t")),
        )
        typed = F.transform(
            "data",
            lambda x: F.struct(
                *[x["r"][f.name].alias(f.name) for f in coin.fields], x["t"].alias("raw_json")
            ),
        )
        misfit = F.exists("data", lambda x: x["r"][_MISFIT].isNotNull())
        out = out.withColumn("data", records).withColumns({
            "malformed": F.col("malformed") | F.coalesce(misfit, F.lit(False)),
            "data": typed,
        })
    return out


def to_bronze(payloads: DataFrame, coin: T.StructType = COIN) -> DataFrame:
    """Flat rows of the records in ``data``; typed fields beyond the declared ones come last.

    Every record's text is kept in ``raw_json``, unless the reader has parsed it already.
    """
    origin = [c for c in ORIGIN.names if c in payloads.columns]
    typed = parsed(payloads.select("status", "data", "collected_at", "malformed", *origin), coin)
    records = explode_records(
        typed.select("collected_at", *origin, "data"), "data", "listing_position"
    )
    flat = flatten_structs(records).withColumn("snapshot_date", date_of("collected_at"))
    extra = [c for c in flat.columns if c not in BRONZE.names]
    declared = [
        (F.col(f.name) if f.name in flat.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in BRONZE.fields
    ]
    return flat.select(*declared, *extra)


def to_audit(payloads: DataFrame, endpoint: str, status: T.StructType = STATUS) -> DataFrame:
    """One row per payload, also for one that is malformed or without records."""
    typed = parsed(payloads, status=status)
    if "raw_status" not in typed.columns:
        typed = typed.withColumn("raw_status", F.lit(None).cast("string"))
    if RAW not in typed.columns:
        typed = typed.withColumn(RAW, F.lit(None).cast("string"))
    rows = typed.select(
        "status.*",
        "raw_status",
        "collected_at",
        F.lit(endpoint).alias("endpoint"),
        array_length("data").alias("coins_returned"),
        "source_file",
        "malformed",
        RAW,
        date_of("collected_at").alias("snapshot_date"),
    )
    flat = flatten_structs(rows)
    extra = [c for c in flat.columns if c not in AUDIT.names]
    return flat.select(*AUDIT.names, *extra)


def clean(bronze: DataFrame) -> DataFrame:
    """Types, flags, log returns and ratios; row by row, for batches and streams alike."""
    numbers = [f.name for f in BRONZE.fields if f.dataType.typeName() == "double"]
    typed = bronze.withColumns(
        {
            **{c: scalar.parse_time(c) for c in TIME_COLUMNS if c in bronze.columns},
            **{c: scalar.nan_to_null(c) for c in numbers if c in bronze.columns},
        }
    )
    return typed.withColumns(
        {
            "is_stablecoin": scalar.member_flag("symbol", STABLECOINS),
            "is_token": scalar.present_flag("platform_id"),
            **{out: scalar.log_return(pct) for pct, out in LOG_RETURNS.items()},
            "volume_to_mcap": scalar.ratio("quote_USD_volume_24h", "quote_USD_market_cap"),
            "supply_utilization": scalar.ratio("circulating_supply", "max_supply"),
            "snapshot_date": F.to_date("collected_at"),
        }
    )


# Where a row came from decides which copy is first.
ARRIVAL = ORIGIN.names


def to_silver(bronze: DataFrame, schema: T.StructType = SILVER) -> DataFrame:
    """Clean rows, the first arrival of each (symbol, collected_at)."""
    return conform(keep_first(clean(bronze), SILVER_KEY, ARRIVAL), schema)


def silver_increment(
    cleaned: DataFrame, stored: DataFrame, schema: T.StructType = SILVER
) -> DataFrame:
    """First arrivals among clean rows whose key ``stored`` does not hold."""
    return conform(keep_first_new(cleaned, stored, SILVER_KEY, ARRIVAL), schema)


def add_features(
    df: DataFrame,
    w: WindowSpec,
    timeline: Timeline,
    value: str = "quote_USD_price",
    share: str | None = "quote_USD_market_cap_dominance",
    change_of: str | None = None,
) -> DataFrame:
    """The gold columns for one window over a key's history.

    ``change_of`` names the column to take percent changes of, if not ``value`` itself.
    """
    price, masked = F.col(value), timeline.masked
    columns = {
        "price_delta_pct": masked(series.pct_change(F.col(change_of or value), w)),
        "minutes_since_last": masked(series.minutes_since_last(F.col(timeline.time), w)),
        "price_sma_3": masked(series.rolling(price, 3, w)),
        "price_sma_7": masked(series.rolling(price, 7, w)),
    }
    if share is not None:
        columns["dominance_delta"] = masked(series.difference(F.col(share), w))
    features = df.withColumns(columns).withColumn(
        "observed_log_return", scalar.log_return("price_delta_pct")
    )
    spread = series.volatility(F.col("observed_log_return"), 3, w)
    return features.withColumn("volatility_3", masked(spread))


def to_gold(
    silver: DataFrame,
    timeline: Timeline = Timeline(),
    value: str = "quote_USD_price",
    share: str | None = "quote_USD_market_cap_dominance",
    cuts: CutPoints | None = None,
    fill: bool = False,
) -> DataFrame:
    """Silver rows with their features, all from one shuffle by key (and part).

    ``fill`` carries values forward over missing ones for percent changes and what is made of
    them: a change is then measured from the last value there was, however far back.
    """
    reads = [value] if share is None else [value, share]
    filled = "_filled" if fill else None
    if filled:
        silver, reads = carried_forward(silver, value, timeline, filled, cuts), [*reads, filled]
    gold = over_history(
        silver,
        lambda df, w: add_features(df, w, timeline, value, share, filled),
        timeline,
        GOLD_LOOK_BACK,
        reads,
        cuts,
    )
    return gold.drop(filled) if filled else gold


def rebased(
    silver: DataFrame,
    timeline: Timeline = Timeline(),
    value: str = "quote_USD_price",
    flag: str | None = "is_stablecoin",
    out: str = "rebased",
    cuts: CutPoints | None = None,
) -> DataFrame:
    """``value`` as percent of the key's first one, without the flagged rows."""
    rows = silver if flag is None else silver.filter(~F.col(flag))
    base = first_value(value, timeline, rows)
    based = key_aggregate(rows, base, timeline, "_first", cuts)
    return based.withColumn(out, scalar.ratio(value, "_first") * 100).drop("_first")
