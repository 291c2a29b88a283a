"""Declared schemas of the raw payload and of the stored layers."""

from __future__ import annotations

from pyspark.sql import types as T


_TEXT, _NUMBER, _FLAG = T.StringType(), T.DoubleType(), T.BooleanType()
_INT, _LONG = T.IntegerType(), T.LongType()
_TIME, _DATE = T.TimestampType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Field and column names of the listings payload and the layers.
QUOTE = _struct(
    price=_NUMBER, percent_change_1h=_NUMBER, percent_change_24h=_NUMBER,
    percent_change_7d=_NUMBER, market_cap=_NUMBER, volume_24h=_NUMBER,
    market_cap_dominance=_NUMBER, last_updated=_TEXT,
)

COIN = _struct(
    symbol=_TEXT, name=_TEXT, cmc_rank=_INT,
    circulating_supply=_NUMBER, max_supply=_NUMBER, tvl_ratio=_NUMBER,
    date_added=_TEXT, last_updated=_TEXT,
    platform=_struct(id=_LONG), quote=_struct(USD=QUOTE),
)

STATUS = _struct(credit_count=_INT, total_count=_LONG, elapsed=_INT)


def _listing(time: T.DataType) -> dict[str, T.DataType]:
    return {
        "symbol": _TEXT, "name": _TEXT, "cmc_rank": _INT,
        "circulating_supply": _NUMBER, "max_supply": _NUMBER, "tvl_ratio": _NUMBER,
        "date_added": time, "last_updated": time, "platform_id": _LONG,
        "quote_USD_price": _NUMBER, "quote_USD_percent_change_1h": _NUMBER,
        "quote_USD_percent_change_24h": _NUMBER, "quote_USD_percent_change_7d": _NUMBER,
        "quote_USD_market_cap": _NUMBER, "quote_USD_volume_24h": _NUMBER,
        "quote_USD_market_cap_dominance": _NUMBER, "quote_USD_last_updated": time,
        "collected_at": time,
    }


# Where a row came from, in the order of arrival; every row has a place of its own.
ORIGIN = _struct(
    file_time=_TIME, source_file=_TEXT, block_start=_LONG, payload_place=_LONG,
    listing_position=_INT,
)

# ``raw_json`` and ``raw_status`` hold all fields as they came, also those not declared here, and
# ``raw_payload`` a payload that could not be parsed.
BRONZE = T.StructType([
    *_struct(**_listing(_TEXT), raw_json=_TEXT).fields, *ORIGIN.fields,
    T.StructField("snapshot_date", _DATE),
])

AUDIT = _struct(
    credit_count=_INT, total_count=_LONG, elapsed=_INT,
    raw_status=_TEXT, collected_at=_TEXT, endpoint=_TEXT, coins_returned=_INT,
    source_file=_TEXT, malformed=_FLAG, raw_payload=_TEXT, snapshot_date=_DATE,
)

SILVER = _struct(
    **_listing(_TIME),
    is_stablecoin=_FLAG, is_token=_FLAG,
    log_return_1h=_NUMBER, log_return_24h=_NUMBER, log_return_7d=_NUMBER,
    volume_to_mcap=_NUMBER, supply_utilization=_NUMBER,
    snapshot_date=_DATE,
)

# Names of time columns and of the features.
TIME_COLUMNS = ["collected_at", "last_updated", "quote_USD_last_updated", "date_added"]

GOLD_FEATURES = [
    "price_delta_pct", "minutes_since_last", "observed_log_return",
    "price_sma_3", "price_sma_7", "volatility_3", "dominance_delta",
]

GOLD = T.StructType(
    SILVER.fields + [T.StructField(name, _NUMBER) for name in GOLD_FEATURES]
)

SILVER_KEY = ["symbol", "collected_at"]


def with_more(schema: T.StructType, more: T.StructType | None) -> T.StructType:
    """The schema with further columns."""
    return schema if more is None else T.StructType([*schema.fields, *more.fields])


def further_fields(coin: T.StructType) -> T.StructType:
    """The columns that a wider ``coin`` schema adds to the layers, flat."""
    def flat(fields: T.StructType, prefix: str) -> list[T.StructField]:
        out = []
        for f in fields.fields:
            if isinstance(f.dataType, T.StructType):
                out += flat(f.dataType, f"{prefix}{f.name}_")
            else:
                out.append(T.StructField(f"{prefix}{f.name}", f.dataType))
        return out

    return T.StructType([f for f in flat(coin, "") if f.name not in BRONZE.names])


def with_batch(schema: T.StructType) -> T.StructType:
    """The schema as stored: each batch has its own directory, with one per date below.

    Directory columns come last and in directory order. A stream that starts on an
    empty table finds them by their place.
    """
    data = [f for f in schema.fields if f.name != "snapshot_date"]
    return T.StructType([*data, T.StructField("batch_id", _TEXT), schema["snapshot_date"]])
