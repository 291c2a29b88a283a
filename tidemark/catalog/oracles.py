"""The SQL counterparts of ``queries``, by the same names, in DuckDB's dialect."""

from __future__ import annotations

from tidemark.catalog import indicator_oracles

_PCT = "(value / nullif(lag(value) over w, 0) - 1) * 100"
_LOG = "case when 1 + {0} / 100 > 0 then ln(1 + {0} / 100) end"


def _features(rows: str, key: str, order: str, time: str, share: str) -> str:
    """CTEs ``changed`` and ``featured`` with the gold columns over ``rows``."""
    window = f"window w as (partition by {key} order by {order})"
    return f"""
    changed as (
        select *,
            {_PCT} as price_delta_pct,
            (epoch_us({time}::timestamp) - lag(epoch_us({time}::timestamp)) over w) / 60e6
                as minutes_since_last,
            avg(value) over (partition by {key} order by {order}
                rows between 2 preceding and current row) as price_sma_3,
            avg(value) over (partition by {key} order by {order}
                rows between 6 preceding and current row) as price_sma_7,
            {share} - lag({share}) over w as dominance_delta
        from {rows} {window}
    ), logged as (
        select *, {_LOG.format("price_delta_pct")} as observed_log_return from changed
    ), featured as (
        select *, stddev_samp(observed_log_return) over (partition by {key} order by {order}
            rows between 2 preceding and current row) as volatility_3
        from logged
    )"""


_EVENT_GOLD = """
    select event_id, user_id, value, price_delta_pct, minutes_since_last,
        round(observed_log_return, 6) as observed_log_return,
        round(price_sma_3, 6) as price_sma_3, round(price_sma_7, 6) as price_sma_7,
        round(volatility_3, 6) as volatility_3, dominance_delta
    from featured"""

_ON_EVENTS = "with " + _features("events", "user_id", "ts, event_id", "ts", "value")

_MERGED = """merged as (
    select event_id, ts, value, case when user_id % 3 = 0 then 0 else user_id end as user_id
    from events)"""

_DAILY = """daily as (
    select user_id, ts::date as day, last(value order by ts, event_id) as value,
        min(value) as low, max(value) as high, count(*) as n_events
    from events group by user_id, ts::date)"""

_DAILY_GOLD = f"with {_DAILY}, " + _features("daily", "user_id", "day", "day", "low")

_LATEST = "from featured where day = (select max(day) from featured)"

_PARTS_WINDOW = "window w as (partition by user_id order by ts, event_id)"


def _along(column: str, name: str) -> str:
    return f"select event_id, user_id, {column} as {name} from events {_PARTS_WINDOW}"


_LISTINGS = f"""{_DAILY}, listings as (
    select day,
        case user_id when 1 then 'USDT' when 2 then 'USDC' when 3 then 'DAI'
            else 'K' || user_id end as symbol,
        'key ' || user_id as name,
        (user_id % 10 + 1)::int as cmc_rank,
        n_events::double as circulating_supply,
        case when user_id % 4 <> 0 then high + 1000.0::double end as max_supply,
        case when user_id % 5 = 0 then low end as tvl_ratio,
        day || 'T00:00:00.000Z' as date_added,
        case when user_id % 7 = 0 then 'junk' else day || 'T10:30:00.250Z' end as last_updated,
        case when user_id % 3 = 0 then user_id end as platform_id,
        value as quote_USD_price,
        low - high as quote_USD_percent_change_1h,
        high - low as quote_USD_percent_change_24h,
        low as quote_USD_percent_change_7d,
        high * 1000.0::double as quote_USD_market_cap,
        high * n_events as quote_USD_volume_24h,
        low as quote_USD_market_cap_dominance,
        day || 'T10:30:00.250Z' as quote_USD_last_updated,
        day || 'T12:00:00+00:00' as collected_at,
        floor(user_id / 100)::int as page
    from daily)"""

_BRONZE = f"""with {_LISTINGS}
    select * exclude (day, page), day::varchar as snapshot_date from listings"""


def _moment(column: str) -> str:
    return f"try_cast(replace(replace({column}, 'Z', ''), '+00:00', '') as timestamp)"


# Symbols that are flagged as stablecoins.
STABLECOINS = ("USDT", "USDC", "BUSD", "DAI", "TUSD", "FRAX")

_SILVER_CTES = f"""{_LISTINGS}, silver as (
    select symbol, name, cmc_rank, circulating_supply, max_supply, tvl_ratio,
        {_moment("date_added")} as date_added, {_moment("last_updated")} as last_updated,
        platform_id, quote_USD_price, quote_USD_percent_change_1h, quote_USD_percent_change_24h,
        quote_USD_percent_change_7d, quote_USD_market_cap, quote_USD_volume_24h,
        quote_USD_market_cap_dominance,
        {_moment("quote_USD_last_updated")} as quote_USD_last_updated,
        {_moment("collected_at")} as collected_at,
        symbol in {STABLECOINS} as is_stablecoin,
        platform_id is not null as is_token,
        {_LOG.format("quote_USD_percent_change_1h")} as log_return_1h,
        {_LOG.format("quote_USD_percent_change_24h")} as log_return_24h,
        {_LOG.format("quote_USD_percent_change_7d")} as log_return_7d,
        quote_USD_volume_24h / nullif(quote_USD_market_cap, 0) as volume_to_mcap,
        circulating_supply / nullif(max_supply, 0) as supply_utilization,
        day::varchar as snapshot_date
    from listings
    where quote_USD_price > 0 and quote_USD_market_cap > 0)"""

_SILVER = f"""with {_SILVER_CTES}
    select * replace (round(log_return_1h, 6) as log_return_1h,
        round(log_return_24h, 6) as log_return_24h, round(log_return_7d, 6) as log_return_7d)
    from silver"""

_GOLD_CTES = f"""with {_SILVER_CTES}, priced as (
    select *, quote_USD_price as value, quote_USD_market_cap_dominance as share from silver),
    {_features("priced", "symbol", "collected_at", "collected_at", "share")}"""

_GOLD = f"""{_GOLD_CTES}
    select symbol, collected_at, quote_USD_price, price_delta_pct, minutes_since_last,
        round(observed_log_return, 6) as observed_log_return,
        round(price_sma_3, 6) as price_sma_3, round(price_sma_7, 6) as price_sma_7,
        round(volatility_3, 6) as volatility_3, dominance_delta
    from featured"""

_RAW_COIN = f"""with {_LISTINGS}
    select symbol, collected_at, replace(name, ' ', '-') as slug,
        circulating_supply::bigint as num_market_pairs from listings"""

_RAW_STATUS = f"""with {_LISTINGS}
    select distinct collected_at, page as elapsed,
        case when page % 2 = 1 then 1000 + page end as error_code,
        case when page % 2 = 1 then 'page ' || page end as error_message
    from listings"""

_LISTING_CHECKS = {
    "price_positive": "coalesce(quote_USD_price > 0, false)",
    "market_cap_positive": "coalesce(quote_USD_market_cap > 0, false)",
    "volume_non_negative": "coalesce(quote_USD_volume_24h >= 0, false)",
    "rank_in_range": "cmc_rank between 1 and 8",
    "collected_at_present": "collected_at is not null",
}

_CHECKED = f"""{_LISTINGS}, checked as (
    select * replace ({_moment("collected_at")} as collected_at), concat_ws(',', """ + ", ".join(
    f"case when not {holds} then '{name}' end" for name, holds in _LISTING_CHECKS.items()
) + """) as failed_checks from listings)"""

_CHECKS = [
    ("value_positive", "value > 0"),
    ("value_above_one", "value - 1 > 0"),
    ("value_non_negative", "value >= 0"),
    ("rank_in_range", "user_id % 12 between 1 and 10"),
    ("ts_present", "ts is not null"),
]


def _fails(name: str, condition: str) -> str:
    return f"""select '{name}' as "check",
        count(*) filter (where not coalesce({condition}, false)) = 0 as passed,
        count(*) filter (where not coalesce({condition}, false)) as failing_rows
    from events"""


def _unique(table: str, keys: str, name: str) -> str:
    return f"""select '{name}' as "check", coalesce(sum(n - 1), 0) = 0 as passed,
        coalesce(sum(n - 1), 0)::bigint as failing_rows
    from (select count(*) as n from {table} group by {keys})"""


_PROFILED = """profiled as (
    select event_id, nullif(event_type, 'error') as platform_id,
        case when value > 50 then value end as max_supply,
        case when value <= 100 then value end as tvl, ts
    from events)"""


def _nulls(column: str) -> str:
    return f"""select '{column}' as "column", count(*) - count({column}) as nulls,
        round((count(*) - count({column})) / count(*) * 100, 6) as pct from profiled"""


def _added(column: str) -> str:
    return f"""select '{column}' as "column", count({column}) as "values",
        count(*) as row_count, 13 as column_count from featured"""


_EVENT_COLUMNS = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
    ("event_type", "string"), ("value", "double"), ("props", "string"),
]

SQL: dict[str, str] = {
    "price_delta": _along(_PCT, "price_delta_pct"),
    "minutes_since_last": _along(
        "(epoch_us(ts) - lag(epoch_us(ts)) over w) / 60e6", "minutes_since_last"
    ),
    "observed_log_return": f"""
        with changed as (select event_id, user_id, {_PCT} as pct from events {_PARTS_WINDOW})
        select event_id, user_id, round({_LOG.format("pct")}, 6) as observed_log_return
        from changed""",
    "sma_3": """select event_id, user_id, round(avg(value) over (partition by user_id
        order by ts, event_id rows between 2 preceding and current row), 6) as price_sma_3
        from events""",
    "sma_7": """select event_id, user_id, round(avg(value) over (partition by user_id
        order by ts, event_id rows between 6 preceding and current row), 6) as price_sma_7
        from events""",
    "rolling_surface": """
        select event_id, user_id,
            case when count(value) over five >= 3 then max(value) over five end as max_5,
            case when count(value) over five >= 3 then min(value) over five end as min_5,
            round(case when count(value) over four >= 2 then sum(value) over four end, 6) as sum_4
        from events
        window five as (partition by user_id order by ts, event_id
                rows between 4 preceding and current row),
            four as (partition by user_id order by ts, event_id
                rows between 3 preceding and current row)""",
    "volatility_3": f"{_ON_EVENTS} select event_id, user_id, "
        "round(volatility_3, 6) as volatility_3 from featured",
    "gold_features": _ON_EVENTS + _EVENT_GOLD,
    "hot_key_features": f"with {_MERGED}, "
        + _features("merged", "user_id", "ts, event_id", "ts", "value") + _EVENT_GOLD,
    "rebased_series": """
        select event_id, user_id, value / nullif(first_value(value) over (
            partition by user_id order by ts, event_id), 0) * 100 as rebased
        from events where event_type <> 'error'""",
    "hot_key_rebased": f"""
        with {_MERGED}
        select event_id, user_id, value / nullif(first_value(value) over (
            partition by user_id order by ts, event_id), 0) * 100 as rebased
        from merged""",
    "first_difference": f"""
        with {_DAILY}, shares as (select *, low / nullif(high, 0) * 100 as share from daily)
        select user_id, day::varchar as day,
            share - lag(share) over (partition by user_id order by day) as dominance_delta
        from shares""",
    "latest_movers": f"{_DAILY_GOLD} "
        f"select user_id, value, price_delta_pct, minutes_since_last {_LATEST}",
    "latest_volatility": f"{_DAILY_GOLD} select user_id, value, "
        f"round(volatility_3, 6) as volatility_3 {_LATEST} and user_id not in (1, 2, 3)",
    "latest_dominance": f"{_DAILY_GOLD} select user_id, low, dominance_delta {_LATEST}",
    "key_history": f"""{_ON_EVENTS}
        select event_id, value, round(price_sma_3, 6) as price_sma_3,
            round(price_sma_7, 6) as price_sma_7, ts
        from featured
        where user_id = (select user_id from events group by user_id
            order by count(*) desc, user_id limit 1)""",
    "member_flag": """select event_id, coalesce(nullif(event_type, 'error')
        in ('view', 'click', 'error'), false) as is_member from events""",
    "not_null_flag":
        "select event_id, nullif(event_type, 'error') is not null as is_token from events",
    "pct_log_returns": f"""
        select l_orderkey, l_linenumber, l_partkey,
            round({_LOG.format("(l_discount * 100)")}, 6) as log_return_1h,
            round({_LOG.format("(l_tax * -100)")}, 6) as log_return_24h,
            round({_LOG.format("((l_tax - l_discount) * 2000)")}, 6) as log_return_7d
        from lineitem""",
    "safe_ratios": """
        select l_orderkey, l_linenumber, l_partkey,
            l_extendedprice / nullif(l_quantity, 0) as volume_to_mcap,
            l_tax / nullif(l_discount, 0) as supply_utilization
        from lineitem""",
    "parse_timestamps": """
        select event_id,
            try_cast(case when event_type = 'error' then 'junk' else ts::varchar end
                as timestamp) - interval 2 hour as lenient,
            ts as strict
        from events""",
    "dedup_first": """
        select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice
        from lineitem
        qualify row_number() over (partition by l_partkey, l_shipdate
            order by l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                l_discount, l_tax, l_returnflag, l_linestatus) = 1""",
    "dedup_counts": """
        select sum(n)::bigint as rows_before, count(*) as rows_after,
            sum(n - 1)::bigint as removed
        from (select count(*) as n from lineitem group by l_partkey, l_shipdate)""",
    "duplicate_keys": """
        select l_partkey, l_shipdate, count(*) as copies from lineitem
        group by l_partkey, l_shipdate having count(*) > 1""",
    "null_profile": f"with {_PROFILED} select * from ("
        + " union all ".join(
            _nulls(c) for c in ("event_id", "platform_id", "max_supply", "tvl", "ts")
        ) + ") where nulls > 0",
    "quality_checks": " union all ".join(
        [_fails(*c) for c in _CHECKS] + [_unique("events", "user_id, ts", "unique_user_id_ts")]
    ),
    "duplicate_check": _unique("lineitem", "l_partkey, l_shipdate", "unique_l_partkey_l_shipdate"),
    "quarantined_rows": "select event_id, failed_checks from (select event_id, concat_ws(',', "
        + ", ".join(
            f"case when not coalesce({condition}, false) then '{name}' end"
            for name, condition in _CHECKS
        ) + ") as failed_checks from events) where failed_checks <> ''",
    "enforced_rows": "select event_id, value from events",
    "data_overview": """
        select count(distinct user_id) as keys, count(distinct ts) as snapshots,
            min(ts) as first_time, max(ts) as last_time,
            (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 as span_minutes
        from events""",
    "snapshot_times": "select distinct o_orderdate from orders",
    "top_n_per_snapshot": """
        select o_orderkey, o_orderdate, o_totalprice, row_number() over (
            partition by o_orderdate order by o_totalprice desc, o_orderkey) as rank
        from orders qualify rank between 1 and 3""",
    "ranks_beyond_limit": """
        select l_returnflag, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey,
            row_number() over (partition by l_returnflag order by l_extendedprice desc,
                l_orderkey, l_linenumber, l_partkey, l_suppkey) as rank
        from lineitem qualify rank between 1001 and 3000""",
    "first_row": """select event_id, user_id, event_type, value, ts from events
        order by ts, event_id limit 1""",
    "table_profile": " union all ".join(
        f"select {i} as position, '{name}' as \"column\", '{dtype}' as dtype, "
        f"count(*) as row_count, {len(_EVENT_COLUMNS)} as column_count from events"
        for i, (name, dtype) in enumerate(_EVENT_COLUMNS)
    ),
    "new_columns": f"{_DAILY_GOLD} " + " union all ".join(
        _added(c) for c in (
            "price_delta_pct", "minutes_since_last", "observed_log_return", "price_sma_3",
            "price_sma_7", "volatility_3", "dominance_delta",
        )
    ),
    "json_flatten": "select event_id, (props::json ->> '$.k')::bigint as props_k from events",
    "json_explode": """
        select doc_id, len(lines) as n_lines, unnest(range(len(lines))) as place,
            unnest(lines) as line
        from (select doc_id, string_split(text, chr(10)) as lines from documents)""",
    "bronze_layer": _BRONZE,
    "audit_layer": f"""
        with {_LISTINGS}
        select 1 as credit_count, count(*) as total_count, page as elapsed,
            day || 'T12:00:00+00:00' as collected_at, 'landing/listings' as endpoint,
            count(*) as coins_returned, false as malformed
        from listings group by day, page""",
    "silver_layer": _SILVER,
    "gold_layer": _GOLD,
    "gold_movers": f"""{_GOLD_CTES}
        select symbol, quote_USD_price, price_delta_pct, minutes_since_last from featured
        where collected_at = (select max(collected_at) from featured)""",
    "cycle_counts": f"""
        with {_SILVER_CTES}, counted as (
            select 'bronze' as layer, count(*) as n from listings
            union all select 'silver', count(*) from silver
            union all select 'gold', count(*) from silver)
        select layer, n as new_rows, n as total_rows,
            (select count(distinct day) from daily) as snapshots
        from counted""",
    "silver_idempotent": _SILVER,
    "silver_compacted": _SILVER,
    "bronze_raw": _RAW_COIN,
    "bronze_wider": _RAW_COIN,
    "stream_bronze_raw": _RAW_COIN,
    "audit_errors": _RAW_STATUS,
    "stream_audit_errors": _RAW_STATUS,
    "first_arrival_lines": _SILVER,
    "first_arrival_files": _SILVER,
    "first_arrival_csv": _SILVER,
    "quarantine_layer": f"""with {_CHECKED}
        select symbol, collected_at, cmc_rank, failed_checks
        from checked, (select unnest([1, 2])) as twice where failed_checks <> ''""",
    "silver_checks": f"with {_CHECKED} " + " union all ".join(
        f"""select '{name}' as "check", not coalesce(bool_or(not {holds}), false) as passed,
            2 * count(*) filter (where not {holds}) as failing_rows from checked"""
        for name, holds in _LISTING_CHECKS.items()
    ) + """ union all select 'unique_symbol_collected_at', true, 0""",
    "silver_counts": f"""with {_CHECKED}, counted as (
            select count(*) as n, count(*) filter (where failed_checks = '') as good from checked)
        select 2 * n as rows_before, 2 * (n - good) as set_apart, good as removed,
            good as rows_after from counted""",
    "stream_retry": f"""
        with {_SILVER_CTES}
        select 'bronze' as layer, count(*) as n from listings
        union all select 'audit', count(*) from (select distinct day, page from listings)
        union all select 'silver', count(*) from silver
        union all select 'gold', count(*) from silver
        union all select 'late', 0""",
    "stream_late": _GOLD,
    "layer_roundtrip": "select *, (ts::date)::varchar as snapshot_date from events",
    "csv_by_name": "select * from events",
    "csv_export": f"""{_DAILY_GOLD}
        select user_id, day::varchar as day, value, price_delta_pct,
            round(price_sma_7, 6) as price_sma_7, round(volatility_3, 6) as volatility_3
        from featured""",
    "stream_bronze": _BRONZE,
    "stream_silver": _SILVER,
    "stream_gold": _GOLD,
    "stream_dedup": "select * from events",
}

SQL |= indicator_oracles.SQL | {
    "stream_gold_stateful": f"""{_GOLD_CTES}, base as (
            select *, case when not is_stablecoin then value / nullif(first_value(value)
                over (partition by symbol, is_stablecoin order by collected_at), 0) * 100 end
                as rebased
            from featured)
        select symbol, collected_at, price_delta_pct, minutes_since_last,
            round(observed_log_return, 6) as observed_log_return,
            round(price_sma_3, 6) as price_sma_3, round(price_sma_7, 6) as price_sma_7,
            round(volatility_3, 6) as volatility_3, dominance_delta, round(rebased, 6) as rebased
        from base""",
    "stream_keep_first": "select * from events",
    "payload_schema": f"""with {_LISTINGS}
        select 'slug' as field, 'STRING' as dtype, count(*) as present, count(*) as rows
        from listings
        union all select 'num_market_pairs', 'BIGINT', count(*), count(*) from listings""",
    "gold_wider": f"""{_GOLD_CTES}
        select symbol, collected_at, replace(name, ' ', '-') as slug,
            circulating_supply::bigint as num_market_pairs,
            round(price_sma_7, 6) as price_sma_7, dominance_delta
        from featured""",
    "malformed_payloads": f"""with {_LISTINGS}
        select false as malformed, null as raw_payload, count(*) as payloads
        from (select distinct day, page from listings)
        union all select true, '{{"status": {{"elapsed": ' || n_events
            || '}}, "data": [{{"symbol": "K' || user_id as t, count(*) from daily group by t""",
    "merged_overview": f"""with {_SILVER_CTES}
        select count(*) as rows, count(distinct symbol) as keys,
            count(distinct collected_at) as snapshots, min(collected_at) as first_time,
            max(collected_at) as last_time,
            (epoch_us(max(collected_at)) - epoch_us(min(collected_at))) // 60000000 as span_minutes
        from silver""",
    "key_clusters": """select count(distinct user_id) as keys, 4 as clusters, 0 as misassigned,
        true as cost_agrees from events""",
    "trend_check": f"""{_ON_EVENTS}, known as (
            select ts, price_delta_pct, lag(price_delta_pct) over w as c,
                lag(volatility_3) over w as v, lag(value / nullif(price_sma_7, 0)) over w as m
            from featured window w as (partition by user_id order by ts, event_id)
        ), rows as (
            select epoch_us(ts) as t from known
            where price_delta_pct is not null and c is not null and v is not null
                and m is not null
        ), border as (
            select min(t) + ((max(t) - min(t)) * 0.7::double)::bigint as b from rows)
        select count(*) filter (where t <= b) as train_rows,
            count(*) filter (where t > b) as test_rows, 0 as leaks, true as beats_majority
        from rows, border""",
}
