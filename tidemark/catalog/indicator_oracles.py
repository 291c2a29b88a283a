"""SQL of the indicators: recursion row by row, and frames."""

from __future__ import annotations


def _rows(hot: bool, gappy: bool = True) -> str:
    """``r``: events numbered along their keys' histories."""
    user = "case when user_id % 3 = 0 then 0 else user_id end" if hot else "user_id"
    value = "case when event_type <> 'error' then value end" if gappy else "value"
    return f"""g as (
        select event_id, ts, {user} as user_id, {value} as value from events
    ), r as materialized (
        select *, row_number() over (partition by user_id order by ts, event_id) as n from g)"""


def _ema(hot: bool) -> str:
    def step(average: str, span: int, value: str = "r.value") -> str:
        alpha = f"(2.0::double / {span + 1})"
        return f"""case when r.value is null then {average} when {average} is null then {value}
            else (1 - {alpha}) * {average} + {alpha} * ({value}) end"""

    fast, slow = step("e.f", 12), step("e.s", 26)
    return f"""
        with recursive {_rows(hot)}, e as (
            select event_id, user_id, n, value as f, value as s, value - value as sig
            from r where n = 1
            union all
            select event_id, user_id, n, f, s,
                case when value is null then sig when sig is null then f - s
                    else 0.8::double * sig + 0.2::double * (f - s) end
            from (select r.event_id, r.user_id, r.n, r.value, {fast} as f, {slow} as s, e.sig
                from e join r on r.user_id = e.user_id and r.n = e.n + 1))
        select event_id, user_id, round(f, 6) as ema_fast, round(s, 6) as ema_slow,
            round(f - s, 6) as macd, round(sig, 6) as macd_signal,
            round(f - s - sig, 6) as macd_histogram
        from e"""


def _rsi(hot: bool, gappy: bool) -> str:
    return f"""
        with recursive {_rows(hot, gappy)}, d as (
            select event_id, user_id, n,
                value - lag(value) over (partition by user_id order by n) as c from r
        ), c as materialized (
            select *, case when c is not null then greatest(c, 0) end as g,
                case when c is not null then greatest(-c, 0) end as l,
                count(c) over (partition by user_id order by n) as k
            from d
        ), seed as (
            select user_id, min(n) filter (where k = 14) as n,
                sum(g) filter (where k <= 14) / 14 as g, sum(l) filter (where k <= 14) / 14 as l
            from c group by user_id having max(k) >= 14
        ), e as (
            select * from seed
            union all
            select c.user_id, c.n,
                case when c.c is null then e.g else e.g * 13 / 14 + c.g / 14 end,
                case when c.c is null then e.l else e.l * 13 / 14 + c.l / 14 end
            from e join c on c.user_id = e.user_id and c.n = e.n + 1)
        select c.event_id, c.user_id, round(100 * e.g / nullif(e.g + e.l, 0), 6) as rsi
        from c left join e on c.user_id = e.user_id and c.n = e.n"""


def _filled(hot: bool) -> str:
    return f"""{_rows(hot)}, filled as (
            select *, last_value(value ignore nulls) over (partition by user_id order by n) as v
            from r
        ), changed as (
            select *, (v / nullif(lag(v) over (partition by user_id order by n), 0) - 1) * 100
                as pct
            from filled)"""


SQL: dict[str, str] = {
    "ema_surface": _ema(hot=False),
    "hot_key_ema": _ema(hot=True),
    "wilder_rsi": _rsi(hot=False, gappy=False),
    "hot_key_rsi": _rsi(hot=True, gappy=True),
    "bollinger_bands": f"""
        with {_rows(hot=False)}, b as (
            select event_id, user_id, count(value) over w as k, avg(value) over w as m,
                stddev_pop(value) over w as s
            from r window w as (partition by user_id order by n
                rows between 9 preceding and current row))
        select event_id, user_id, case when k >= 10 then round(m, 6) end as band_middle,
            case when k >= 10 then round(m - s * 2, 6) end as band_low,
            case when k >= 10 then round(m + s * 2, 6) end as band_high
        from b""",
    "anomaly_flags": f"""
        with {_rows(hot=False)}, b as (
            select *, case when count(value) over w >= 5 then
                (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) end as z
            from r window w as (partition by user_id order by n
                rows between 20 preceding and 1 preceding))
        select event_id, user_id, round(z, 6) as z_score, coalesce(abs(z) > 2, false) as is_anomaly
        from b""",
    "filled_changes": f"""
        with {_filled(hot=False)}
        select event_id, user_id, round(pct, 6) as price_delta_pct from changed""",
    "hot_key_filled": f"""
        with {_filled(hot=True)}, logged as (
            select *, case when 1 + pct / 100 > 0 then ln(1 + pct / 100) end as lr from changed)
        select event_id, user_id, round(pct, 6) as price_delta_pct,
            round(lr, 6) as observed_log_return,
            round(stddev_samp(lr) over w, 6) as volatility_3,
            round(avg(value) over w, 6) as price_sma_3
        from logged window w as (partition by user_id order by n
            rows between 2 preceding and current row)""",
}
