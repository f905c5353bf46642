"""The same results in SQL on the supplied tables."""

from __future__ import annotations

from tidemark import schemas

BARS = """
    e as (select 'U' || user_id as symbol, cast(ts as date) as day, ts as t, value from events),
    bars as (select symbol, day as ts, arg_min(value, t) as open, max(value) as high,
                    min(value) as low, arg_max(value, t) as close, count(*) as volume
             from e group by symbol, day)"""


def ret(value: str, previous: str) -> str:
    return (
        f"case when {previous} = 0 then {value} * cast('inf' as double) "
        f"else {value} / {previous} end - 1.0"
    )


def lag_return(source: str, name: str, extra: str = "*") -> str:
    return f"""
    {name}_l as (select *, lag(close) over (partition by symbol order by ts) as p from {source}),
    {name} as (select * exclude (p), {ret("close", "p")} as close_returns from {name}_l)"""


RETURNS = BARS + "," + lag_return("bars", "r")

MACRO = """
    m as (select lower(o_orderpriority) as series, cast(o_orderdate as date) as ts,
                 case when o_orderstatus = 'P' then null else o_totalprice end as value,
                 o_orderkey as position from orders)"""

FACTS = """
    l as (select 'S' || l_suppkey as ticker, l_returnflag || ':' || l_linestatus as concept,
                 'USD' as unit, cast(l_shipdate as date) as period_end,
                 cast(l_shipdate as date) - 90 as period_start,
                 cast(year(l_shipdate) as bigint) as fy,
                 case when l_linenumber <= 4 then 'Q' || l_linenumber end as fp,
                 case when l_discount < 0.05 then '10-K' end as form,
                 l_extendedprice as val, l_orderkey || '-' || l_partkey as accn,
                 cast(l_shipdate as date) + cast(l_orderkey % 400 as int) as filed,
                 l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax
          from lineitem)"""

FACT_COLUMNS = (
    "ticker, concept, unit, period_start, period_end, fy, fp, form, val, accn, filed"
)


def latest_facts(filed: str, name: str, order: str) -> str:
    return f"""
    {name} as (select ticker, concept, unit, period_start, period_end, fy,
                      coalesce(fp, 'UNK') as fp, coalesce(form, 'UNK') as form, val, accn,
                      {filed} as filed
               from l
               qualify row_number() over (
                   partition by ticker, concept, unit, period_end,
                                coalesce(fp, 'UNK'), coalesce(form, 'UNK')
                   order by {order}) = 1)"""


LINE_ORDER = """l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc,
                l_quantity desc, l_tax desc"""
KNOWN_FILED = "case when fp is not null then filed end"
FACTS_LATEST = FACTS + "," + latest_facts(
    KNOWN_FILED, "f", f"({KNOWN_FILED}) desc nulls last, {LINE_ORDER}"
)
FACTS_FLAT = FACTS + "," + latest_facts("filed", "f", f"filed desc, {LINE_ORDER}")

FIGI = """
    c as (select 'S' || l_suppkey as ticker, 'BBG' || lpad(p_partkey::varchar, 9, '0') as figi,
                 p_brand as composite_figi, p_type as share_class_figi,
                 'Common Stock' as security_type, 'Equity' as market_sector,
                 'X' || p_size as exch_code, p_name || ' ' || l_orderkey as name,
                 l_orderkey as position
          from lineitem join part on l_partkey = p_partkey),
    g as (select * from c qualify row_number() over (
              partition by ticker, figi order by position desc) = 1)"""
FIGI_COLUMNS = """ticker, figi, composite_figi, share_class_figi, security_type, market_sector,
                  exch_code, name"""

COMPANY = FACTS.replace("'USD' as unit", "case when l_linenumber % 2 = 0 then 'shares' else 'USD' end as unit")


def typed(vendor: str, schema) -> str:
    return ", ".join(f"('{vendor}', '{f.name}', '{f.dataType.simpleString()}')" for f in schema)


SEGMENTS = "('MACHINERY', 'BUILDING')"
INSTRUMENTS = f"""
    i as (select c_custkey as position, upper(c_name) as ticker, c_name as name,
                 n_name as exchange, 'USD' as currency, 'America/New_York' as timezone,
                 c_acctbal >= 0 as is_active, c_mktsegment in {SEGMENTS} as is_scheduled
          from customer left join nation on c_nationkey = n_nationkey),
    reg as (select cast(position + 1 as int) as id, ticker, name, exchange, currency, timezone,
                   is_active, is_scheduled, '2024-01-01 00:00:00' as created_at,
                   '2024-01-01 00:00:00' as updated_at from i)"""
INSTRUMENT_COLUMNS = "id, ticker, name, exchange, currency, timezone, is_active, is_scheduled"

SYMBOLS = "(select 'U' || c_custkey from customer where c_acctbal >= 0)"
SUPPLIERS = "(select 'S' || s_suppkey from supplier where s_acctbal >= 0)"

FLAWED = (
    BARS
    + """,
    once as (select symbol, ts, open, case when volume = 4 then low - 1 else high end as high,
                    case when volume = 2 then -low else low end as low,
                    case when volume <> 3 then close end as close,
                    case when volume = 1 then -volume else volume end as volume, volume as n
             from bars),
    flawed as (select * from once union all select * from once where volume >= 5),
    spread as (select *, count(*) over (partition by symbol, ts) as copies,
                      row_number() over (partition by symbol, ts) as copy from flawed)"""
)


def quality(by: str) -> str:
    group = f"group by {by}" if by else ""
    key = f"{by}, " if by else ""
    return f"""
    with {FLAWED},
    q as (select {key} count(*) as row_count, count(*) filter (copy > 1) as duplicate_keys,
                 count(*) filter (close is null) as null_close,
                 count(*) filter (close < 0 or open < 0 or high < 0 or low < 0) as negative_price,
                 count(*) filter (volume < 0) as negative_volume,
                 count(*) filter (high < low or high < close or low > close) as bad_ohlc
          from spread {group})
    select *,
           case when row_count = 0 then 'empty'
                when duplicate_keys > 0 then 'duplicate_keys'
                when null_close / row_count > 0.05 then 'null_close'
                when negative_price > 0 then 'negative_price'
                when negative_volume > 0 then 'negative_volume' end as broken,
           concat_ws('; ',
               case when null_close > 0 then null_close || ' rows without a close' end,
               case when bad_ohlc > 0
                    then bad_ohlc || ' rows with high, low and close out of order' end) as warnings
    from q"""


MARKS = (
    BARS
    + """,
    held as (select 'yahoo' as source, 'prices_1d' as dataset, symbol as ticker,
                    max(ts) as last_ts, 'r' || strftime(max(ts), '%d') as last_run_id
             from bars group by symbol),
    late as (select symbol as ticker, max(ts) as last_ts,
                    'b' || strftime(max(ts), '%d') as last_run_id
             from bars where day(ts) % 2 = 0 group by symbol)"""
)


def mark_upsert(takes_late: str) -> str:
    return f"""
    with {MARKS}
    select 'yahoo' as source, 'prices_1d' as dataset, ticker,
           case when {takes_late} then late.last_ts else held.last_ts end as last_ts,
           case when {takes_late} then late.last_run_id else held.last_run_id end as last_run_id,
           case when late.ticker is not null then '2024-02-01 16:05:00'
                else '2024-01-20 16:05:00' end as updated_at
    from held full join late using (ticker)"""


def gold_prices(source: str) -> str:
    """Both fetches loaded; the second is the later one from the 15th on."""
    return f"""
    select symbol, ts, open, high, low, close, volume, cast(null as double) as dividends,
           cast(null as double) as stock_split, close_returns, 'yahoo' as source,
           cast(null as varchar) as run_id,
           case when ts >= date '2024-01-15' then '2024-02-01 16:05:00'
                else '2024-01-20 16:05:00' end as ingested_at
    from {source}"""


SPLIT = """
    lo as (select * from bars where ts < date '2024-01-15'),
    hi as (select * from bars where ts >= date '2024-01-15')"""

REGISTERED_INFO = "c_mktsegment not in ('FURNITURE', 'HOUSEHOLD')"

BACKFILLED = f"""
    {BARS},
    windows(ws, we) as (values (date '2023-01-10', date '2024-01-10'),
                               (date '2024-01-11', date '2024-01-31')),
    s as (select 'U' || c_custkey as symbol, c_custkey % 10 as digit,
                 (row_number() over (order by c_custkey) - 1) // 5 as batch_no from customer),
    n as (select batch_no, count(*) as total from s group by batch_no),
    d as (select batch_no, ws, count(distinct symbol) as seen, count(*) as rows,
                 bool_or(digit = 7) as stopped
          from bars join s using (symbol) join windows on ts between ws and we
          where digit not in (4, 5, 6) group by batch_no, ws),
    c as (select batch_no, ws, total, coalesce(stopped, false) as stopped,
                 case when stopped then 0 else coalesce(seen, 0) end as ok,
                 case when stopped then 0 else coalesce(rows, 0) end as rows
          from n cross join windows left join d using (batch_no, ws)),
    chunks as (select batch_no, ws as window_start, cast(total as int) as items_total,
                      case when stopped then 'failed' when ok = 0 or ok = total then 'success'
                           else 'partial' end as status,
                      cast(ok as int) as items_success, cast(total - ok as int) as items_failed, rows
               from c)"""

ORACLE: dict[str, str] = {
    "bars_returns": f"with {RETURNS} select * from r",
    "bars_returns_zero_prev": f"""
        with {BARS},
        z as (select symbol, ts, case when volume = 1 then 0.0::double else close end as close
              from bars), {lag_return("z", "r")}
        select * from r""",
    "returns_by_event_type": f"""
        with p as (select event_id, event_type, value,
                          lag(value) over (partition by event_type order by ts) as p from events)
        select event_id, event_type, {ret("value", "p")} as value_returns from p""",
    "returns_batch_scope": f"""
        with {BARS}, {SPLIT}, {lag_return('lo', 'r')}, {lag_return('hi', 'q')}
        select * from r union all select * from q""",
    "returns_history_scope": f"""
        with {BARS}, {SPLIT},
        u as (select * replace (close * 2 as close) from lo union all select * from hi),
        {lag_return("u", "r")}
        select * from r where ts >= date '2024-01-15'""",
    "dedup_keep_last": f"""
        with {MACRO}
        select series, ts, coalesce(value::varchar, '.') as value, position from m
        qualify row_number() over (partition by series, ts order by position desc) = 1""",
    "facts_latest_filed": f"with {FACTS_LATEST} select * from f",
    "prices_normalize": f"""
        with {BARS} select symbol, ts, open, high, low, close, volume,
                           '20240201160500Z' as bronze_run_id from bars""",
    "failed_symbols": """
        select distinct '20240201160500Z' as bronze_run_id, 'U' || user_id || 'X' as symbol,
               'no_rows_returned' as error from events""",
    "macro_normalize": f"""
        with {MACRO} select series, ts, value from m where value is not null
        qualify row_number() over (partition by series, ts order by position desc) = 1""",
    "facts_flatten": f"with {FACTS_FLAT} select {FACT_COLUMNS} from f",
    "figi_flatten": f"with {FIGI} select {FIGI_COLUMNS} from g",
    "info_normalize": f"""
        select 'U' || c_custkey as ticker,
               case when c_mktsegment = 'MACHINERY' then c_name || ' Inc.' else c_name end as name,
               case when c_mktsegment <> 'BUILDING' then 'NYQ' end as exchange,
               'EQUITY' as quote_type, 'America/New_York' as timezone, 'USD' as currency
        from customer where {REGISTERED_INFO}""",
    "info_rejects": f"""
        select 'U' || c_custkey as ticker,
               case when c_mktsegment = 'FURNITURE' then 'unknown ticker'
                    else 'missing required field currency' end as reason
        from customer where not ({REGISTERED_INFO})""",
    "envelope_rejects": """
        select strftime(to_timestamp(1700000000 + o_orderkey) at time zone 'UTC',
                        '%Y%m%d%H%M%SZ') as run_id,
               'missing meta.partitions.series' as reason
        from orders where o_orderpriority in ('1-URGENT', '5-LOW')""",
    "envelope_meta": """
        select lower(trim('V' || c_mktsegment)) as vendor, 'data' as dataset,
               strftime(date '2024-01-01' + c_nationkey, '%Y-%m-%d') as dt,
               strftime(to_timestamp(1700000000 + c_custkey) at time zone 'UTC',
                        '%Y%m%d%H%M%SZ') as run_id,
               ' V' || c_mktsegment as source,
               case when c_mktsegment in ('MACHINERY', 'BUILDING') then c_nationkey else 1 end
                   as record_count,
               1 as n_partitions, c_name as symbol, c_custkey::varchar as number
        from customer""",
    "bronze_round_trip": f"""
        with {BARS}
        select symbol || ',' || symbol || 'X' as symbols, '2024-02-01' as dt,
               cast(count(*) + 3 as int) as n_rows, strftime(min(ts), '%Y-%m-%d') as start,
               strftime(max(ts), '%Y-%m-%d') as end
        from bars group by symbol, date_trunc('month', ts)""",
    "silver_round_trip": f"""
        with {BARS} select *, 'run1' as run_id, strftime(ts, '%Y-%m-01') as dt from bars""",
    "wide_panel_long": """
        select cast(ts as date) as ts, arg_min(value, (ts, event_id)) as open, max(value) as high,
               min(value) as low, arg_max(value, (ts, event_id)) as close,
               cast(count(*) as double) as volume, event_type as symbol
        from events where event_type <> 'view' or day(ts) % 3 <> 0
        group by cast(ts as date), event_type""",
    "cik_lookup": """
        select c_custkey, 'S' || c_custkey as ticker,
               lpad((case when s_acctbal >= 0 then s_suppkey + 320193 else s_suppkey end)::varchar,
                    10, '0') as cik
        from customer left join supplier on c_custkey = s_suppkey""",
    "series_lookup": """
        with s as (select o_orderkey as position,
                          case o_orderpriority when '1-URGENT' then 'cpi' when '2-HIGH' then 'usd/cad'
                               when '3-MEDIUM' then 'interest_rate_10y'
                               else lower(o_orderpriority) end as series from orders)
        select position, series, series_id from s left join
            (values ('cpi', 'CPIAUCSL'), ('usd/cad', 'DEXCAUS'), ('interest_rate_10y', 'GS10'))
            as v(code, series_id) on series = code""",
    "figi_unwrap": """
        select s_suppkey,
               case when s_nationkey <> 0 and s_acctbal >= 0 then s_name end as figi,
               case when s_nationkey <> 0 and s_acctbal < 0 then 'No identifier found.' end as error
        from supplier""",
    "quality_report": quality(""),
    "quality_report_by_symbol": quality("symbol"),
    "upsert_prices": f"""
        with {RETURNS}, {SPLIT}, {lag_return("hi", "b")},
        s as (select * from r where ts < date '2024-01-20')
        select symbol, ts, case when b.ts is null then s.open else b.open + 1 end as open,
               coalesce(b.high, s.high) as high, coalesce(b.low, s.low) as low,
               coalesce(b.close, s.close) as close, coalesce(b.volume, s.volume) as volume,
               case when b.ts is null then 0.5::double end as dividends,
               case when b.ts is null then 2.0::double end as stock_split,
               case when b.ts is null then s.close_returns else b.close_returns end as close_returns,
               case when s.ts is null then 'yahoo' else 'manual' end as source,
               case when b.ts is null then 'old' end as run_id,
               case when b.ts is null then '2024-01-20 16:05:00'
                    else '2024-02-01 16:05:00' end as ingested_at
        from s full join b using (symbol, ts)""",
    "upsert_macro": f"""
        with {MACRO},
        d as (select series, ts, value from m
              qualify row_number() over (partition by series, ts order by position desc) = 1)
        select series, ts, case when ts >= date '1998-01-01' then value + 1 else value end as value,
               case when ts < date '1999-01-01' then 'manual' else 'fred' end as source,
               case when ts >= date '1998-01-01' then 'new' else 'old' end as run_id,
               case when ts >= date '1998-01-01' then '2024-02-01 16:05:00'
                    else '2024-01-20 16:05:00' end as ingested_at
        from d""",
    "upsert_facts": f"""
        with {FACTS_LATEST}
        select ticker, concept, unit, period_end, fp, form, fy, period_start,
               case when period_end >= date '1998-01-01' then val + 1 else val end as val, accn,
               case when period_end >= date '1998-01-01' then filed - 1000 else filed end as filed,
               case when period_end < date '1999-01-01' then 'manual' else 'sec_edgar' end as source,
               case when period_end < date '1999-01-01' then 'old' end as run_id,
               case when period_end >= date '1998-01-01' then '2024-02-01 16:05:00'
                    else '2024-01-20 16:05:00' end as ingested_at
        from f""",
    "upsert_figi": f"""
        with {FIGI},
        w as (select *, share_class_figi <> 'ECONOMY' as stored,
                     share_class_figi <= 'PROMO' as batch from g)
        select ticker, figi, composite_figi, share_class_figi, security_type, market_sector,
               exch_code, case when batch then upper(name) else name end as name,
               case when stored then 'manual' else 'openfigi' end as source,
               case when stored then 'old' end as run_id,
               case when batch then '2024-02-01 16:05:00' else '2024-01-20 16:05:00' end
                   as ingested_at
        from w where stored or batch""",
    "watermark_advance": f"with {MARKS} select * from held",
    "upsert_watermark": mark_upsert("late.ticker is not null"),
    "upsert_watermark_monotonic": mark_upsert("late.last_ts >= held.last_ts"),
    "resolve_start_prices": f"""
        with {MARKS}
        select 'U' || c_custkey as ticker, coalesce(last_ts + 1, date '2015-01-01') as start
        from customer left join held on held.ticker = 'U' || c_custkey""",
    "resolve_batch_start": f"with {MARKS} select min(last_ts) + 1 as start from held",
    "resolve_start_macro": f"""
        with {MACRO}
        select series as ticker,
               case when series = '5-low' then date '2015-01-01' else max(ts) end as start
        from m group by series""",
    "resolve_start_facts": f"""
        with {FACTS}
        select ticker, case when ticker in {SUPPLIERS} then max(period_end)
                            else date '2024-02-01' end as start
        from l group by ticker""",
    "run_ledger_state": """
        select o_orderkey::varchar as run_id, lower(o_orderpriority) as dataset,
               cast(o_orderdate as date) as run_date,
               case o_orderstatus when 'F' then 'success' when 'O' then 'partial'
                    else 'running' end as status,
               case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice) as int) end
                   as items_total,
               case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice) as int) - 7 end
                   as items_success,
               case when o_orderstatus = 'P' then 0 else 7 end as items_failed,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as started_at,
               case when o_orderstatus <> 'P'
                    then strftime(o_orderdate + interval 1 hour, '%Y-%m-%d %H:%M:%S') end
                   as finished_at,
               case when o_orderstatus <> 'P' then repeat('note ', 120) end as notes
        from orders""",
    "run_ledger_unknown": """
        select o_orderkey::varchar as run_id from orders where o_orderstatus = 'P'""",
    "run_status": """
        with o as (select o_custkey, count(*) as n from orders group by o_custkey),
        k as (select c_nationkey, count(*) as items_total,
                     count(*) filter (n is null) as items_failed, coalesce(sum(n), 0) as rows
              from customer left join o on c_custkey = o_custkey group by c_nationkey)
        select c_nationkey, items_total, items_total - items_failed as items_success, items_failed,
               case when rows = 0 or items_failed = 0 then 'success' else 'partial' end as status
        from k""",
    "registry_create": f"""
        with {INSTRUMENTS},
        known as (select * replace (false as is_scheduled) from reg where is_active)
        select * from known
        union all
        select cast((select coalesce(max(id), 0) from known)
                    + row_number() over (order by position) as int) as id,
               ticker, lower(name) as name, exchange, currency, timezone, is_active, is_scheduled,
               '2024-02-01 16:05:00' as created_at, '2024-02-01 16:05:00' as updated_at
        from i where not is_active""",
    "registry_set_scheduled": f"""
        with {INSTRUMENTS},
        changes as (select upper(c_name) as ticker, c_acctbal > 5000 as wanted from customer
                    where c_custkey in (select o_custkey from orders))
        select id, ticker, name, exchange, currency, timezone, is_active,
               coalesce(wanted, is_scheduled) as is_scheduled, created_at,
               case when wanted <> is_scheduled then '2024-02-01 16:05:00' else updated_at end
                   as updated_at
        from reg left join changes using (ticker)""",
    "scheduled_universe": f"""
        with {INSTRUMENTS} select ticker from reg where is_active and is_scheduled""",
    "instruments_list": f"""
        with {INSTRUMENTS} select {INSTRUMENT_COLUMNS} from reg
        where is_active and not is_scheduled order by ticker""",
    "instrument_lookup": f"""
        with {INSTRUMENTS} select {INSTRUMENT_COLUMNS} from reg
        where ticker = 'CUSTOMER#000000007'""",
    "prices_serve": f"""
        with {RETURNS}
        select symbol, ts, open, high, low, close, volume, close_returns from r
        where symbol = 'U7' and symbol in {SYMBOLS}
          and ts between date '2024-01-05' and date '2024-01-25'
        order by ts limit 500""",
    "prices_serve_topk_per_symbol": f"""
        with {RETURNS}
        select symbol, ts, open, high, low, close, volume, close_returns from r
        where symbol in {SYMBOLS}
        qualify row_number() over (partition by symbol order by ts) <= 10""",
    "prices_unregistered": f"with {BARS} select * from bars where symbol not in {SYMBOLS}",
    "facts_serve": f"""
        with {FACTS_LATEST}
        select ticker, concept, unit, period_end, fy, fp, form, val from f
        where ticker = 'S7' and concept = 'A:F' and ticker in {SUPPLIERS}
        order by period_end desc, concept, unit, fp, form limit 500""",
    "facts_serve_topk_per_ticker": f"""
        with {FACTS_LATEST}
        select ticker, concept, unit, period_end, fy, fp, form, val from f
        where ticker in {SUPPLIERS}
        qualify row_number() over (partition by ticker
            order by period_end desc, concept, unit, fp, form) <= 25""",
    "figi_serve": f"with {FIGI} select {FIGI_COLUMNS} from g where ticker = 'S7'",
    "figi_serve_stored": f"with {FIGI} select {FIGI_COLUMNS} from g where ticker = 'S7'",
    "figi_registered": f"with {FIGI} select {FIGI_COLUMNS} from g where ticker in {SUPPLIERS}",
    "figi_unregistered": f"""
        with {FIGI} select {FIGI_COLUMNS} from g where ticker not in {SUPPLIERS}""",
    "missing_symbols": """
        select 'U' || c_custkey as symbol, 'no_rows_returned' as error from customer
        where c_custkey not in (select user_id from events)""",
    "symbol_list": """
        select c_custkey, upper(c_name) as symbol from customer where c_mktsegment <> 'FURNITURE'""",
    "code_lists": """
        select c_custkey, 0 as position, lower(c_name) as code from customer
        union all select c_custkey, 1 as position, lower(c_mktsegment) as code from customer""",
    "selected_series": """
        select c_custkey, 0 as position, lower(c_mktsegment) as code from customer
        where c_mktsegment not in ('FURNITURE', 'BUILDING')
        union all select c_custkey, 1, 'gdp' from customer
        where c_mktsegment not in ('FURNITURE', 'BUILDING')
        union all select c_custkey, position, code from customer, (values
            (0, 'cpi'), (1, 'fed_funds'), (2, 'gdp'), (3, 'inflation'), (4, 'interest_rate_10y'),
            (5, 'unemployment'), (6, 'usd/cad'), (7, 'usd/eur'), (8, 'usd/gbp'), (9, 'usd/jpy'),
            (10, 'yield_curve')) as v(position, code)
        where c_mktsegment in ('FURNITURE', 'BUILDING')""",
    "joined_symbols": """
        select c_custkey, upper(c_name) || case when c_acctbal < 0 then '' else ',' || c_mktsegment end
               || ',X' as symbols from customer""",
    "path_parts": """
        select p_partkey, case when p_size % 2 = 0 then p_brand end as bucket,
               case when p_size % 2 = 0 then p_type || '/' || p_name end as key,
               replace(p_brand || '/' || p_type, '/', '-') as code from part""",
    "selected_tickers": f"""
        with {INSTRUMENTS} select ticker from reg where is_active and is_scheduled
        order by ticker limit 25""",
    "date_window": """
        with w as (select o_orderkey,
                          case when o_orderstatus = 'F' then cast(o_orderdate as date)
                               else date '2001-12-31' end as start, o_orderstatus from orders),
        x as (select o_orderkey, start,
                     case when o_orderstatus = 'P' then date '2002-01-01' else start end as end
              from w)
        select o_orderkey, start, x.end as end, x.end + 1 as end_excl from x""",
    "backfill_symbol_batches": """
        select 'U' || c_custkey as symbol, c_custkey as position,
               (row_number() over (order by c_custkey) - 1) // 5 as batch_no from customer""",
    "backfill_windows": """
        with recursive w as (
            select distinct cast(o_orderdate as date) as start, n as years,
                   cast(o_orderdate as date) as window_start
            from orders, (values (1), (2)) as v(n)
            union all
            select start, years,
                   cast(window_start + to_years(years) + interval 1 day as date) as window_start
            from w where window_start + to_years(years) < date '2003-03-15')
        select start, years, window_start,
               least(cast(window_start + to_years(years) as date), date '2003-03-15') as window_end
        from w""",
    "backfill_coverage": """
        with recursive w as (
            select date '1996-02-29' as window_start
            union all
            select cast(window_start + interval 1 year + interval 1 day as date) from w
            where window_start + interval 1 year < date '2001-12-31'),
        windows as (select window_start, least(cast(window_start + interval 1 year as date),
                                               date '2001-12-31') as window_end from w),
        b as (select c_custkey, (row_number() over (order by c_custkey) - 1) // 5 as batch_no
              from customer),
        n as (select batch_no, count(*) as symbols from b group by batch_no),
        o as (select batch_no, window_start, count(*) as rows
              from orders join b on o_custkey = c_custkey
              join windows on cast(o_orderdate as date) between window_start and window_end
              group by batch_no, window_start)
        select batch_no, window_start, window_end, symbols, coalesce(rows, 0) as rows
        from n cross join windows left join o using (batch_no, window_start)""",
    "job_prices": f"with {RETURNS} {gold_prices('r')}",
    "job_prices_batch_scope": f"""
        with {RETURNS}, {SPLIT}, {lag_return("hi", "b")},
        u as (select * from r where ts < date '2024-01-15' union all select * from b)
        {gold_prices("u")}""",
    "job_prices_marks": f"""
        with {BARS}
        select 'yahoo' as source, 'prices_1d' as dataset, symbol as ticker, max(ts) as last_ts,
               '20240201160500Z' as last_run_id, '2024-02-01 16:05:00' as updated_at
        from bars group by symbol""",
    "job_prices_ledger": """
        select 'prices_1d' as dataset, date '2024-02-01' as run_date, 'partial' as status,
               cast(2 * count(distinct user_id) as int) as items_total,
               cast(count(distinct user_id) as int) as items_success,
               cast(count(distinct user_id) as int) as items_failed,
               '2024-02-01 16:05:00' as started_at, '2024-02-01 16:05:00' as finished_at
        from events""",
    "job_prices_faulty": f"""
        with {RETURNS}
        select symbol, ts, open, high, low, close, volume, cast(null as double) as dividends,
               cast(null as double) as stock_split, close_returns, 'yahoo' as source,
               cast(null as varchar) as run_id, '2024-02-01 16:05:00' as ingested_at
        from r where substr(symbol, 2)::bigint % 10 not in (4, 5, 6)""",
    "job_prices_rejects": f"""
        with {BARS},
        f as (select symbol, substr(symbol, 2)::bigint % 10 as digit, count(*) as days
              from bars group by symbol, date_trunc('month', ts))
        select 'bad_value' as kind, symbol as key, sum(days + 1)::bigint as n
        from f where digit in (4, 5) group by symbol
        union all
        select 'unreadable', null, count(*) from f where digit = 6 having count(*) > 0
        union all
        select distinct 'no_rows', symbol || 'X', 1 from f where digit <> 6""",
    "job_macro": f"""
        with {MACRO}
        select case series when '1-urgent' then 'cpi' when '2-high' then 'usd/cad'
                           else 'interest_rate_10y' end as series,
               ts, value, 'fred' as source, cast(null as varchar) as run_id,
               '2024-02-01 16:05:00' as ingested_at
        from m where value is not null and series in ('1-urgent', '2-high', '3-medium')
        qualify row_number() over (partition by series, ts order by position desc) = 1""",
    "job_macro_rejects": f"""
        with {MACRO}
        select distinct 'unknown_key' as kind, series as key, 1 as n from m
        where series not in ('1-urgent', '2-high', '3-medium', '5-low')
        union all
        select 'bad_value', 'usd/jpy', count(*) from m where series = '5-low' and value is not null
        having count(*) > 0""",
    "job_fundamentals": f"""
        with {FACTS}, {latest_facts("filed", "f", f"l_orderkey desc, l_linenumber desc, filed desc, {LINE_ORDER}")}
        select ticker, concept, unit, period_end, fp, form, fy, period_start, val, accn, filed,
               'sec_edgar' as source, cast(null as varchar) as run_id,
               '2024-02-01 16:05:00' as ingested_at
        from f""",
    "job_figi": f"""
        with {FIGI}
        select {FIGI_COLUMNS}, 'openfigi' as source, cast(null as varchar) as run_id,
               '2024-02-01 16:05:00' as ingested_at
        from g where ticker in {SUPPLIERS}""",
    "job_register": f"""
        with {BARS},
        b as (select symbol, count(*) as rows, min(ts) as first from bars
              where ts >= date '2024-01-03' group by symbol)
        select 'U' || c_custkey as ticker,
               case when c_mktsegment = 'MACHINERY' then c_name || ' Inc.' else c_name end as name,
               case when c_mktsegment <> 'BUILDING' then 'NYQ' end as exchange,
               'USD' as currency, 'America/New_York' as timezone, true as is_active,
               true as is_scheduled, rows, first
        from customer left join b on symbol = 'U' || c_custkey where {REGISTERED_INFO}""",
    "job_backfill": f"with {BACKFILLED} select * from chunks",
    "job_backfill_resumed": f"""
        with {BACKFILLED},
        w as (select *, batch_no // ((max(batch_no) over () + 4) // 4) < 2 as early from chunks)
        select * exclude (early), case when early and status <> 'failed' then 1 else 2 end as run,
               case when early and status <> 'failed' then '2024-01-20 16:05:00'
                    else '2024-02-01 16:05:00' end as finished_at
        from w""",
    "stream_prices": f"with {RETURNS} {gold_prices('r')}",
    "job_prices_late": f"""
        with {RETURNS}
        select symbol, ts, open, high, low, close, volume, cast(null as double) as dividends,
               cast(null as double) as stock_split, close_returns, 'yahoo' as source,
               cast(null as varchar) as run_id from r""",
    "facts_flatten_company": f"""
        with {COMPANY}, {latest_facts("filed", "f", f"filed desc, {LINE_ORDER}")}
        select {FACT_COLUMNS}, '{{"frame":"CY' || fy || '"}}' as extra from f""",
    "facts_flatten_company_typed": f"""
        with {COMPANY}, {latest_facts("filed", "f", f"filed desc, {LINE_ORDER}")}
        select {FACT_COLUMNS} from f""",
    "facts_unknown_fields": f"""
        with {COMPANY},
        k as (select ticker, date_trunc('month', period_end) as month, concept from l)
        select 'payload' as level, field, n
        from (select count(distinct (ticker, month)) as n from k), (values ('cik'), ('entityName')) as v(field)
        union all
        select 'concept', 'label', count(distinct (ticker, month, concept)) from k
        union all
        select 'observation', 'frame', count(*) from k""",
    "empty_batches": f"""
        select 0::bigint as n, * from (values {typed("prices", schemas.SILVER_PRICES)},
            {typed("macro", schemas.SILVER_MACRO)}, {typed("facts", schemas.SILVER_FACTS)},
            {typed("figi", schemas.SILVER_FIGI)}) as v(vendor, "column", type)""",
    "bronze_by_symbol": f"""
        with {BARS}, days(dt) as (values ('2024-01-20'), ('2024-02-01'))
        select symbol || ',' || symbol || 'X' as symbols, dt, cast(count(*) + 3 as int) as n_rows
        from bars cross join days where symbol = 'U7' group by symbol, dt, date_trunc('month', ts)""",
    "silver_order": f"with {BARS} select count(*) as n_rows, 0::bigint as disordered from bars",
    "quality_refusals": f"""
        with {FLAWED},
        k as (select symbol, ts, any_value(low) as low, any_value(open) as open, any_value(high) as high,
                     any_value(volume) as volume from flawed group by symbol, ts),
        q as (select count(*) filter (open < 0 or high < 0 or low < 0) as negative,
                     count(*) filter (volume < 0) as sold from k)
        select 'no rows' as batch, '[prices_1d] the batch has no rows' as refusal
        union all select 'no rows and no columns', '[prices_1d] the batch has no rows'
        union all select 'no close and no volume', '[prices_1d] columns are missing: [''close'', ''volume'']'
        union all select 'sound', null
        union all
        select 'flawed', case when negative > 0
                   then '[prices_1d] open, high, low or close is negative in ' || negative || ' rows'
                   when sold > 0 then '[prices_1d] volume is negative in ' || sold || ' rows' end
        from q""",
    "events_topk_per_type": """
        select event_id, event_type, value from events
        qualify row_number() over (partition by event_type order by ts, event_id) <= 2000""",
    "prices_serve_stored": f"""
        with {RETURNS}
        select symbol, ts, open, high, low, close, volume, close_returns from r
        where symbol = 'U7' and symbol in {SYMBOLS}
          and ts between date '2024-01-05' and date '2024-01-25'
        order by ts limit 500""",
    "facts_serve_stored": f"""
        with {FACTS_LATEST}
        select ticker, concept, unit, period_end, fy, fp, form, val from f
        where ticker = 'S7' and concept = 'A:F' and ticker in {SUPPLIERS}
        order by period_end desc, concept, unit, fp, form limit 500""",
    "run_ids": """
        select count(*) as rows, count(*) as ids, count(*) as hexadecimal from orders""",
}
ORACLE["stream_macro"] = f"select *, 1 as runs from ({ORACLE['job_macro']})"
ORACLE["stream_facts"] = f"select *, 1 as runs from ({ORACLE['job_fundamentals']})"
ORACLE["stream_figi"] = f"select *, 1 as runs from ({ORACLE['job_figi']})"

